import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import packing, token_counts

COUNTER = token_counts.Counter(token_counts.default_vocabulary())
ENCODER = packing.Encoder(packing.default_vocabulary())
ODD = ["", " ", "\n\n  x", "a<|endoftext|>b", "<|startoftext|> A", "it's THEY'LL 12 3½ ²", "naïve Ñandú\u00a0x\x85y", "日本語 text", "e\u0301", "İstanbul ǅ", "x" * 5000, "a\x1cb\x00c"]


def library_ids(text):
    ids = ENCODER.tok.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids) + 1}I", *ids, 1)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.count(text) == len(COUNTER.tok.encode(text, add_special_tokens=False).ids)
    assert ENCODER(text) == library_ids(text)


def test_every_character_of_the_short_cut():
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f"1{c}2", f" {c} x{c}{c}", f"\n{c}\n  z", f"'{c}'S've {c}"):
            assert COUNTER.count(text) == len(COUNTER.tok.encode(text, add_special_tokens=False).ids), hex(ord(c))
            assert ENCODER(text) == library_ids(text), hex(ord(c))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x3000, exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == len(COUNTER.tok.encode(text, add_special_tokens=False).ids)
    assert ENCODER(text) == library_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "it's", " ", "  ", "\n", "日本", "🙂", "\u3000", "\u2028", "e\u0301", "12", "'s", "é", "!?", "\u0250x", "ſ"]), max_size=14))
def test_stretches_beyond_the_short_cut(pieces):
    for text in ("".join(pieces), " ".join(pieces)):
        assert COUNTER.count(text) == len(COUNTER.tok.encode(text, add_special_tokens=False).ids)


def test_null_keys_and_very_long_texts(spark):
    rows = spark.createDataFrame([(None, "a b 日本 c"), (1, "word and 日本 " * 40_000)], "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "2 AS key")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(rows, token_counts.default_vocabulary()).collect()}
    want = {r["doc_id"]: len(COUNTER.tok.encode(r["text"], add_special_tokens=False).ids) for r in rows.collect()}
    assert got == want


def test_whole_tokens_are_proved():
    some = sorted(COUNTER.whole)[::997]
    assert len(COUNTER.whole) > 40_000
    assert all(len(COUNTER.tok.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def docs(spark, *texts):
    return spark.createDataFrame([(k, x, "k") for k, x in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_counts(spark):
    rows = docs(spark, None, "", "Hello world", "é", "Hello world")
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(rows, token_counts.default_vocabulary(), limit=1).collect()}
    assert got == {0: (0, 0, False), 1: (0, 0, False), 2: (11, 2, True), 3: (2, 1, False), 4: (11, 2, True)}
    assert token_counts.token_counts(rows.filter("false"), token_counts.default_vocabulary()).count() == 0


@pytest.mark.parametrize("room", [8, 64])
def test_packing_is_whole_and_gapless(spark, room):
    rng = np.random.default_rng(1)
    rows = docs(spark, None, "", *(" ".join(["tree"] * int(n)) for n in rng.integers(0, 3 * room, 200)))
    out = packing.packed(rows, room=room).collect()
    assert set(out[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for r in rows.collect():
        ids, own = library_ids(r["text"] or ""), sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own)))
        for x in own:
            part = ids[4 * x["start"] : 4 * (x["start"] + x["length"])]
            assert zlib.crc32(part) == x["ids_crc32"] and (x["length"] == room or x is own[-1])
        assert sum(x["length"] for x in own) * 4 == len(ids)
    for own in by_sequence.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= room
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= -(-total // room) + 2
    assert packing.packed(rows.filter("false"), room=room).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_plan_uses_up_the_histogram(lengths):
    counts = np.bincount(lengths, minlength=51).astype(float)
    used = packing.plan(counts, 50)
    again = np.zeros(51)
    for pattern, times in used:
        assert sum(pattern) <= 50
        for v in pattern:
            again[v] += times
    assert (again == counts).all()


def test_repeated_rows_keep_their_places(spark):
    rows = docs(spark, "a b c").unionByName(docs(spark, "a b c"))
    out = packing.packed(rows, room=16).collect()
    assert len(out) == 2 and len({(r["sequence_id"], r["offset"]) for r in out}) == 2
