import random
import re

import pytest

from tidewell.llm import decontaminate as dc


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n)]


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


ITEM = words(40, 1)
OTHER = words(30, 2)


def changed(own, *at):
    return [f"zz{k}" if k in at else w for k, w in enumerate(own)]


def weighted(a, b):
    """The largest weighted Jaccard of the item ``b`` and a window of its size in ``a``, by trying every one aligned with a shared shingle."""

    def bag(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    size = lambda s: sum(min(255, 10 + sum(map(len, g))) for g in s)
    item, best = bag(b), 0.0
    shared = {(k, j) for k in range(len(a) - 4) for j in range(len(b) - 4) if a[k : k + 5] == b[j : j + 5]}
    for start in {max(0, min(k - j, len(a) - len(b))) for k, j in shared}:
        own = bag(a[start : start + len(b)])
        if own and item:
            best = max(best, size(own & item) / size(own | item))
    return best


def test_leaks_equal_trying_every_window(spark):
    rng = random.Random(9)
    docs, items = [], [(1, " ".join(ITEM)), (2, "Some, " + " ".join(OTHER).upper() + "!")]
    for k in range(60):
        own = changed(rng.choice([ITEM, ["some", *OTHER]]), *rng.sample(range(30), rng.randrange(0, 4)))
        if k % 5 == 0:
            own.insert(10, "inserted")
        docs.append((k, " ".join(words(rng.randrange(0, 60), k) + own + words(rng.randrange(0, 60), k + 99))))
    split = lambda t: [w for w in re.split(r"[^\w]+", t.lower()) if w]
    want = {(d, i) for d, t in docs for i, u in items if weighted(split(t), split(u)) >= 0.8}
    got = dc.leaks(*frames(spark, docs, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and 10 < len(want) < 60
    for r in got:
        assert r["similarity"] == pytest.approx(weighted(split(dict(docs)[r["doc_id"]]), split(dict(items)[r["item_id"]])))


def sliding(a, b):
    """As ``weighted``, with a window at every start."""

    def bag(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    size = lambda s: sum(min(255, 10 + sum(map(len, g))) for g in s)
    item, found = bag(b), [bag(a[start : start + len(b)]) for start in range(max(1, len(a) - len(b) + 1))]
    return max(size(own & item) / size(own | item) for own in found)


def test_windows_at_every_start_are_tried(spark):
    docs, items = [], [(1, " ".join(ITEM)), (2, " ".join(OTHER))]
    for k in range(60):  # the passage lacks its first or last words, and long words stand on one side
        own, gone = (ITEM, OTHER)[k % 2], 2 + k // 2 % 6
        own = own[gone:] if k % 4 < 2 else own[: len(own) - gone]
        docs.append((k, " ".join(["longwordsstandhere" + w for w in words(9, k)] + own + words(9, k + 99)) if k % 4 < 2 else " ".join(words(9, k) + own + ["longwordsstandhere" + w for w in words(9, k + 99)])))
    docs += [(k + 100, t[: len(t) // 2] + " " + t) for k, t in docs]
    want = {(d, i) for d, t in docs for i, u in items if sliding(t.split(), u.split()) >= 0.8}
    assert want - {(d, i) for d, t in docs for i, u in items if weighted(t.split(), u.split()) >= 0.8}
    got = dc.leaks(*frames(spark, docs, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        at, item = r["start"], dict(items)[r["item_id"]].split()
        assert r["similarity"] == pytest.approx(sliding(dict(docs)[r["doc_id"]].split()[at : at + len(item)], item))


def test_edge_cases(spark):
    text = " ".join(ITEM)
    docs = [(1, None), (2, ""), (3, "a b c"), (4, text.title()), (4, text), (4, "nothing here at all to see"), (None, text), (5, "a b c d " + text[:20]), (6, ("filler " * 30_000) + text + " end")]
    items = [(7, text), (8, text), (9, "a b c"), (10, None), (11, "")]
    rows, bench = frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(rows, bench).collect()}
    assert got == {(d, i) for d in (4, None, 6) for i in (7, 8)}
    kept = [r["doc_id"] for r in dc.clean(rows, bench).collect()]
    assert sorted(kept) == [1, 2, 3, 5] and dc.clean(rows, bench).columns == rows.columns
    assert dc.leaks(rows.filter("false"), bench).count() == 0
    assert dc.leaks(rows, bench.filter("false")).count() == 0 and dc.clean(rows, bench.filter("false")).count() == len(docs)


def test_rows_without_an_id_go_by_their_own_texts(spark):
    text = " ".join(ITEM)
    rows, bench = frames(spark, [(None, text), (None, "nothing here at all to see"), (None, None), (1, text), (2, "a b c")], [(7, text)])
    assert sorted(map(str, (r["text"] for r in dc.clean(rows, bench).collect()))) == ["None", "a b c", "nothing here at all to see"]


def test_clean_rows_of_a_leaking_id_stay_by_text(spark):
    text, other = " ".join(ITEM), "nothing here at all to see"
    rows, bench = frames(spark, [(4, text), (4, other), (4, other), (4, None), (4, ""), (None, text), (None, other), (5, "so " + text)], [(7, text)])
    assert [r["doc_id"] for r in dc.clean(rows, bench).collect()] == [None]
    kept = sorted(((r["doc_id"], r["text"]) for r in dc.clean(rows, bench, by_text=True).collect()), key=str)
    assert kept == sorted([(4, other), (4, other), (4, None), (4, ""), (None, other)], key=str)


def longs(*values):
    return tuple(x - (1 << 64) if x >> 63 else x for x in values)


def test_all_fingerprints_within_the_radius_meet(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        a, b = (rng.getrandbits(64),) * 2
        for f in rng.sample(range(64), dc.RADIUS - k % 3):
            b ^= 1 << f
        rows.append(longs(a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    met = df.selectExpr(f"size(filter({dc.near_blocks('b')}, x -> array_contains({dc.blocks('a')}, x) AND shiftright(x, 32) = {dc.first_block('(a ^ b)')})) AS n")
    assert met.filter("n <> 1").count() == 0  # once, at the first block


def test_few_of_unrelated_pairs_meet(spark):
    rng = random.Random(4)
    mine = spark.createDataFrame([longs(rng.getrandbits(64)) for _ in range(400)], "a long").selectExpr(f"explode({dc.blocks('a')}) AS block")
    theirs = spark.createDataFrame([longs(rng.getrandbits(64)) for _ in range(200)], "b long").selectExpr(f"explode({dc.near_blocks('b')}) AS block")
    assert mine.join(theirs, "block").count() < 0.3 * 400 * 200


def test_recall_against_every_window(spark):
    rng, docs, items = random.Random(21), [], []
    for k in range(25):
        items.append((k, " ".join(words(rng.randrange(30, 90), 500 + k))))
    for k in range(500):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [f"zz{k}"], [own[at], f"yy{k}"]])
        docs.append((k, " ".join(words(rng.randrange(0, 30), k) + own + words(rng.randrange(0, 30), k + 999))))
    want = {(d, i) for d, t in docs for i, u in items if sliding(t.split(), u.split()) >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(*frames(spark, docs, items)).collect()}
    print("recall", len(got & want) / len(want), "of", len(want))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100


def test_columns_of_any_name_are_kept(spark):
    rows = spark.createDataFrame([(1, " ".join(ITEM), 5, 6, 7), (2, "a b c", 5, 6, 7)], "doc_id long, text string, _bad long, _row long, _own_id long")
    bench = spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, text string")
    kept = dc.clean(rows, bench)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [(2, "a b c", 5, 6, 7)]


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    rows, bench = frames(spark, [(1, " ".join(ITEM))], [(1, " ".join(ITEM))])
    monkeypatch.setattr(dc, "SENT_SHINGLES", 0)
    assert dc.leaks(rows, bench).count() == 1


def test_plan_is_native(spark):
    plan = dc.leaks(*frames(spark, [(1, " ".join(ITEM))], [(1, " ".join(ITEM))]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
