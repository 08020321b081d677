import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import transport_stream as ts


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=1500), st.integers(0, 80_000).map(lambda n: bytes(i * 7 % 251 for i in range(n)))))
def test_payload_comes_back(payload):
    media = ts.mux_bytes(payload)
    program, pid, packets, units, back, points, _ = ts.demux_bytes(media)
    assert back == payload and len(media) == 188 * packets and (program, pid) == (1, 0x100)
    assert points == [(k * ts.TICKS, k * ts.PES) for k in range(-(-len(payload) // ts.PES))] and units == len(points)


@pytest.mark.parametrize("size", [64, 176, 162, 161, 163, 184, 352, 345, 346, 347, 32 * 1024, 32 * 1024 + 64])
def test_edges_of_packets(size):
    assert ts.demux_bytes(ts.mux_bytes(b"x" * size))[4] == b"x" * size


def test_table_checksum():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damage_is_found():
    media = bytearray(ts.mux_bytes(b"y" * 2000))
    for at, what in ((188 * 4, "synchronisation"), (188 * 4 + 3, "counter"), (188 + 8, "table")):
        wrong = bytearray(media)
        wrong[at] ^= 1
        with pytest.raises(ValueError, match=what):
            ts.demux_bytes(bytes(wrong))
    with pytest.raises(ValueError, match="counter"):
        ts.demux_bytes(bytes(media[: 188 * 4] + media[188 * 5 :]))
    with pytest.raises(ValueError, match="whole number"):
        ts.demux_bytes(bytes(media[:-1]))


def test_query(spark):
    rows = [(1, "abc", "m"), (2, None, "m"), (3, "", "m"), (4, "é" * 50_000, "m"), (5, "abc", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in ts.digests(docs).collect()}
    for doc, text, _ in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = got[doc]
        media = ts.mux_bytes(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert tuple(got[1])[1:] == tuple(got[5])[1:] and got[4]["feature"].endswith("points=0@0,3600@32768,7200@65536,10800@98304")
    assert ts.digests(docs.filter("false")).count() == 0


def packet(pid, counter, body=b"", start=False, adaptation=None):
    """A packet of a foreign stream; the adaptation field is stuffed to fill it."""
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF])
    room = 184 - len(body)
    if not room and adaptation is None:
        return head + bytes([0x10 | counter & 15]) + body
    field = bytes([room - 1]) + ((adaptation or b"\0").ljust(room - 1, b"\xff") if room > 1 else b"")
    return head + bytes([(0x30 if body else 0x20) | counter & 15]) + field + body


def section(table_id, number, body):
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\0\0"
    return head + body + ts.crc32_mpeg(head + body).to_bytes(4)


def split(pid, counter, data, start=True):
    return [packet(pid, counter + k, data[at : at + 184], start and not k) for k, at in enumerate(range(0, len(data), 184))]


def foreign():
    """Two programs and three streams, hand-made: counters from 9, repeats, adaptation alone, long sections, unbounded packets."""
    pat = section(0, 5, b"\0\0\xe0\x10" + b"\0\x07\xe1\x23" + b"\0\x08\xe1\x24")
    notes = b"\x05\xfa" + b"n" * 250  # a descriptor, which makes the section longer than a packet
    pmt = section(2, 7, b"\xe2\x01" + (0xF000 | len(notes)).to_bytes(2) + notes + b"\x1b\xe2\x01\xf0\x00" + b"\x0f\xe2\x02\xf0\x03abc")
    other = section(2, 8, b"\xe3\x01\xf0\0\x06\xe3\x01\xf0\0")
    out = [packet(0x201, 7, b"cut off before the recording".ljust(184, b"."))]
    out += [packet(0, 3, b"\0" + pat, True)] + split(0x123, 14, b"\0" + pmt) + [packet(0x124, 0, b"\0" + other, True), packet(0x1FFF, 0, b"\xff" * 184)]
    video = [bytes(range(256)) * 2, b"", b"v" * 500]
    counter = 8
    for k, data in enumerate(video):
        pts = (1 << 32) + k * 3003
        stamp = bytes([0x21 | pts >> 29 & 0x0E]) + (pts >> 14 & 0xFFFE | 1).to_bytes(2) + (pts << 1 & 0xFFFE | 1).to_bytes(2)
        unit = b"\0\0\1\xe0\0\0\x80\x80\x05" + stamp + data  # unbounded
        first, rest = unit[:170], unit[170:]
        out.append(packet(0x201, counter, first, True, b"\x40" if k != 1 else b"\0"))
        out.append(out[-1])  # sent twice
        out.append(packet(0x201, counter, adaptation=b"\0"))  # no payload: the counter stands
        counter += 1
        for x in split(0x201, counter, rest, False):
            out += [x, packet(0x202, 4 + len(out), b"")]
            counter += 1
    audio = b"\0\0\1\xc0" + (3 + 400).to_bytes(2) + b"\x80\0\0" + b"a" * 400
    out += split(0x202, 15, audio)
    out.append(packet(0x301, 2, b"\0\0\1\xbf\0\x03xyz", True))
    return out, video


def test_a_foreign_stream():
    out, video = foreign()
    media = b"".join(out)
    assert {len(x) for x in out} == {188}
    program, pid, n, units, payload, points, last = ts.demux_bytes(media)
    assert (program, pid, n, units) == (7, 0x201, len(out), 3) and payload == b"".join(video)
    assert points == [(1 << 32, 0), ((1 << 32) + 2 * 3003, 512)] and last is not None
    assert ts.demux_bytes(media, 0x202)[2:6] == (len(out), 1, b"a" * 400, [])
    assert ts.demux_bytes(media, 0x301)[:5] == (8, 0x301, len(out), 1, b"xyz")
    with pytest.raises(ValueError, match="no stream"):
        ts.demux_bytes(media, 0x999)


def test_a_jump_is_damage_unless_it_is_announced():
    out, video = foreign()
    middle = [k for k, x in enumerate(out) if k and x[1:3] == b"\2\1" and x[3] & 0x10]  # neither first nor sent twice
    with pytest.raises(ValueError, match="counter"):
        ts.demux_bytes(b"".join(x for k, x in enumerate(out) if k != middle[0]))
    announced = [packet(0x201, 3, b"\0\0\1\xe0\0\0\x80\0\0new", True, b"\x80")]
    assert ts.demux_bytes(b"".join(out + announced))[4] == b"".join(video) + b"new"
    marked = bytearray(b"".join(out))
    marked[1] |= 0x80
    with pytest.raises(ValueError, match="damaged"):
        ts.demux_bytes(bytes(marked))


def test_columns_with_the_names_of_features(spark):
    media = ts.mux(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).selectExpr("*", "5 AS program", "'p' AS payload", "7 AS packets", "8 AS `odd name`")
    row = ts.demux(media).first().asDict()
    assert row["program"] == 1 and row["odd name"] == 8 and bytes(row["payload"]) == b"abc".ljust(64, b"\0") and row["n_bytes"] == 3
