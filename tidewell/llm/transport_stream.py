"""Media columns: MPEG transport streams.

``mux`` stores a payload as a transport stream of 188-byte packets: a program association table,
a program map table with one elementary stream of private data, and that stream's packets of at
most ``PES`` payload bytes, each with a presentation timestamp; each opens with a packet that
carries a clock reference and the random-access flag.  ``demux`` reads any transport stream: it joins the sections of the program tables over
packets, checks every continuity counter (from any start; packets sent twice and packets without payload
count as the format has them), reassembles the elementary packets, bounded or not, of one stream, and gives
the payload back with the timestamps and byte positions of the random-access points.

Edge cases: a null text is the empty text, whose payload is 64 zero bytes; a very long text is one long
stream, whose timestamps wrap; repeated rows give equal values; an empty table gives an empty table; columns that ``mux``
is not asked for are left out, and ``demux`` keeps all but those with a name of its own; a damaged stream raises ValueError
that names the fault.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._util import parts, slices, texts
from tidewell.sources.package import in_batches

PACKET, BODY, PES = 188, 184, 32 * 1024
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
#: Ticks of the 90 kHz clock between elementary packets.
TICKS = 3600
#: Streams whose elementary packets have no header of their own: map, padding, private 2 and control streams.
BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
FEATURES = "program int, media_pid int, packets long, elementary_packets long, payload binary, random_access array<struct<pts: long, position: long>>, last_counter int"


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The checksum of table sections: polynomial 04C11DB7, not reflected, no final inversion."""
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | MEDIA_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def _elementary(data: bytes, pts: int) -> bytes:
    return struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data


def mux_bytes(payload: bytes) -> bytes:
    """The stream of one payload; equal payloads give equal streams."""
    out, counter = [TABLES], 0
    for k, start in enumerate(range(0, len(payload), PES)):
        pts = k * TICKS % (1 << 33)
        unit = _elementary(payload[start : start + PES], pts)
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        # The first packet: 8 bytes of adaptation with random-access flag and clock, stuffed where the unit is short.
        room = BODY - 8
        first, rest = unit[:room], unit[room:]
        out += [struct.pack(">BHBBB", 0x47, 0x4000 | MEDIA_PID, 0x30 | counter, BODY - 1 - len(first), 0x50), clock, b"\xff" * (room - len(first)), first]
        counter = counter + 1 & 15
        if full := len(rest) // BODY:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF
            packets[:, 3] = 0x10 | (np.arange(full) + counter) % 16
            packets[:, 4:] = np.frombuffer(rest, np.uint8, full * BODY).reshape(full, BODY)
            out.append(packets.tobytes())
            counter = counter + full & 15
        if tail := rest[full * BODY :]:
            pad = BODY - len(tail) - 1
            out += [struct.pack(">BHBB", 0x47, MEDIA_PID, 0x30 | counter, pad), (b"\0" + b"\xff" * (pad - 1)) if pad else b"", tail]
            counter = counter + 1 & 15
    return b"".join(out)


def _body(packet: bytes) -> bytes:
    """What a packet holds behind its header and adaptation field."""
    kind = packet[3] >> 4 & 3
    return packet[4:] if kind == 1 else packet[5 + packet[4] :] if kind == 3 else b""


def sections(packets: np.ndarray, table_id: int) -> Iterator[bytes]:
    """The whole sections of a table, from the packets of its PID; a section may go over several packets."""
    held = None
    for packet in (x.tobytes() for x in packets):
        body = _body(packet)
        if packet[1] & 0x40 and body:
            ahead, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            yield from _closed((held or b"") + ahead if held is not None else b"", table_id)[0]
            held = b""
        if held is None:
            continue
        found, held = _closed(held + body, table_id)
        yield from found


def _closed(data: bytes, table_id: int) -> tuple[list[bytes], bytes]:
    """The sections that end in ``data``, and what is left."""
    found = []
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + (struct.unpack_from(">H", data, 1)[0] & 0xFFF)
        if len(data) < size:
            break
        section, data = data[:size], data[size:]
        if section[0] == table_id:
            if crc32_mpeg(section):
                raise ValueError(f"damaged table {table_id}")
            if section[5] & 1:  # it is in force now, not the next one
                found.append(section)
    return found, b"" if data[:1] == b"\xff" else data


def streams(packets: np.ndarray, pids: np.ndarray) -> dict[int, dict[int, int]]:
    """Program to PID to stream type, from the program tables."""
    if not (pids == PAT_PID).any():
        raise ValueError("no program association table")
    maps = {}
    for section in sections(packets[pids == PAT_PID], 0):
        maps |= {n: pid & 0x1FFF for n, pid in struct.iter_unpack(">HH", section[8:-4]) if n}
    found: dict[int, dict[int, int]] = {}
    for program, pid in maps.items():
        for section in sections(packets[pids == pid], 2):
            if struct.unpack_from(">H", section, 3)[0] != program:
                continue
            at, own = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF), found.setdefault(program, {})
            while at + 5 <= len(section) - 4:
                kind, pid_of, more = struct.unpack_from(">BHH", section, at)
                own[pid_of & 0x1FFF], at = kind, at + 5 + (more & 0xFFF)
    if not any(found.values()):
        raise ValueError("no program map table")
    return found


def in_order(own: np.ndarray) -> np.ndarray:
    """The packets of a PID that carry payload, without repeats; ValueError where one is missing.

    A counter goes on by one with each payload; a packet may come twice, and the discontinuity flag allows a jump.
    """
    own = own[own[:, 3] & 0x10 > 0]
    if len(own) < 2:
        return own
    step = np.diff((own[:, 3] & 15).astype(np.int16)) % 16
    keep = np.ones(len(own), bool)
    for k in np.flatnonzero(step != 1).tolist():
        before, packet = own[k].tobytes(), own[k + 1].tobytes()
        if step[k] == 0 and _body(before) == _body(packet) and before[1:4] == packet[1:4]:
            keep[k + 1] = False
        elif not (packet[3] & 0x20 and packet[4] and packet[5] & 0x80):
            raise ValueError("a continuity counter is out of order")
    return own[keep]


def _unit(unit: bytes) -> tuple[int | None, bytes]:
    """Timestamp and data of an elementary packet."""
    if len(unit) < 6 or unit[:3] != b"\0\0\1":
        raise ValueError("an elementary packet is not whole")
    size = struct.unpack_from(">H", unit, 4)[0]  # 0: up to the next one
    if size and size + 6 != len(unit):
        raise ValueError("an elementary packet is not whole")
    if unit[3] in BARE:
        return None, unit[6:]
    if len(unit) < 9 + unit[8]:
        raise ValueError("an elementary packet is not whole")
    pts, s = None, unit[9:14]
    if unit[7] & 0x80:
        pts = (s[0] >> 1 & 7) << 30 | (s[1] << 8 | s[2]) >> 1 << 15 | (s[3] << 8 | s[4]) >> 1
    return pts, unit[9 + unit[8] :]


def demux_bytes(media: bytes, pid: int | None = None) -> tuple:
    """A row of FEATURES from a stream: of the elementary stream ``pid``, or of the first program's first one.

    Packets before a stream's first elementary packet, where a recording sets in, are passed over.
    """
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    if (packets[:, 1] & 0x80).any():
        raise ValueError("a packet is marked as damaged")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    known = streams(packets, pids)
    program = next((n for n, own in known.items() if own and (pid is None or pid in own)), None)
    if program is None:
        raise ValueError(f"no stream {pid}")
    media_pid = next(iter(known[program])) if pid is None else pid
    own = in_order(packets[pids == media_pid])
    starts = np.flatnonzero(own[:, 1] & 0x40)
    payload, points, position = [], [], 0
    for a, b in zip(starts, [*starts[1:], len(own)], strict=False):
        run = own[a:b]
        plain = run[:, 3] & 0x20 == 0
        whole, k = [], 0
        edges = [*np.flatnonzero(np.diff(plain.astype(np.int8))) + 1, len(run)]
        for edge in edges:  # stretches of packets with and without an adaptation field
            whole += [run[k:edge, 4:].tobytes()] if plain[k] else [_body(x.tobytes()) for x in run[k:edge]]
            k = edge
        pts, data = _unit(b"".join(whole))
        if run[0, 3] & 0x20 and run[0, 4] and run[0, 5] & 0x40:
            points.append((pts, position))
        payload.append(data)
        position += len(data)
    return program, media_pid, len(packets), len(starts), b"".join(payload), points, int(own[-1, 3] & 15) if len(own) else None


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def mux(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes and the stream of each text in ``media``."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for b in (part for whole in batches for part in slices(whole, 200)):
            yield from parts(((k, len(x), mux_bytes(padded(x))) for k, x in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True)), schema)

    return docs.select(F.col(key).cast("long"), text).transform(in_batches, store, f"{key} long, n_bytes long, media binary")


def demux(media: DataFrame) -> DataFrame:
    """The columns of ``media`` but the stream and those with the name of a feature, then those of FEATURES."""
    made = {x.split()[0] for x in FEATURES.split(", ") if "<" not in x} | {"random_access", "media"}
    keep = [f for f in media.schema if f.name.lower() not in made]
    names = [f.name for f in keep]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 200)):
            schema = pa.schema([b.schema.field(c) for c in names] + [("program", pa.int32()), ("media_pid", pa.int32()), ("packets", pa.int64()), ("elementary_packets", pa.int64()), ("payload", pa.binary()), ("random_access", pa.list_(pa.struct([("pts", pa.int64()), ("position", pa.int64())]))), ("last_counter", pa.int32())])
            own = zip(*(b.column(c).to_pylist() for c in names), b.column("media").to_pylist(), strict=True)
            made = ((*row[:-1], *demux_bytes(row[-1])) for row in own)
            yield from parts(((*r[:-2], [{"pts": p, "position": q} for p, q in r[-2]], r[-1]) for r in made), schema)

    return media.select(*(F.col(f"`{c}`") for c in names), "media").transform(in_batches, load, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), FEATURES]))


def digests(docs: DataFrame) -> DataFrame:
    """Store each text as a stream, read it back, and reduce both to digests and a feature line."""
    media = mux(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = demux(media)
    points = F.concat_ws(",", F.transform("random_access", lambda p: F.concat_ws("@", p["pts"], p["position"])))
    line = F.concat_ws(";", F.concat(F.lit("program="), F.col("program")), F.concat(F.lit("pid="), F.col("media_pid")), F.concat(F.lit("packets="), F.col("packets")), F.concat(F.lit("units="), F.col("elementary_packets")), F.concat(F.lit("last_counter="), F.col("last_counter")), F.concat(F.lit("points="), points))
    tail = F.crc32(F.substring("payload", -64, 64))
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", line.alias("feature"))


def same_tail(payload: bytes) -> int:
    """The checksum that ``digests`` gives as tail_crc32."""
    return zlib.crc32(payload[-64:])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
