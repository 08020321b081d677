"""WARC archives with a two-level capture index.

Captures are ordered by (reversed-host URL key, page_id) through one range exchange.  Every
task writes one archive, a gzip member for each record, and beside it an index file of
compressed blocks of ``BLOCK`` captures in the same order, and a file with the sparse directory of its
blocks.  The whole directory, a Parquet table, keeps one row for each block, too.

``find`` looks up any number of keys: the first and last keys of the archives (a row for each task that
wrote) tell by binary search in which ones a key can be; the keys of an archive come to one task, in order,
which binary-searches the sparse directory, reads the blocks by range, binary-searches these, and reads
the records by range, those that lie together at once.  ``scan`` walks the directory instead.

A task's files carry a name of their own attempt and only the directory rows of the committed
attempt name them, so a lost executor or a second attempt leaves nothing wrong behind.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest
page_id is the response and the others revisit it.

Edge cases: a null html is an empty payload; a null url has the empty key; a null page_id sorts
before all others and is never the record that others refer to unless all are null; rows that
repeat a page_id with the same payload keep one response, the others revisit that same page_id;
control characters and blanks of a url are percent-encoded in the archive; a very long payload is one
record and in one task's memory; a key that many captures share is found in all archives that it spans; an empty
table gives an empty directory and no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._util import batch, filesystem, parts, scratch, tasks, written
from tidewell.sources.package import in_batches

BLOCK = 128
#: Index lines hold a key, a tab and numbers; control characters of a key become ``%``.
CONTROL = r"[\x00-\x1f\x7f]"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIRECTORY = "first_key string, last_key string, archive string, archive_start long, archive_end long, index_file string, start long, length long, n long, blocks string"
#: Records of a block that are read at once, if they make up half of the stretch that holds them.
TOGETHER = 0.5
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url):
    """The reversed host, then port, path and query: ``com,example,www)/a?b``.  Null gives ''."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*([^#]*)", 1)
    key = F.when(host == "", F.lower(url)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))
    return F.regexp_replace(key, CONTROL, "%")


def _record(kind: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(body)}"]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + out.flush()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _encode(page_id, url: str, payload: bytes, refers_to, revisit: bool) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", digest), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Bytes", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        return _record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], http + payload)
    return _record("revisit", [*headers, ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to)), ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")], http)


def _decode(member: bytes) -> tuple:
    """A row of RECORDS from the bytes of one record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    kind, number = fields["WARC-Type"], lambda k: int(fields[k]) if fields.get(k) else None
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"])
    if kind == "response":
        n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"damaged record of page {fields['X-Page-Id']}")
    return (number("X-Page-Id"), fields["WARC-Target-URI"], n, digest, kind, number("X-Refers-To-Page"), payload)


def ordered(pages: DataFrame, min_revisit: int) -> DataFrame:
    """Pages by (key, page_id), each copy of a repeated payload preceded by a row that names its response.

    Only thin rows meet by digest; the payloads cross one range exchange and no join.
    """
    thin = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    thin = thin.filter(F.col("size") >= min_revisit)
    first = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "key", "url")).alias("first")
    shared = thin.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    # With the bare key the order is one for both kinds of row; a copy's note comes just before it.
    notes = thin.join(shared, "digest").select("key", "page_id", "url", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("html"), F.col("first.page_id").alias("to"), ((F.col("first.page_id").eqNullSafe(F.col("page_id"))) & F.col("first.key").eqNullSafe(F.col("key")) & F.col("first.url").eqNullSafe(F.col("url"))).alias("is_first"), "digest")
    fat = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", F.lit(1).alias("kind"), "html", F.lit(None).cast("long").alias("to"), F.lit(None).cast("boolean").alias("is_first"), F.lit(None).cast("string").alias("digest"))
    return notes.unionByName(fat).repartitionByRange(tasks(pages.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id", "url", "kind", "digest")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Write page_id, url, html as archives below ``folder``; returns the directory, written there too."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        archive, index, sparse = f"{folder}/part-of-archive-{name}.warc.gz", f"{folder}/part-of-index-{name}.cdx.gz", f"{folder}/part-of-blocks-{name}.tsv.gz"
        store, where = filesystem(archive)
        rows, lines, done = [], [], set()
        at = start = index_at = 0
        out = index_out = None
        notes: dict[str, tuple] = {}
        here = None

        def close() -> None:
            nonlocal index_at, start, lines
            block = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            index_out.write(block)
            rows.append((lines[0].split("\t")[0], lines[-1].split("\t")[0], archive, start, at, index, index_at, len(block), len(lines), sparse))
            index_at, start, lines = index_at + len(block), at, []

        for b in batches:
            for key, page, url, kind, html, to, is_first, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, page, url) != here:
                    here, notes = (key, page, url), {}
                if kind == 0:
                    notes[digest] = (to, is_first)
                    continue
                if out is None:
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    out, index_out = store.open_output_stream(where, compression=None), store.open_output_stream(filesystem(index)[1], compression=None)
                payload = (html or "").encode()
                found = hashlib.sha1(payload).hexdigest() if notes else ""
                to, is_first = notes.get(found, (None, True))
                revisit = found in notes and (not is_first or found in done)
                if found in notes and is_first:
                    done.add(found)
                record = _encode(page, url, payload, to, revisit)
                out.write(record)
                lines.append(f"{key}\t{'' if page is None else page}\t{at}\t{len(record)}")
                at += len(record)
                if len(lines) == BLOCK:
                    close()
        if lines:
            close()
        if out is not None:
            out.close()
            index_out.close()
            with store.open_output_stream(filesystem(sparse)[1], compression=None) as blocks_out:
                blocks_out.write(gzip.compress("\n".join("\t".join(map(str, r[:-1])) for r in rows).encode(), 6, mtime=0))
        yield batch(rows, pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("archive", pa.string()), ("archive_start", pa.int64()), ("archive_end", pa.int64()), ("index_file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("n", pa.int64()), ("blocks", pa.string())]))

    return written(ordered(pages, min_revisit).transform(in_batches, write, DIRECTORY), "warc-directory")


def _range(cache: dict, uri: str, start: int, length: int) -> bytes:
    if uri not in cache:
        cache.clear()
        store, where = filesystem(uri)
        cache[uri] = store.open_input_file(where)
    return cache[uri].read_at(length, start)


def _block(files: dict, row: dict) -> list[list[str]]:
    return [x.split("\t") for x in gzip.decompress(_range(files, row["index_file"], row["start"], row["length"])).decode().split("\n")]


def scan(directory: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record, block by block; ``payload`` is null where ``payloads`` is false or for revisits."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archives = {}, {}
        for b in batches:
            for row in b.to_pylist():
                stretch = _range(archives, row["archive"], row["archive_start"], row["archive_end"] - row["archive_start"])
                rows = []
                for _, _, at, length in _block(index, row):
                    at = int(at) - row["archive_start"]
                    found = _decode(stretch[at : at + int(length)])
                    rows.append(found if payloads and found[4] == "response" else (*found[:6], None))
                yield batch(rows, schema)

    n = tasks(directory.sparkSession)
    return directory.repartition(n, "archive", "start").transform(in_batches, load, RECORDS)


def _blocks(uri: str) -> list[dict]:
    """The sparse directory of an archive, in order."""
    store, where = filesystem(uri)
    with store.open_input_file(where) as file:
        lines = gzip.decompress(file.read()).decode().split("\n")
    names = ("first_key", "last_key", "archive", "archive_start", "archive_end", "index_file", "start", "length", "n")
    return [{k: int(v) if k in ("archive_start", "archive_end", "start", "length", "n") else v for k, v in zip(names, x.split("\t"), strict=True)} for x in lines]


def _records(archives: dict, row: dict, lines: list[list[str]]) -> Iterator[bytes]:
    """The records of some lines of a block, in order."""
    if not lines:
        return
    first, end = int(lines[0][2]), int(lines[-1][2]) + int(lines[-1][3])
    if sum(int(x[3]) for x in lines) >= TOGETHER * (end - first):
        stretch = _range(archives, row["archive"], first, end - first)
        yield from (stretch[int(x[2]) - first : int(x[2]) - first + int(x[3])] for x in lines)
    else:
        yield from (_range(archives, row["archive"], int(x[2]), int(x[3])) for x in lines)


def find(directory: DataFrame, keys: DataFrame, payloads: bool = True) -> DataFrame:
    """key and the columns of RECORDS for every capture of each of the keys (column ``key``), through the index."""
    bounds = directory.groupBy("archive").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"), F.first("blocks").alias("blocks"))
    known = sorted((r["first"], r["last"], r["blocks"]) for r in bounds.collect())  # one row for each task that wrote
    firsts, lasts, files = ([r[k] for r in known] for k in range(3))
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, key) for key in b.column(0).to_pylist() for n in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield batch(rows, pa.schema([("archive", pa.int32()), ("key", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, blocks, ends, index, archives, held, lines = None, [], [], {}, {}, None, []

        def found() -> Iterator[tuple]:
            nonlocal here, blocks, ends, held, lines
            wanted: list[list[str]] = []

            def taken() -> Iterator[tuple]:
                for line, member in zip(wanted, _records(archives, blocks[held], wanted) if wanted else (), strict=True):
                    row = _decode(member)
                    yield (line[0], *row) if payloads and row[4] == "response" else (line[0], *row[:6], None)

            for b in batches:
                for archive, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if archive != here:
                        yield from taken()
                        here, blocks, held, wanted = archive, _blocks(files[archive]), None, []
                        ends = [x["last_key"] for x in blocks]
                    at = bisect_left(ends, key)
                    while at < len(blocks) and blocks[at]["first_key"] <= key:
                        if at != held:
                            yield from taken()
                            held, wanted, lines = at, [], _block(index, blocks[at])
                        own = [x[0] for x in lines]
                        wanted += lines[bisect_left(own, key) : bisect_right(own, key)]
                        at += 1
            yield from taken()

        yield from parts(found(), schema)

    if not known:
        return directory.sparkSession.createDataFrame([], "key string, " + RECORDS)
    safe = F.regexp_replace(F.coalesce("key", F.lit("")), CONTROL, "%")
    dealt = keys.select(safe.alias("key")).distinct().transform(in_batches, route, "archive int, key string")
    dealt = dealt.repartitionById(len(known), F.col("archive")).sortWithinPartitions("archive", "key")
    return dealt.transform(in_batches, search, "key string, " + RECORDS)


def lookup(directory: DataFrame, keys: list[str]) -> list[dict]:
    """The captures of a few URL keys, as ``find`` finds them."""
    spark = directory.sparkSession
    return [r.asDict() for r in find(directory, spark.createDataFrame([(k,) for k in keys], "key string")).collect()]


def archive_folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")
