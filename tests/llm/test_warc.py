import base64
import gzip
import hashlib
import random

from tidewell.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [
    (5, "http://b.example.com/x?q=1#f", "<p>same</p>", "z"),
    (3, "https://user@www.Example.com:8080/a b\tc", "<p>same</p>", "z"),
    (3, "https://user@www.Example.com:8080/a b\tc", "<p>same</p>", "z"),
    (9, None, None, "z"),
    (7, "not a url", "", "z"),
    (8, "http://b.example.com/é", "é" * 70_000, "z"),
    (None, "http://b.example.com/x", "<p>same</p>", "z"),
    (4, "http://b.example.com/y", "\r\n\r\nWARC/1.1\r\n", "z"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_records_come_back(spark):
    out = warc.scan(warc.write_archives(frame(spark), warc.archive_folder(spark))).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    same, none = digest("<p>same</p>"), digest("")
    want = [(3, 11, same, "response", None), (3, 11, same, "revisit", 3), (4, 14, digest(ROWS[7][2]), "response", None), (5, 11, same, "revisit", 3), (7, 0, none, "response", None), (8, 140_000, digest(ROWS[5][2]), "response", None), (9, 0, none, "revisit", 7), (None, 11, same, "revisit", 3)]
    assert got == sorted(want, key=str)
    payload = {r["page_id"]: bytes(r["payload"]) for r in out if r["record_type"] == "response"}
    assert payload[8] == ROWS[5][2].encode() and payload[4] == ROWS[7][2].encode()


def test_short_payloads_are_all_responses(spark):
    out = warc.scan(warc.write_archives(frame(spark), warc.archive_folder(spark), min_revisit=12), payloads=False).collect()
    assert {r["record_type"] for r in out} == {"response"} and len(out) == len(ROWS)


def test_only_null_ids_still_have_a_response(spark):
    rows = [(None, "http://a/1", "x", ""), (None, "http://a/2", "x", "")]
    out = warc.scan(warc.write_archives(frame(spark, rows), warc.archive_folder(spark))).collect()
    assert sorted(r["record_type"] for r in out) == ["response", "revisit"]


def test_lookup_by_key(spark):
    rows = [(k, f"http://h{k % 7}.example.com/p{k}", f"page {k}", "") for k in range(1000)]
    directory = warc.write_archives(frame(spark, rows), warc.archive_folder(spark))
    assert directory.count() >= 1000 // warc.BLOCK
    found = warc.lookup(directory, ["com,example,h3)/p500", "com,example,h3)/p10", "com,example,h4)/p500"])
    assert {(f["key"], f["page_id"], bytes(f["payload"])) for f in found} == {("com,example,h3)/p500", 500, b"page 500"), ("com,example,h3)/p10", 10, b"page 10")}


def test_any_keys_equal_a_plain_search(spark):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.example.com", "example.org", "é.example", "x"]
    rows = [(k, f"http://{rng.choice(hosts)}/{rng.choice('abcé')}{rng.randrange(60)}", f"page {rng.randrange(400)}", "") for k in range(1500)]
    rows += [(k, "http://hot.example.com/same", f"hot {k}", "") for k in range(5000, 5700)] + [(k, None, "", "") for k in range(9000, 9300)]
    pages = frame(spark, rows)
    keyed = [(r["page_id"], r["key"]) for r in pages.select("page_id", warc.url_key("url").alias("key")).collect()]
    directory = warc.write_archives(pages, warc.archive_folder(spark))
    asked = sorted({k for _, k in rng.sample(keyed, 300)} | {"com,example,hot)/same", "", "com,example,a)/none", "zzz", "A"})
    found = warc.find(directory, spark.createDataFrame([(k,) for k in asked], "key string")).collect()
    assert sorted((r["key"], r["page_id"]) for r in found) == sorted((k, p) for p, k in keyed if k in set(asked))
    every = warc.find(directory, pages.select(warc.url_key("url").alias("key"))).drop("key")
    assert sorted(map(tuple, every.collect()), key=str) == sorted(map(tuple, warc.scan(directory).collect()), key=str)


def test_archives_are_gzip_members(spark):
    directory = warc.write_archives(frame(spark), warc.archive_folder(spark))
    path = directory.first()["archive"].removeprefix("file://").removeprefix("file:")
    text = gzip.open(path).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_empty_table(spark):
    directory = warc.write_archives(frame(spark).filter("false"), warc.archive_folder(spark))
    assert directory.count() == 0 and warc.scan(directory).count() == 0 and warc.lookup(directory, ["x"]) == []
