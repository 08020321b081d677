"""Streams against batch plans over the same rows, and the HTTP edge."""

import io
import os
import threading
import time
import urllib.error
import urllib.request

import pytest
from conftest import bag
from pyspark.sql import functions as F

from tidewell.operators.aggregate import Groups, total
from tidewell.sources.http import HttpSource
from tidewell.sources.spool import Stdin
from tidewell.sources.tables import arriving, files, lines
from tidewell.streaming import live


def arrive(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, "key long, v long").coalesce(1).write.mode("append").parquet(str(folder))


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld\n")
    got = live.drained(lines(spark, str(tmp_path)).select(F.concat(F.lit("> "), F.col("value")).alias("v")))
    assert bag(got) == [("> hello",), ("> world",)]


def test_terminal_group(spark, tmp_path):
    arrive(spark, tmp_path / "t", [(0, 10), (1, 20)], [(2, 10), (3, 30)])
    stream = arriving(spark, str(tmp_path / "t"), "key long, v long", files_at_once=1)
    got = live.terminal(stream, lambda df: Groups(df, k=F.expr("v div 10")).agg(s=total("v")))
    assert bag(got) == [(1, 20), (2, 20), (3, 30)]


def test_incremental_join(spark, tmp_path):
    arrive(spark, tmp_path / "a", [(100, 1)], [(200, 2)], [(100, 3)])
    arrive(spark, tmp_path / "b", [(100, 1)], [(100, 2)])
    a = arriving(spark, str(tmp_path / "a"), "key long, v long", files_at_once=1).select(F.col("key").alias("k"), F.col("v").alias("a"))
    b = arriving(spark, str(tmp_path / "b"), "key long, v long", files_at_once=1).select(F.col("key").alias("j"), F.col("v").alias("b"))
    got = live.drained(live.bounded_join(a, b, F.expr("k = j")).select("a", "b"))
    assert bag(got) == [(1, 1), (1, 2), (3, 1), (3, 2)]


def test_state_lives_between_batches(spark, tmp_path):
    arrive(spark, tmp_path / "s", [(0, 10)], [(1, 20)], [(2, 30)])

    def step(state, row):
        if row["v"] > 15:
            state["x"] += row["v"]
        return row["v"], state["x"]

    stream = arriving(spark, str(tmp_path / "s"), "key long, v long", files_at_once=1).withColumn("all", F.lit(1))
    got = live.drained(live.stateful(stream, ["all"], ["key"], {"x": 0}, step, "x long", "v long, x long"))
    assert max(r["x"] for r in got.collect()) == 50


def test_positions_out_of_order(spark, tmp_path):
    arrive(spark, tmp_path / "p", [(5, 50), (1, 10)], [(0, 7), (3, 30)], [(2, 20)], [(2, 99), (4, 40)])

    def step(state, row):
        state["x"] = state["x"] * 2 + row["v"]
        return row["key"], state["x"]

    stream = arriving(spark, str(tmp_path / "p"), "key long, v long", files_at_once=1).withColumn("all", F.lit(1))
    got = live.drained(live.stateful(stream, ["all"], ["key"], {"x": 0}, step, "x long", "key long, x long", position="key"))
    want, x = [], 0
    for key, v in enumerate([7, 10, 20, 30, 40, 50]):
        x = x * 2 + v
        want.append((1, key, x))
    assert bag(got) == want


def test_rows_wait_for_the_watermark(spark, tmp_path):
    schema = "k long, t timestamp, v long"
    for rows in ([(1, 5, 50), (1, 1, 10)], [(1, 3, 30)], [(1, 60, 1)], [(1, 120, 2)], [(1, 300, 3)]):
        made = spark.createDataFrame([(k, v, t) for k, t, v in rows], "k long, v long, t long").selectExpr("k", "timestamp_seconds(t) AS t", "v")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))

    def step(state, row):
        state["x"] = state["x"] * 2 + row["v"]
        return row["v"], state["x"]

    stream = arriving(spark, str(tmp_path / "w"), schema, files_at_once=1)
    got = live.drained(live.stateful(stream, ["k"], ["t"], {"x": 0}, step, "x long", "v long, x long", time="t", lateness="30 seconds"))
    want, x = [], 0
    for v in (10, 30, 50, 1, 2):
        x = x * 2 + v
        want.append((1, v, x))
    assert bag(got) == sorted(want, key=str)


def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    for kind in ("parquet", "orc", "csv", "json"):
        rows.write.format(kind).save(str(tmp_path / kind))
        assert bag(files(spark, str(tmp_path / kind), kind, "k long, s string")) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        files(spark, "x", "xml")


def test_http(spark):
    http = HttpSource(timeout=60).route("POST", "/double")
    with pytest.raises(ValueError):
        http.route("POST", "/double")
    said = {}

    def ask(x):
        request = urllib.request.Request(f"http://127.0.0.1:{http.port}/double", data=str(x).encode(), method="POST")
        said[x] = urllib.request.urlopen(request).read().decode()

    with pytest.raises(urllib.error.HTTPError, match="404"):
        urllib.request.urlopen(f"http://127.0.0.1:{http.port}/nowhere")
    clients = [threading.Thread(target=ask, args=(x,)) for x in (1, 2)]
    for c in clients:
        c.start()
    while len(said) < 2:
        rows = http.rows(spark)
        http.reply(rows.select("request_id", (F.col("body").cast("long") * 2).cast("string").alias("body")))
    for c in clients:
        c.join()
    http.close()
    assert said == {1: "2", 2: "4"}


def test_http_fold_replies_to_each(spark):
    """Each request is answered with all bodies of its route so far, over many micro-batches."""
    http = HttpSource(timeout=90).route("POST", "/a").route("POST", "/b")

    def step(state, row):
        state["text"] += row["body"]
        return row["request_id"], state["text"]

    replies = live.stateful(http.stream(spark), ["path"], [], {"text": ""}, step, "text string", "request_id long, body string", position="nth")
    query = live.delivered(replies, http.reply)

    def ask(path, body):
        request = urllib.request.Request(f"http://127.0.0.1:{http.port}{path}", data=body.encode(), method="POST")
        return urllib.request.urlopen(request).read().decode()

    try:
        assert [ask("/a", "x"), ask("/b", "é"), ask("/a", "yz"), ask("/b", "")] == ["x", "é", "xyz", "é"]
        said = []
        clients = [threading.Thread(target=lambda n=n: said.append(ask("/a", str(n)))) for n in range(4)]
        for c in clients:
            c.start()
        for c in clients:
            c.join()
        # Whatever their order, each saw those before it and itself.
        said.sort(key=len)
        assert [len(s) for s in said] == [4, 5, 6, 7] and all(b.startswith(a) for a, b in zip(said, said[1:]))
    finally:
        query.stop()
        http.close()
    assert http.rows(spark).count() == 0


def test_stdin_lines_arrive_while_it_is_open(spark):
    read, write = os.pipe()
    source = Stdin(spark, os.fdopen(read, encoding="utf-8"))
    seen = []
    query = live.delivered(source.stream(), lambda df: seen.extend(map(tuple, df.collect())))
    try:
        os.write(write, "first\n".encode())
        until = time.monotonic() + 60
        while not seen and time.monotonic() < until:
            time.sleep(0.05)
        assert seen == [(0, "first")] and not source.wait(0)
        os.write(write, "\nzwölf \"quoted\"\nno line feed".encode())
        os.close(write)
        assert source.wait(60)
        query.processAllAvailable()
    finally:
        query.stop()
    want = [(0, "first"), (1, ""), (2, 'zwölf "quoted"'), (3, "no line feed")]
    assert sorted(seen) == want and bag(live.drained(source.stream())) == want


def test_stdin_without_lines(spark):
    source = Stdin(spark, io.StringIO(""))
    assert source.wait(60) and bag(live.drained(source.stream())) == []


def test_replies_are_matched_by_request(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "request_id long, body string").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = arriving(spark, str(tmp_path / "r"), "request_id long, body string")
    said = []
    live.replying(stream, lambda df: df.select("request_id", F.upper("body").alias("body")), lambda df: said.extend(map(tuple, df.collect())))
    assert sorted(said) == [(1, "A"), (2, "B")]


def test_windows_of_event_time(spark, tmp_path):
    for rows in ([(0, 1), (30, 2), (70, 4)], [(200, 8)], [(1000, 16)]):
        spark.createDataFrame(rows, "s long, v long").select(F.timestamp_seconds("s").alias("t"), "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))
    stream = arriving(spark, str(tmp_path / "w"), "t timestamp, v long")
    got = live.drained(live.windowed(stream, "t", "1 minute", "0 seconds", s=F.sum("v")))
    assert set(bag(got.select(F.unix_timestamp("start"), "s"))) <= {(0, 3), (60, 4), (180, 8), (960, 16)} and got.count() >= 3


def test_reads_see_the_writes_before_them(spark):
    """One client posts, another gets: each get has both variables of one snapshot."""
    from tidewell.operators.asof import asof_join
    from tidewell.operators.transact import Transactions

    posts = spark.createDataFrame([(1, "x"), (3, "y")], "at long, body string")
    gets = spark.createDataFrame([(0, "s"), (2, "s"), (9, "s")], "at long, store string")

    def post(tx, row):
        tx["a"] = row["body"]
        tx["b"] = row["body"]

    store = Transactions({"a": ("string", "a0"), "b": ("string", "b0")}).writer(posts, "at", ["a", "b"], post)
    log = store.log().select(F.lit("s").alias("store"), F.col("arrival").alias("at"), "tick", "a", "b")
    seen = asof_join(gets, log, "at", ["a", "b"], ["store"], write_order=["tick"])
    got = seen.select("at", F.concat(F.coalesce("a", F.lit("a0")), F.coalesce("b", F.lit("b0"))))
    assert bag(got) == [(0, "a0b0"), (2, "xx"), (9, "yy")]
