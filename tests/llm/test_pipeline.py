import corpus_pipeline as cp
from conftest import SMALL
from test_jaccard_join import plain

from tidewell.llm import decontaminate, jaccard_join, quality, toxicity
from tidewell.llm._util import read


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    columns, labels = docs.columns, read(spark, SMALL, "labels")
    assert [f for _, f in cp.STAGES] == [cp.keep_good, cp.keep_civil, cp.keep_distinct, cp.keep_unleaked, cp.pack]
    good = cp.keep_good(spark, docs, SMALL).cache()
    assert ids(good) == ids(quality.scored(docs, quality.train(docs, labels)).filter("selected"))
    civil = cp.keep_civil(spark, good, SMALL).cache()
    assert ids(civil) == ids(toxicity.scored(good, toxicity.train(good, labels)).filter("predicted = 0"))
    distinct = cp.keep_distinct(spark, civil, SMALL).cache()
    rows = [(r["doc_id"], r["text"]) for r in civil.collect()]
    assert ids(distinct) == sorted(d for d, _, c in plain(rows, 5, 80) if d == c)
    clean = cp.keep_unleaked(spark, distinct, SMALL).cache()
    bad = {r["doc_id"] for r in decontaminate.leaks(distinct, read(spark, SMALL, "benchmark")).collect()}
    assert ids(clean) == sorted(set(ids(distinct)) - bad)
    for df in (good, civil, distinct, clean):
        assert df.columns == columns and 0 < df.count() <= docs.count()
    assert {r["doc_id"] for r in cp.pack(spark, clean, SMALL).collect()} == set(ids(clean))


def test_run_equals_its_stages(spark):
    docs = read(spark, SMALL, "documents")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
    key = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    assert sorted(map(key, cp.run(spark, SMALL).collect())) == sorted(map(key, docs.collect()))


def test_repeated_ids_with_other_texts(spark):
    near = " ".join(f"w{k}" for k in range(40))
    rows = [(1, near), (2, near), (2, "quite other words than those of row one"), (2, None), (2, ""), (3, "p q r s t u"), (3, "v w x y z a"), (3, "v w x y z a"), (4, near[::-1]), (4, near[::-1] + " end"), (None, near)]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    got = cp.keep_distinct(spark, docs, SMALL)
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(left) == 8 and sum(d == 4 for d, _ in left) == 1
    assert sorted((x for x in left if x[0] != 4), key=str) == sorted([rows[0], *rows[2:7], rows[10]], key=str)


def test_unique_texts_of_repeated_ids_stay(spark):
    a, b = " ".join(f"w{k}" for k in range(40)), "quite other words than those of row one"
    docs = spark.createDataFrame([(1, a, 1, 2, 3), (2, a, 1, 2, 3), (2, b, 1, 2, 3), (5, b, 1, 2, 3), (7, "c " * 9, 4, 5, 6), (7, "c " * 9, 4, 5, 6)], "doc_id long, text string, _id long, _row long, _bad long")
    for n in (1, 5):  # the columns' places do not matter
        got = cp.keep_distinct(spark, docs.repartition(n), SMALL)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, a, 1, 2, 3), (2, b, 1, 2, 3), (7, "c " * 9, 4, 5, 6)]
    assert sorted(map(tuple, cp.keep_distinct(spark, docs.limit(3), SMALL).collect())) == [(1, a, 1, 2, 3), (2, b, 1, 2, 3)]
    assert sorted(map(tuple, cp.keep_unleaked(spark, docs.limit(3), SMALL).collect())) == sorted(map(tuple, docs.limit(3).collect()))


def test_near_copies_are_found_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SHARED", 1)
    base = [str(k) for k in range(60)]
    rows = [(k, " ".join(base[: k % 50] + [f"x{k % 7}"] + base[k % 50 + 1 :])) for k in range(120)] + [(500 + k, "copies of few words") for k in range(9)] + [(7, "another text of a repeated id")] * 2
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")  # any broadcast of a row fails, whatever the planner chose
    try:
        got = sorted((r["doc_id"], r["text"]) for r in cp.keep_distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    distinct = sorted(set(rows))
    assert got == sorted((d, t) for (d, t), (_, _, c) in zip(distinct, plain([(n, t) for n, (_, t) in enumerate(distinct)], 5, 80), strict=True) if distinct[c] == (d, t))


def test_clean_rows_of_a_leaking_id_stay(spark):
    item = max((r["text"] for r in read(spark, SMALL, "benchmark").collect()), key=len)
    docs = spark.createDataFrame([(1, "before " + item + " after"), (1, "quite other words than those of the item"), (1, None), (2, "")], "doc_id long, text string")
    got = cp.keep_unleaked(spark, docs, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()[1:]), key=str)


def test_odd_rows(spark):
    docs = read(spark, SMALL, "documents")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (None, "one two three four five six", "en", "s", 0), (-3, "same words here in this row", None, None, None), (-3, "same words here in this row", None, None, None)], docs.schema)
    out = cp.keep_distinct(spark, docs.limit(20).unionByName(extra), SMALL)
    got = [r["doc_id"] for r in out.filter("doc_id < 0 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([None, -1, -2, -3], key=str)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.filter("false"), SMALL).count() == 0
        stage(spark, extra, SMALL).collect()
