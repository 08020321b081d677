"""Literal inputs with known answers."""

import pytest
from conftest import SMALL, bag
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import refine, scalars
from tidewell.functions.variants import Variant, VariantError, option
from tidewell.operators import asof, bags, collection, fixpoint, fold
from tidewell.operators.aggregate import Groups, largest, total
from tidewell.operators.comprehend import Comprehension
from tidewell.operators.transact import Transactions, TransactionError, serial
from tidewell.plans.program import Program, ProgramError


def ints(spark, *items):
    return collection.literal(spark, items, "long", "v")


def test_filter_and_sum(spark):
    nation = spark.read.parquet(f"{SMALL}/nation.parquet")
    rows = [r.asDict() for r in nation.collect()]
    some = Comprehension(n=nation).where(lambda r: r.n.n_regionkey >= 3)
    assert some.select(k=lambda r: r.n.n_nationkey).agg(total("k")).first()[0] == sum(r["n_nationkey"] for r in rows if r["n_regionkey"] >= 3)
    assert bag(some.select(n=lambda r: r.n.n_name)) == sorted((r["n_name"],) for r in rows if r["n_regionkey"] >= 3)


def test_inner_join_drops_unmatched(spark):
    customers, orders = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("customer", "orders"))
    few = customers.filter("c_custkey % 3 = 1")
    got = Comprehension(c=few, o=orders).where(lambda r: r.c.c_custkey == r.o.o_custkey).select(n=lambda r: r.c.c_name, o=lambda r: r.o.o_orderkey)
    name = {r["c_custkey"]: r["c_name"] for r in few.collect()}
    assert bag(got) == sorted(((name[r["o_custkey"]], r["o_orderkey"]) for r in orders.collect() if r["o_custkey"] in name), key=str)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-6, 6), max_size=7), st.lists(st.integers(-6, 6), max_size=7))
def test_join_sums(spark, left, right):
    rows = lambda xs: spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "pos long, v long")
    for guard, holds in ((lambda r: r.x.v + 2 == r.y.v, lambda x, y: x + 2 == y), (lambda r: r.x.v * r.y.v > 3, lambda x, y: x * y > 3)):
        got = Comprehension(x=rows(left), y=rows(right)).where(guard).select(s=lambda r: r.x.v * 10 + r.y.v)
        assert bag(got) == sorted(((x * 10 + y,) for x in left for y in right if holds(x, y)), key=str)


def test_equality_is_a_hash_or_merge_join(spark):
    big = spark.range(10).withColumnRenamed("id", "v")
    plan = Comprehension(x=big, y=big).where(lambda r: r.x.v == r.y.v).select(s=lambda r: r.x.v)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups(spark):
    items = [(7 * k) % 11 - 4 for k in range(30)]
    by = Groups(ints(spark, *items), k=F.pmod(F.col("v"), F.lit(4)))
    assert bag(by.agg(s=total("v"))) == sorted((k, sum(x for x in items if x % 4 == k)) for k in {x % 4 for x in items})
    assert by.lookup_agg(3, s=total("v")).first()[0] == sum(x for x in items if x % 4 == 3)
    assert by.lookup_agg(77, s=total("v")).first()[0] == 0 and by.lookup(77).count() == 0
    assert bag(by.entries(F.col("v")).select("k", F.size("group"))) == sorted((k, sum(x % 4 == k for x in items)) for k in {x % 4 for x in items})


def test_empty_aggregates(spark):
    none = ints(spark, 1).filter("v > 5")
    assert none.agg(total("v"), largest("v")).first() == (0, scalars.INT_MIN)
    with pytest.raises(TypeError):
        largest("v", "boolean")


def test_division(spark):
    row = spark.range(1).select(scalars.int_div(F.lit(-7), F.lit(2)), scalars.floor_div(F.lit(-7), F.lit(2)), scalars.int_div(F.lit(7), F.lit(2)), scalars.floor_div(F.lit(7), F.lit(-2))).first()
    assert tuple(row) == (-3, -4, 3, -4)


def test_off_path_does_not_fault(spark):
    got = ints(spark, 0, 5).select(scalars.choose(F.col("v") != 0, scalars.int_div(F.lit(10), F.col("v")), F.lit(-1).cast("long")))
    assert bag(got) == [(-1,), (2,)]


def test_variants(spark):
    kind = Variant.of(some="long", other="long")
    one = spark.range(1)
    for tag, value, want in (("some", 7, 8), ("other", 5, 99)):
        assert one.select(kind.match(kind.make(tag, F.lit(value)), default=lambda: F.lit(99).cast("long"), some=lambda v: v + 1)).first()[0] == want
    inner = option("long")
    nested = Variant.of(some=inner.schema, none=None).make("some", inner.make("none"))
    got = one.select(nested.alias("v")).select("v.tag", "v.some.tag").first()
    assert tuple(got) == ("some", "none")
    for wrong in (lambda: kind.make("gone"), lambda: kind.make("some"), lambda: inner.make("none", F.lit(1)), lambda: kind.match(F.lit(1), some=lambda v: v), lambda: kind.match(F.lit(1), gone=lambda: 1)):
        with pytest.raises(VariantError):
            wrong()
    wide = kind.widened(Variant.of(third="string"))
    assert one.select(kind.upcast(kind.make("some", F.lit(1)), wide).alias("v")).select("v.tag", "v.third").first() == ("some", None)
    with pytest.raises(VariantError):
        kind.widened(Variant.of(some="string"))


def test_feeds(spark):
    feed = bags.Feed("x")
    feed << ints(spark, 1)
    feed << ints(spark, 1, 2, 3)
    assert [r[1] for r in bag(feed.read())] == [1, 1, 2, 3]
    with pytest.raises(bags.FeedError):
        feed.define(ints(spark, 1))
    with pytest.raises(bags.FeedError):
        bags.Feed().read()
    tied = bags.Feed().define(ints(spark, 4))
    with pytest.raises(bags.FeedError):
        tied.define(ints(spark, 4))
    loop = bags.Feed("loop")
    loop << (lambda: loop.read())
    with pytest.raises(bags.FeedError):
        loop.read()
    with pytest.raises(Exception, match="two arms"):
        bags.disjoint_union("pos", ints(spark, 1), ints(spark, 2)).collect()


def test_folds(spark):
    five = ints(spark, 1, 2, 3, 4, 5)
    zero = F.lit(0).cast("long")
    add = lambda acc, row: {"acc": acc["acc"] + row["v"]}
    assert fold.fold(five, ["pos"], {"acc": zero}, add).first()[0] == 15
    assert fold.fold(five.filter("v > 9"), ["pos"], {"acc": zero}, add).first()[0] == 0
    assert [r["t"] for r in fold.running(ints(spark, 1, 2, 3, 4), ["pos"], t=F.sum("v")).orderBy("pos").collect()] == [1, 3, 6, 10]
    two = fold.fold(ints(spark, 1, 2, 3), ["pos"], {"a": zero, "b": zero}, lambda s, r: {"a": s["a"] + 1, "b": s["b"] + 2}).first()
    assert tuple(two) == (3, 6)
    with pytest.raises(ValueError):
        fold.fold(five, ["pos"], {"acc": zero}, lambda s, r: {"other": s["acc"]})

    def step(state, row):
        state["x"] += row["v"]
        return (state["x"],) if row["v"] != 2 else None

    assert [r[0] for r in fold.scan(ints(spark, 1, 2, 3), ["pos"], {"x": 0}, step, "x long").collect()] == [1, 6]
    assert fold.last_or(five.filter("v > 9"), "v", "pos", -1).first()[0] == -1


def pool(spark, *writers, start=100, feeds=None):
    store = Transactions({"pool": ("long", start)}, feeds)
    for rows, body in writers:
        store.writer(ints(spark, *rows), "pos", ["pool"], body)
    return store


def take(tx, row):
    tx["pool"] -= row["v"]


def guarded(tx, row):
    if tx["pool"] < row["v"]:
        tx.deny()
    tx["pool"] -= row["v"]
    if "said" in tx._feeds:
        tx.reply("said", tx["pool"])


@pytest.mark.parametrize("writers", [[([7, 0, 31], take)], [([13], take), ([29], take)], [([3, 8], take), ([21, 17], take)], [([45, 70, 12], guarded), ([40], take)]])
def test_pool(spark, writers):
    order = sorted((k, n, x, body) for n, (rows, body) in enumerate(writers) for k, x in enumerate(rows)) if len({b for _, b in writers}) == 1 else [(k, n, x, writers[n][1]) for k, n, x in sorted((k, n, x) for n, (rows, _) in enumerate(writers) for k, x in enumerate(rows))]
    state, _ = serial({"pool": 90}, [(body, {"v": x}) for _, _, x, body in order], frozenset(["pool"]))
    assert pool(spark, *writers, start=90).await_final("pool").first()[0] == state["pool"]


def test_keys_without_a_commit_keep_the_initial_value(spark):
    rows = spark.createDataFrame([("a", 1, 500), ("b", 1, 20), (None, 1, 30), ("a", 2, 700)], "k string, pos long, v long")
    store = Transactions({"pool": ("long", 100)}, by="k").writer(rows, "pos", ["pool"], guarded)
    assert bag(store.await_final("pool")) == sorted([("a", 100), ("b", 80), (None, 70)], key=str)


def test_seeds(spark):
    seed = spark.createDataFrame([("a", 5), ("b", 50)], "k string, pool long")
    rows = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), ("b", 2, 30)], "k string, pos long, v long")
    keyed = Transactions({"pool": ("long", seed)}, by="k").writer(rows, "pos", ["pool"], guarded)
    assert bag(keyed.await_final("pool")) == [("a", 5), ("b", 11)]
    one = Transactions({"pool": ("long", seed.filter("k = 'b'"))}).writer(rows, "pos", ["pool"], guarded, position="v")
    assert one.await_final("pool").first()[0] == 2
    with pytest.raises(Exception, match="2 rows where one was meant"):
        Transactions({"pool": ("long", seed)}).writer(rows, "pos", ["pool"], guarded).await_final("pool").collect()
    with pytest.raises(TransactionError, match="lacks"):
        Transactions({"pool": ("long", seed.drop("k"))}, by="k")


def test_equal_arrivals_replay_alike(spark):
    rows = [("x", 1, k) for k in range(12)]

    def body(tx, row):
        tx["pool"] = tx["pool"] * 3 + row["v"]

    ends = set()
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        df = spark.createDataFrame(order, "k string, pos long, v long").repartition(3)
        ends.add(Transactions({"pool": ("long", 1)}).writer(df, "pos", ["pool"], body).await_final("pool").first()[0])
        by_position = Transactions({"pool": ("long", 1)}).writer(df, "pos", ["pool"], body, position="v").await_final("pool").first()[0]
        want = 1
        for k in range(12):
            want = want * 3 + k
        assert by_position == want
    assert len(ends) == 1


def test_choice_by_a_null_condition(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "v long, c boolean")
    got = bags.choose(F.col("c"), rows, rows.withColumn("v", -F.col("v")))
    assert sorted(r["v"] for r in got.collect()) == [-3, -2, 1]


def test_a_chain_of_many_hops(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)], "src long, dst long")
    assert fixpoint.reachable(edges).count() == 70 * 71 // 2
    step = lambda fresh: fresh.filter("dst < 12").selectExpr("src", "dst + 1 AS dst")
    assert fixpoint.fixpoint(spark.createDataFrame([(0, 0)], "src long, dst long"), step).count() == 13


def test_replies_have_ticks_of_commits(spark):
    got = pool(spark, ([70, 50], guarded), feeds={"said": "long"}).replies("said").select("tick", "value")
    assert bag(got) == [(1, 30)]


def test_spine_beside_false_guard_commits(spark):
    def body(tx, row):
        tx["pool"] += 1
        if tx["pool"] > 1000:
            tx["pool"] += 10

    assert pool(spark, ([0], body)).await_final("pool").first()[0] == 101


def test_no_commit_gives_the_initial_value(spark):
    store = pool(spark, ([500], guarded))
    assert store.await_final("pool").first()[0] == 100
    with pytest.raises(TransactionError):
        store.await_final("pool")
    with pytest.raises(TransactionError):
        store.writer(ints(spark, 1), "pos", ["pool"], take)


def test_cross_reads_and_read_your_writes(spark):
    def cross(tx, row):
        tx["b"] += tx["a"]
        tx["a"] += row["v"]

    def own(tx, row):
        tx["a"] += row["v"]
        tx["b"] = tx["a"]

    for body, a, want in ((cross, 5, 1119), (own, 0, 606)):
        store = Transactions({"a": ("long", a), "b": ("long", 0)}).writer(ints(spark, 1, 2, 3), "pos", ["a", "b"], body)
        last = store.log().orderBy(F.desc("tick")).first()
        assert last["a"] * 100 + last["b"] == want


def test_stores_are_partitioned(spark):
    store = Transactions({k: ("long", 0) for k in "abcd"})
    store.writer(ints(spark, 1), "pos", ["a", "b"], take).writer(ints(spark, 1), "pos", ["b", "c"], take)
    assert sorted(map(sorted, store.stores())) == [["a", "b", "c"], ["d"]]
    for wrong in (lambda: store.writer(ints(spark, 1), "pos", ["x"], take), lambda: store.writer(ints(spark, 1), "pos", [], take), lambda: store.replies("x"), lambda: Transactions({})):
        with pytest.raises(TransactionError):
            wrong()


def test_footprint_and_read_only_are_held(spark):
    def stray(tx, row):
        tx["b"] = 1

    with pytest.raises(Exception, match="footprint"):
        Transactions({"a": ("long", 0), "b": ("long", 0)}).writer(ints(spark, 1), "pos", ["a"], stray).log().collect()
    with pytest.raises(Exception, match="read-only"):
        Transactions({"pool": ("long", 0)}).writer(ints(spark, 1), "pos", ["pool"], take, read_only=True).log().collect()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 60), max_size=5), min_size=1, max_size=3))
def test_any_schedule_is_serial(spark, schedules):
    rows = [[(k, x) for k, x in enumerate(s)] for s in schedules]
    store = Transactions({"pool": ("long", 100)}, {"said": "long"})
    for own in rows:
        store.writer(spark.createDataFrame(own, "pos long, v long"), "pos", ["pool"], guarded)
    order = sorted((k, n, x) for n, own in enumerate(rows) for k, x in own)
    state, said = serial({"pool": 100}, [(guarded, {"v": x}) for _, _, x in order], frozenset(["pool"]), frozenset(["said"]))
    log = store.log().orderBy("tick").collect()
    assert [r["said"] for r in log] == [x["said"] for x in said]
    assert (log[-1]["pool"] if log else 100) == state["pool"]


def test_asof(spark):
    writes = spark.createDataFrame([(1, 1, "alice"), (1, 3, "bob")], "k long, t long, v string")
    reads = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 9), (2, 5)], "k long, t long")
    want = [(1, 0, None), (1, 1, "alice"), (1, 2, "alice"), (1, 9, "bob"), (2, 5, None)]
    assert bag(asof.asof_join(reads, writes, "t", ["v"], ["k"])) == want
    assert bag(asof.asof_join(reads, writes, "t", ["v"], ["k"], buckets="_t div 2")) == want


def test_pinned(spark):
    changes = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "k long, t long, x long")
    reads = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k long, t long")
    assert bag(asof.pinned(reads, changes, "t", ["k"], s=F.sum("x"))) == [(1, 1, 10), (1, 2, 30), (1, 3, 30)]
    assert bag(asof.pinned(reads, changes, "t", ["k"], inclusive=False, s=F.sum("x"))) == [(1, 1, None), (1, 2, 10), (1, 3, 30)]


def test_reachability(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 5)], "src long, dst long")
    assert bag(fixpoint.reachable(edges)) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4)]
    ring = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert bag(fixpoint.reachable(ring)) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_refinements(spark):
    @refine.contract(requires={"discount": refine.NON_NEGATIVE}, ensures=lambda r, price, discount: r <= price)
    def paid(price, discount):
        return price - discount

    assert spark.range(1).select(paid(price=100, discount=25)).first()[0] == 75
    with pytest.raises(refine.RefinementError):
        paid(price=100, discount=-1)
    with pytest.raises(Exception, match="x >= 0"):
        ints(spark, -1).select(paid(price=100, discount=F.col("v"))).collect()


def test_program_reports_all_faults(spark):
    program = Program(spark)
    program.sources.register("n", ints(spark, 1, 2), "v int")

    @program.output("good")
    def good(p):
        return p.sources["n"]

    @program.output("twice")
    def twice(p):
        return p["good"].select(F.col("v") * 2)

    assert set(program.build()) == {"good", "twice"}
    program.output("bad")(lambda p: p.sources["gone"])
    program.output("worse")(lambda p: p["nowhere"])
    with pytest.raises(ProgramError) as fault:
        program.build()
    assert set(fault.value.faults) == {"bad", "worse"}


def test_command_line(spark, tmp_path, capsys):
    from tidewell.__main__ import main

    file = tmp_path / "program.py"
    file.write_text("from tidewell.plans.program import Program\n\ndef program(spark):\n    p = Program(spark)\n    p.output('numbers')(lambda p: p.spark.range(3))\n    return p\n")
    main([str(file)])
    main([str(file), "--inspect"])
    (tmp_path / "sum.txt").write_text("sum([r.r_regionkey for r in region])")
    main([str(tmp_path / "sum.txt"), "--tables", SMALL])
    said = capsys.readouterr().out
    assert "|10   |" in said
    assert "== numbers ==" in said and "Physical Plan" in said
