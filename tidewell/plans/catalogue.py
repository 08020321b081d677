"""Queries over the driver's tables, at least one for each operator of the engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import refine, scalars
from tidewell.functions.variants import Variant, option
from tidewell.operators import asof, bags, collection, fixpoint, fold
from tidewell.operators.aggregate import Groups, largest, mean, size, total
from tidewell.operators.aggregate import least as smallest
from tidewell.operators.comprehend import Comprehension, generator
from tidewell.operators.transact import Transactions
from tidewell.plans.text import Text
from tidewell.sources.shared import shared_path
from tidewell.sources.tables import arriving, table
from tidewell.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def cents(x) -> object:
    """Exact integers of amounts with two decimals, so that sums do not depend on their order."""
    return F.round(F.col(x) * 100).cast("long") if isinstance(x, str) else F.round(x * 100).cast("long")


CENTS = "CAST(round({} * 100) AS BIGINT)"
PRICE, BALANCE, AMOUNT = CENTS.format("l_extendedprice"), CENTS.format("c_acctbal"), CENTS.format("o_totalprice")
VALUE = CENTS.format("value")


# --- filters, projections, scalars -------------------------------------------------------------


@query(f"SELECT CAST(coalesce(sum({PRICE}), 0) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_linestatus = 'F'")
def filter_sum(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.filter((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("l_linestatus") == "F")).agg(total(cents("l_extendedprice")).alias("revenue"))


@query("SELECT 'order ' || o_orderkey AS label, o_custkey * 2 + 1 AS odd, -o_orderkey AS negative FROM orders")
def map_project(spark, sf):
    return Comprehension(o=table(spark, sf, "orders")).select(label=lambda r: F.concat(F.lit("order "), r.o.o_orderkey.cast("string")), odd=lambda r: r.o.o_custkey * 2 + 1, negative=lambda r: -r.o.o_orderkey)


@query("SELECT n_name AS name, n_regionkey AS region, n_nationkey - n_regionkey AS apart FROM nation WHERE n_nationkey > 3 AND n_nationkey < 20")
def record_ctor(spark, sf):
    nation = table(spark, sf, "nation").select(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_nationkey").alias("_0"), F.col("n_regionkey").alias("_1")).alias("keys")).alias("r"))
    out = Comprehension(n=nation).where(lambda r: scalars.chain(F.lit(3), "<", r.n.r["keys"]["_0"], "<", F.lit(20)))
    return out.select(name=lambda r: r.n.r["name"], region=lambda r: r.n.r["keys"]["_1"], apart=lambda r: r.n.r["keys"]["_0"] - r.n.r["keys"]["_1"])


@query("SELECT (c_custkey - 500) // 7 AS truncated, CAST(floor((c_custkey - 500) / 7.0) AS BIGINT) AS floored, (c_nationkey > 5) <> (c_custkey > 10) AS differ, NOT (c_nationkey > 5 AND c_custkey > 10) AS nand, NOT (c_nationkey > 5 OR c_custkey > 10) AS nor, (c_nationkey > 5) = (c_custkey > 10) AS xnor FROM customer")
def scalar_functions(spark, sf):
    c = table(spark, sf, "customer")
    x, y, k = F.col("c_nationkey") > 5, F.col("c_custkey") > 10, F.col("c_custkey") - 500
    return c.select(scalars.int_div(k, F.lit(7)).alias("truncated"), scalars.floor_div(k, F.lit(7)).alias("floored"), scalars.xor(x, y).alias("differ"), scalars.nand(x, y).alias("nand"), scalars.nor(x, y).alias("nor"), scalars.xnor(x, y).alias("xnor"))


@query("SELECT c_custkey AS k, CAST(CASE WHEN c_nationkey <> 0 THEN 100 // c_nationkey ELSE 0 END AS BIGINT) AS share, (c_nationkey <> 0 AND 100 // (CASE WHEN c_nationkey = 0 THEN 1 ELSE c_nationkey END) > 10) AS large FROM customer")
def off_path_faults(spark, sf):
    n, hundred = F.col("c_nationkey"), F.lit(100)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), scalars.choose(n != 0, scalars.int_div(hundred, n), F.lit(0).cast("long")).alias("share"), scalars.both(n != 0, scalars.int_div(hundred, n) > 10).alias("large"))


@query("SELECT p_partkey AS k, p_size AS size FROM part WHERE p_size > 10 AND p_size < 20")
def literal_and_guards(spark, sf):
    bounds = collection.literal(spark, [(10, 20)], "low long, high long")
    return Comprehension(p=table(spark, sf, "part"), b=bounds).where(lambda r: r.p.p_size > r.b.low, lambda r: r.p.p_size < r.b.high).select(k=lambda r: r.p.p_partkey, size=lambda r: r.p.p_size)


@query("SELECT i AS pos, 10 - i AS value FROM range(0, 10) t(i)")
def list_positions(spark, sf):
    items = collection.literal(spark, [10 - i for i in range(10)], "long")
    return collection.zipped(collection.extent(spark, 10), items)


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def function_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return collection.lookup(n, F.col("n_regionkey"), table(spark, sf, "region"), "r_regionkey", "r_name", "region").drop("n_regionkey")


@query("SELECT n_regionkey AS region, len(list(n_nationkey)) AS n, list_sort(list(n_nationkey))[1] AS first FROM nation GROUP BY n_regionkey")
def inverted_index(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"))
    return collection.inverted(n, "key", "region").select("region", F.size("key").cast("long").alias("n"), scalars.at(F.col("key"), 0).alias("first"))


@query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_nationkey AS key FROM nation")
def flattened_groups(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"))
    return collection.flattened(collection.inverted(n, "key", "region"), "key", "region")


# --- joins -------------------------------------------------------------------------------------


@query(f"SELECT c_name AS name, {AMOUNT} AS amount FROM customer JOIN orders ON c_custkey = o_custkey")
def equi_join(spark, sf):
    return Comprehension(c=table(spark, sf, "customer"), o=table(spark, sf, "orders")).where(lambda r: r.c.c_custkey == r.o.o_custkey).select(name=lambda r: r.c.c_name, amount=lambda r: cents(r.o.o_totalprice))


@query("SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_custkey // 10 = s_suppkey + 1")
def computed_key_join(spark, sf):
    return Comprehension(c=table(spark, sf, "customer"), s=table(spark, sf, "supplier")).where(lambda r: scalars.int_div(r.c.c_custkey, F.lit(10)) == r.s.s_suppkey + 1).select(c=lambda r: r.c.c_custkey, s=lambda r: r.s.s_suppkey)


@query("SELECT c_custkey AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def three_way_join(spark, sf):
    out = Comprehension(c=table(spark, sf, "customer"), n=table(spark, sf, "nation"), r=table(spark, sf, "region"))
    return out.where(lambda t: t.n.n_nationkey == t.c.c_nationkey, lambda t: t.n.n_regionkey == t.r.r_regionkey, lambda t: t.r.r_name != "ASIA").select(c=lambda t: t.c.c_custkey, nation=lambda t: t.n.n_name, region=lambda t: t.r.r_name)


@query("SELECT o_orderkey AS o, l_linenumber AS l FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_linenumber <> 1")
def join_residual(spark, sf):
    return Comprehension(o=table(spark, sf, "orders"), l=table(spark, sf, "lineitem")).where(lambda r: r.o.o_orderkey == r.l.l_orderkey, lambda r: r.l.l_shipdate > r.o.o_orderdate, lambda r: r.l.l_linenumber != 1).select(o=lambda r: r.o.o_orderkey, l=lambda r: r.l.l_linenumber)


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def self_join(spark, sf):
    n = table(spark, sf, "nation")
    return Comprehension(a=n, b=n).where(lambda r: r.a.n_nationkey < r.b.n_nationkey, lambda r: r.a.n_regionkey == r.b.n_regionkey).select(a=lambda r: r.a.n_name, b=lambda r: r.b.n_name)


@query("SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey < n_regionkey")
def theta_join(spark, sf):
    return Comprehension(r=table(spark, sf, "region"), n=table(spark, sf, "nation")).where(lambda t: t.r.r_regionkey < t.n.n_regionkey).select(r=lambda t: t.r.r_name, n=lambda t: t.n.n_name)


@query("SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey <= n_regionkey AND r_regionkey >= n_regionkey")
def range_style_join(spark, sf):
    return Comprehension(r=table(spark, sf, "region"), n=table(spark, sf, "nation")).where(lambda t: t.r.r_regionkey <= t.n.n_regionkey, lambda t: t.r.r_regionkey >= t.n.n_regionkey).select(r=lambda t: t.r.r_name, n=lambda t: t.n.n_name)


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey + b.n_nationkey = 20")
def spanning_equality(spark, sf):
    n = table(spark, sf, "nation")
    return Comprehension(a=n, b=n).where(lambda r: r.a.n_nationkey + r.b.n_nationkey == 20).select(a=lambda r: r.a.n_nationkey, b=lambda r: r.b.n_nationkey)


@query("SELECT r_name || '/' || n_name AS pair FROM region CROSS JOIN nation")
def cross_join(spark, sf):
    return Comprehension(r=table(spark, sf, "region"), n=table(spark, sf, "nation")).select(pair=lambda t: F.concat(t.r.r_name, F.lit("/"), t.n.n_name))


@query("SELECT p_name AS part, s_name AS supplier, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 5")
def bridge_join(spark, sf):
    out = Comprehension(p=table(spark, sf, "part"), l=table(spark, sf, "lineitem"), s=table(spark, sf, "supplier"))
    return out.where(lambda r: r.s.s_suppkey == r.l.l_suppkey, lambda r: r.l.l_partkey == r.p.p_partkey, lambda r: r.p.p_size < 5).select(part=lambda r: r.p.p_name, supplier=lambda r: r.s.s_name, line=lambda r: r.l.l_linenumber)


@query("SELECT big.o_orderkey AS o, rich.c_name AS c FROM (SELECT * FROM orders WHERE o_totalprice > 200000) big JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) rich ON big.o_custkey = rich.c_custkey")
def derived_join(spark, sf):
    big = Comprehension(o=table(spark, sf, "orders")).where(lambda r: r.o.o_totalprice > 200000).select("o")
    rich = Comprehension(c=table(spark, sf, "customer")).where(lambda r: r.c.c_acctbal > 5000).select("c")
    return Comprehension(b=big, c=rich).where(lambda r: r.b.o_custkey == r.c.c_custkey).select(o=lambda r: r.b.o_orderkey, c=lambda r: r.c.c_name)


@query("SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def membership(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("c")).join(urgent, "c", "left_semi")


@query(f"SELECT e.event_id AS event_id, e.user_id AS user_id, coalesce(p.event_id, -1) AS last_id, coalesce({CENTS.format('p.value')}, -1) AS last_value FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase'")
def asof_latest_event(spark, sf):
    e = table(spark, sf, "events")
    writes = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"), cents("value").alias("last_value"))
    found = asof.asof_join(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), writes, "ts", ["last_id", "last_value"], ["user_id"], write_order=["last_id"])
    return found.select("event_id", "user_id", F.coalesce("last_id", F.lit(-1)).alias("last_id"), F.coalesce("last_value", F.lit(-1)).alias("last_value"))


@query(f"SELECT e.event_id AS event_id, (SELECT CAST(coalesce(sum({CENTS.format('p.value')}), 0) AS BIGINT) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts < e.ts) AS spent FROM events e WHERE e.event_type <> 'purchase'")
def time_pinned_sum(spark, sf):
    e = table(spark, sf, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", cents("value").alias("amount"))
    return asof.pinned(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "ts", ["user_id"], inclusive=False, spent=F.sum("amount")).select("event_id", F.coalesce("spent", F.lit(0).cast("long")).alias("spent"))


# --- aggregates and groups ---------------------------------------------------------------------


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum({PRICE}) AS BIGINT) AS revenue, max(l_linenumber) AS last_line, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem GROUP BY ALL")
def group_multi_agg(spark, sf):
    groups = Groups(table(spark, sf, "lineitem"), l_returnflag=F.col("l_returnflag"), l_linestatus=F.col("l_linestatus"))
    return groups.agg(sum_qty=total(F.col("l_quantity").cast("long")), revenue=total(cents("l_extendedprice")), last_line=largest("l_linenumber", "int"), first_line=smallest("l_linenumber"), n=size())


@query(f"SELECT o_orderpriority AS priority, CAST(sum({AMOUNT}) AS BIGINT) AS amount FROM orders GROUP BY ALL")
def group_sum(spark, sf):
    return Groups(table(spark, sf, "orders"), priority=F.col("o_orderpriority")).agg(amount=total(cents("o_totalprice")))


@query("SELECT CAST(c_nationkey // 5 AS BIGINT) AS bucket, max(c_name) AS last_name, max(c_custkey) AS last_key FROM customer GROUP BY ALL")
def group_max(spark, sf):
    return Groups(table(spark, sf, "customer"), bucket=scalars.int_div(F.col("c_nationkey"), F.lit(5))).agg(last_name=largest("c_name", "string"), last_key=largest("c_custkey"))


@query("SELECT o_custkey // 100 AS bucket, count(*) AS n, avg(o_orderkey) AS middle FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def group_of_filtered(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return Groups(done, bucket=scalars.int_div(F.col("o_custkey"), F.lit(100))).agg(n=size(), middle=mean("o_orderkey"))


@query(f"SELECT (SELECT CAST(coalesce(sum({BALANCE}), 0) AS BIGINT) FROM customer WHERE c_nationkey = 7) AS seven, (SELECT CAST(coalesce(sum({BALANCE}), 0) AS BIGINT) FROM customer WHERE c_nationkey = 99) AS missing")
def group_lookup(spark, sf):
    groups = Groups(table(spark, sf, "customer"), nation=F.col("c_nationkey"))
    return groups.lookup_agg(7, seven=total(cents("c_acctbal"))).crossJoin(groups.lookup_agg(99, missing=total(cents("c_acctbal"))))


@query("SELECT p_partkey AS k, p_size + (SELECT max(p_size) FROM part) AS above FROM part")
def nested_agg_in_element(spark, sf):
    part = table(spark, sf, "part")
    return collection.with_scalar(part, part.agg(largest("p_size", "int").alias("top")), top="top").select(F.col("p_partkey").alias("k"), (F.col("p_size") + F.col("top")).alias("above"))


@query("SELECT CAST(0 AS BIGINT) AS total, CAST(-9223372036854775808 AS BIGINT) AS largest, '' AS longest, CAST(count(*) AS BIGINT) AS n FROM region WHERE r_regionkey > 1000")
def empty_aggregates(spark, sf):
    return table(spark, sf, "region").filter("r_regionkey > 1000").agg(total("r_regionkey").alias("total"), largest("r_regionkey").alias("largest"), largest("r_name", "string").alias("longest"), size().alias("n"))


@query("SELECT CAST(sum(k) AS BIGINT) AS total FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def agg_of_union(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    k = c.select(F.col("c_custkey").alias("k"), "c_nationkey")
    return bags.union(k.select("k"), s, k.filter("c_nationkey = 1").select("k")).agg(total("k").alias("total"))


# --- bags, feeds, conditions, variants ---------------------------------------------------------


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def bag_union(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return bags.union(n, table(spark, sf, "region").select(F.col("r_name").alias("name")), n)


@query("SELECT 'n' AS arm, n_nationkey AS k FROM nation UNION ALL SELECT 'r', r_regionkey FROM region")
def tagged_union(spark, sf):
    return bags.tagged_union(n=table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), r=table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def disjoint_union(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return bags.disjoint_union("k", n.filter("k < 10"), n.filter("k >= 10"))


@query("SELECT event_id AS id, 'early' AS kind FROM events WHERE event_id < 100 UNION ALL SELECT event_id, 'purchase' FROM events WHERE event_id >= 100 AND event_type = 'purchase' UNION ALL SELECT event_id, 'other' FROM events WHERE event_id >= 100 AND event_type <> 'purchase' UNION ALL SELECT -1, 'mark'")
def feed_routes(spark, sf):
    e, feed = table(spark, sf, "events"), bags.Feed("routes")
    kind = lambda k: lambda rows: rows.select(F.col("event_id").alias("id"), F.lit(k).alias("kind"))
    feed.put_if(e, (F.col("event_id") < 100, kind("early")), (F.col("event_type") == "purchase", kind("purchase")), (None, kind("other")))
    feed << spark.createDataFrame([(-1, "mark")], "id long, kind string")
    return feed.read()


@query("SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 300 WHEN p_size > 20 THEN 200 ELSE 100 END AS fee FROM part")
def cond_element(spark, sf):
    size_ = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), scalars.cases((size_ > 40, F.lit(300)), (size_ > 20, F.lit(200)), otherwise=F.lit(100)).alias("fee"))


@query("SELECT n_name AS name FROM nation WHERE (SELECT count(*) FROM region) > 3")
def cond_collection(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    gate = collection.with_scalar(n, table(spark, sf, "region").agg(size().alias("n")), many="n")
    none = gate.filter(F.lit(False))
    return bags.choose(F.col("many") > 3, gate, none).drop("many")


@query(f"SELECT event_id, CASE event_type WHEN 'purchase' THEN {VALUE} WHEN 'click' THEN length(props) ELSE 0 END AS score FROM events")
def variant_build_match(spark, sf):
    kind = Variant.of(bought="long", clicked="string", other=None)
    e = table(spark, sf, "events")
    made = F.when(F.col("event_type") == "purchase", kind.make("bought", cents("value"))).when(F.col("event_type") == "click", kind.make("clicked", F.col("props"))).otherwise(kind.make("other"))
    return e.select("event_id", made.alias("v")).select("event_id", kind.match(F.col("v"), bought=lambda v: v, clicked=lambda s: F.length(s).cast("long"), other=lambda: F.lit(0).cast("long")).alias("score"))


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_custkey + 1 ELSE 0 END AS next FROM customer")
def option_match(spark, sf):
    kind = option("long")
    v = F.when(F.col("c_acctbal") > 0, kind.make("some", F.col("c_custkey"))).otherwise(kind.make("none"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), v.alias("v")).select("k", kind.match(F.col("v"), default=lambda: F.lit(0).cast("long"), some=lambda x: x + 1).alias("next"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, CAST(1000 // l_linenumber AS BIGINT) AS share FROM lineitem WHERE l_linenumber <> 0")
def refined_division(spark, sf):
    @refine.contract(requires={"by": refine.NON_ZERO})
    def share(by):
        return scalars.int_div(F.lit(1000), by)

    lines = refine.NON_ZERO.acquire(table(spark, sf, "lineitem"), "l_linenumber")
    return lines.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), share(by=F.col("l_linenumber")).alias("share"))


@query("SELECT CAST(max(sq) AS BIGINT) AS top FROM (SELECT (p_size - 20) * (p_size - 20) AS sq FROM part WHERE p_size > 20)")
def generator_pipeline(spark, sf):
    run = generator(lambda df: df.filter(F.col("p_size") > 20), lambda df: df.select((F.col("p_size") - 20).alias("x")), lambda df: df.select((F.col("x") * F.col("x")).alias("sq")))
    return run(table(spark, sf, "part")).agg(largest("sq").alias("top"))


@query("SELECT n_nationkey AS k, unnest([n_nationkey, n_nationkey * 10]) AS x FROM nation")
def multi_row_generator(spark, sf):
    return Comprehension(n=table(spark, sf, "nation")).flat(x=lambda r: F.array(r.n.n_nationkey, r.n.n_nationkey * 10), k=lambda r: r.n.n_nationkey)


# --- folds -------------------------------------------------------------------------------------


@query(f"SELECT event_id, CAST(sum({VALUE}) OVER w AS BIGINT) AS total, CAST(sum(CASE WHEN event_type = 'purchase' THEN {VALUE} ELSE 0 END) OVER w AS BIGINT) AS bought, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_total(spark, sf):
    e = table(spark, sf, "events").withColumn("cents", cents("value"))
    out = fold.running(e, ["ts", "event_id"], ["user_id"], total=F.sum("cents"), bought=fold.running_if(F.col("event_type") == "purchase", F.col("cents")))
    return out.withColumn("before", fold.previous("event_id", ["ts", "event_id"], -1, ["user_id"])).select("event_id", "total", "bought", "before")


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS last_bought FROM events")
def carried_forward(spark, sf):
    e = table(spark, sf, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return e.select("event_id", fold.carried("bought", ["ts", "event_id"], ["user_id"], default=-1).alias("last_bought"))


@query("SELECT o_custkey AS c, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY ALL")
def last_value(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("last_order"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return fold.last_or(o, "last_order", "at", -1, ["c"])


CAP = 50_000
FOLD_SQL = f"""
WITH RECURSIVE e AS (SELECT user_id, {VALUE} AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, CASE WHEN cents <= {CAP} THEN cents ELSE 0 END AS acc, CASE WHEN cents <= {CAP} THEN 1 ELSE 0 END AS taken FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, CASE WHEN f.acc + e.cents <= {CAP} THEN f.acc + e.cents ELSE f.acc END, CASE WHEN f.acc + e.cents <= {CAP} THEN f.taken + 1 ELSE f.taken END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
"""


@query(FOLD_SQL + "SELECT user_id, CAST(max_by(acc, n) AS BIGINT) AS acc, CAST(max_by(taken, n) AS BIGINT) AS taken FROM f GROUP BY user_id")
def ordered_fold_nonassoc(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", cents("value").alias("cents"))

    def step(acc, row):
        fits = acc["acc"] + row["cents"] <= CAP
        return {"acc": F.when(fits, acc["acc"] + row["cents"]).otherwise(acc["acc"]), "taken": F.when(fits, acc["taken"] + 1).otherwise(acc["taken"])}

    zero = F.lit(0).cast("long")
    return fold.fold(e, ["ts", "event_id"], {"acc": zero, "taken": zero}, step, by=["user_id"])


@query(FOLD_SQL + "SELECT user_id, CAST(n AS BIGINT) AS n, CAST(acc AS BIGINT) AS acc FROM f")
def ordered_scan(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", cents("value").alias("cents"))

    def step(state, row):
        state["n"] += 1
        if state["acc"] + row["cents"] <= CAP:
            state["acc"] += row["cents"]
        return state["n"], state["acc"]

    return fold.scan(e, ["ts", "event_id"], {"n": 0, "acc": 0}, step, "n long, acc long", by=["user_id"])


# --- transactions ------------------------------------------------------------------------------


def _purse(spark, sf) -> Transactions:
    """Every event of a user deposits or, for a purchase, withdraws what the user's purse covers."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("at"), cents("value").alias("cents"))

    def deposit(tx, row):
        tx["purse"] += row["cents"] // 2

    def buy(tx, row):
        if tx["purse"] < row["cents"]:
            tx.deny()
        tx["purse"] -= row["cents"]
        tx["bought"] += 1
        tx.reply("receipt", tx["purse"])

    store = Transactions({"purse": ("long", 10_000), "bought": ("long", 0)}, {"receipt": "long"}, by="user_id")
    store.writer(e.filter("event_type <> 'purchase'"), "at", ["purse"], deposit)
    return store.writer(e.filter("event_type = 'purchase'"), "at", ["purse", "bought"], buy)


TXN_SQL = f"""
WITH RECURSIVE e AS (SELECT user_id, event_type = 'purchase' AS buys, {VALUE} AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(10000 AS BIGINT) AS purse, CAST(0 AS BIGINT) AS bought, CAST(0 AS BIGINT) AS tick, false AS did FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, CASE WHEN NOT e.buys THEN f.purse + e.cents // 2 WHEN f.purse >= e.cents THEN f.purse - e.cents ELSE f.purse END,
CASE WHEN e.buys AND f.purse >= e.cents THEN f.bought + 1 ELSE f.bought END, CASE WHEN e.buys AND f.purse < e.cents THEN f.tick ELSE f.tick + 1 END, e.buys AND f.purse >= e.cents FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
"""


@query(TXN_SQL + "SELECT user_id, max_by(purse, n) AS purse, max_by(bought, n) AS bought FROM f GROUP BY user_id")
def txn_final_balance(spark, sf):
    store = _purse(spark, sf)
    log = store.committed()
    return store.await_final("purse", log).join(store.await_final("bought", log), "user_id")


@query(TXN_SQL + "SELECT user_id, tick, purse AS value FROM f WHERE did")
def txn_grant_deny_replies(spark, sf):
    store = _purse(spark, sf)
    return store.replies("receipt").select(F.col("key").alias("user_id"), "tick", "value")


@query("SELECT CAST(100 - 2 * (SELECT count(*) FROM region) AS BIGINT) AS pool, CAST((SELECT sum(n_nationkey) FROM nation) AS BIGINT) AS seen")
def txn_independent_stores(spark, sf):
    def take(tx, row):
        tx["pool"] -= 1

    def see(tx, row):
        tx["seen"] += row["n_nationkey"]

    store = Transactions({"pool": ("long", 100), "seen": ("long", 0)})
    r = table(spark, sf, "region")
    store.writer(r, "r_regionkey", ["pool"], take).writer(r, "r_regionkey", ["pool"], take).writer(table(spark, sf, "nation"), "n_nationkey", ["seen"], see)
    log = store.committed()
    return store.await_final("pool", log).crossJoin(store.await_final("seen", log))


# --- recursion ---------------------------------------------------------------------------------


@query("WITH RECURSIVE hop AS (SELECT n_nationkey AS src, (n_nationkey * 7 + n_regionkey) % 25 AS dst FROM nation), r AS (SELECT src, dst FROM hop UNION SELECT r.src, hop.dst FROM r JOIN hop ON r.dst = hop.src) SELECT src, dst FROM r")
def reachability(spark, sf):
    n = table(spark, sf, "nation")
    return fixpoint.reachable(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("dst")))


# --- programs as text --------------------------------------------------------------------------


@query("SELECT c_name AS name, o_orderkey AS key FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderkey > 10")
def text_join(spark, sf):
    text = Text(spark, customer=table(spark, sf, "customer"), orders=table(spark, sf, "orders"))
    return text.run("[rec(name=c.c_name, key=o.o_orderkey) for c in customer for o in orders if c.c_custkey == o.o_custkey if o.o_orderstatus == 'F' and o.o_orderkey > 10]")


@query("SELECT n_regionkey AS region, CAST(sum(n_nationkey) AS BIGINT) AS keys, max(n_name) AS last FROM nation GROUP BY n_regionkey HAVING count(*) > 2")
def text_groups(spark, sf):
    return Text(spark, nation=table(spark, sf, "nation")).run("[rec(region=key(g), keys=sum([n.n_nationkey for n in g]), last=max([n.n_name for n in g])) for g in groupby(nation, lambda n: n.n_regionkey) if count(g) > 2]")


def _text(spark, sf, *names: str) -> Text:
    """Tables as sources, with positions where the first column is a key from 0."""
    rows = {n: table(spark, sf, n) for n in names}
    return Text(spark, **{n: df.withColumn("pos", F.col(df.columns[0]).cast("long")) if n in ("nation", "region") else df for n, df in rows.items()})


@query("SELECT p_partkey AS k, CAST(CASE WHEN p_size > 40 THEN p_size * 10 ELSE 1 END AS BIGINT) AS fee FROM part")
def text_variants(spark, sf):
    return _text(spark, sf, "part").run("""
def sized(p):
    return `big(p.p_size) if p.p_size > 40 else `small

def fee(v):
    match v:
        case `big(n): n * 10
        case `small: 1

[rec(k=p.p_partkey, fee=fee(sized(p))) for p in part]
""")


@query("SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS label FROM part")
def text_functions(spark, sf):
    return _text(spark, sf, "part").run("""
def label(p):
    if p.p_size > 40:
        return "large"
    found = "medium" if p.p_size > 20 else "small"
    return found

[rec(k=p.p_partkey, label=label(p)) for p in part]
""")


@query("SELECT 'high' AS side, CAST(c_custkey AS BIGINT) AS k FROM customer WHERE c_custkey > 75 UNION ALL SELECT 'low', CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey > 10 AND c_custkey <= 75 UNION ALL SELECT 'low', CAST(0 AS BIGINT)")
def text_feeds(spark, sf):
    return _text(spark, sf, "customer").run("""
low = defer()
high = defer()
for c in customer:
    if c.c_custkey > 75:
        high << c.c_custkey
    elif c.c_custkey > 10:
        low << c.c_custkey
low << 0
[rec(side="high", k=k) for k in high] ++ [rec(side="low", k=k) for k in low]
""")


@query("SELECT CAST(o_custkey AS BIGINT) AS c FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 100 UNION ALL SELECT CAST(-o_custkey AS BIGINT) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 100")
def text_generator(spark, sf):
    return _text(spark, sf, "orders").run("""
def open_orders(os, least: Int):
    for o in os:
        if o.o_orderstatus == "O" and o.o_orderkey > least:
            yield o.o_custkey
            yield 0 - o.o_custkey

[rec(c=c) for c in open_orders(orders, 100)]
""")


@query("WITH RECURSIVE f AS (SELECT CAST(-1 AS BIGINT) AS i, CAST(7 AS BIGINT) AS acc UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(CASE WHEN n_regionkey = 1 THEN acc * 3 - n_nationkey ELSE acc + 1 END AS BIGINT) FROM f JOIN nation ON n_nationkey = i + 1) SELECT max_by(acc, i) AS value FROM f")
def text_ordered_fold(spark, sf):
    return _text(spark, sf, "nation").run("""
acc := 7
for n in nation:
    if n.n_regionkey == 1:
        acc = acc * 3 - n.n_nationkey
    else:
        acc += 1
acc
""")


@query("SELECT CAST(sum(o_custkey) * 1000 + count(*) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'F'")
def text_sums(spark, sf):
    return _text(spark, sf, "orders").run("""
n = 0
keys = 0
for o in orders:
    if o.o_orderstatus == "F":
        n += 1
        keys += o.o_custkey
keys * 1000 + n
""")


POOL_SQL = """
WITH RECURSIVE ops AS (SELECT n_nationkey AS pos, 0 AS w, 2 * n_nationkey AS amount, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 1, r_regionkey, NULL FROM region),
o AS (SELECT *, row_number() OVER (ORDER BY pos, w) AS i FROM ops),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(200 AS BIGINT) AS pool, false AS did, CAST(NULL AS VARCHAR) AS name
UNION ALL SELECT o.i, CAST(CASE WHEN w = 1 THEN pool + amount WHEN pool >= amount THEN pool - amount ELSE pool END AS BIGINT), w = 0 AND pool >= amount, o.name FROM f JOIN o ON o.i = f.i + 1)
"""
POOL_TEXT = """
pool: Mut(Int, Txn) := 200
granted: Mut(Int, Txn) := 0
said = defer()
for n in nation:
    with begin():
        if pool >= n.n_nationkey * 2:
            pool -= n.n_nationkey * 2
            granted += 1
            said << rec(nation=n.n_name, rest=pool)
for r in region:
    with begin():
        pool += r.r_regionkey
"""


@query(POOL_SQL + "SELECT name AS nation, pool AS rest FROM f WHERE did")
def text_transactions(spark, sf):
    return _text(spark, sf, "nation", "region").run(POOL_TEXT + "[rec(nation=s.nation, rest=s.rest) for s in said]")


@query(POOL_SQL + "SELECT CAST(max_by(pool, i) * 100 + count(*) FILTER (did) AS BIGINT) AS value FROM f")
def text_await_final(spark, sf):
    return _text(spark, sf, "nation", "region").run(POOL_TEXT + "await_final(pool) * 100 + await_final(granted)")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 2")
def text_tuples(spark, sf):
    return _text(spark, sf, "nation").run("""
pairs = [(n.n_nationkey, n.n_name) for n in nation if n.n_regionkey == 2]
[rec(k=k, name=name) for k, name in pairs]
""")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
def text_cond_collection(spark, sf):
    return _text(spark, sf, "nation").run("""
def names(of):
    [rec(name=n.n_name) for n in nation if n.n_regionkey == of]

names(1) if count(nation) > 20 else names(2)
""")


# --- operators on their own --------------------------------------------------------------------


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def feed_defined(spark, sf):
    feed = bags.Feed("late")
    return feed.define(lambda: table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))).read()


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (event_type = 'signup') AS joined, count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS other FROM events GROUP BY user_id")
def txn_routing(spark, sf):
    def route(tx, row):
        if row["event_type"] == "purchase":
            tx["bought"] += 1
        elif row["event_type"] == "signup":
            tx["joined"] += 1
        else:
            tx["other"] += 1

    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    names = ["bought", "joined", "other"]
    store = Transactions({n: ("long", 0) for n in names}, by="user_id").writer(e, "event_id", names, route)
    log = store.committed()
    a, b, c = (store.await_final(n, log) for n in names)
    return a.join(b, "user_id").join(c, "user_id")


@query("SELECT n_regionkey AS region, CAST(sum(n_nationkey) AS BIGINT) AS mirror FROM nation GROUP BY n_regionkey")
def txn_read_your_writes(spark, sf):
    def body(tx, row):
        tx["seen"] += row["n_nationkey"]
        tx["mirror"] = tx["seen"]

    n = table(spark, sf, "nation").withColumn("region", F.col("n_regionkey"))
    return Transactions({"seen": ("long", 0), "mirror": ("long", -1)}, by="region").writer(n, "n_nationkey", ["seen", "mirror"], body).await_final("mirror")


@query("SELECT r_regionkey AS region, CAST(10 + (SELECT sum(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) - r_regionkey AS BIGINT) AS pool FROM region")
def txn_phases(spark, sf):
    """The second store starts from what the first one ended with."""

    def add(tx, row):
        tx["pool"] += row["n_nationkey"]

    def take(tx, row):
        tx["pool"] -= row["r_regionkey"]

    n, r = table(spark, sf, "nation").withColumn("region", F.col("n_regionkey")), table(spark, sf, "region").withColumn("region", F.col("r_regionkey"))
    first = Transactions({"pool": ("long", 10)}, by="region").writer(n, "n_nationkey", ["pool"], add)
    second = Transactions({"pool": ("long", first.await_final("pool"))}, by="region").writer(r, "r_regionkey", ["pool"], take)
    return second.await_final("pool")


@query("SELECT CAST(sum(run) AS BIGINT) AS seen FROM (SELECT sum(n_nationkey) OVER (ORDER BY n_nationkey) AS run FROM nation)")
def txn_reads_running(spark, sf):
    """A transaction that reads a running sum of its loop."""

    def body(tx, row):
        tx["seen"] += row["run"]

    rows = fold.running(table(spark, sf, "nation"), ["n_nationkey"], run=F.sum("n_nationkey"))
    return Transactions({"seen": ("long", 0)}).writer(rows, "n_nationkey", ["seen"], body).await_final("seen")


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY n_regionkey")
def compound_accumulator(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias("key"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("keys"))
    step = lambda acc, row: {"acc": F.struct((acc["acc"]["n"] + 1).alias("n"), (acc["acc"]["keys"] + row["key"]).alias("keys"))}
    return fold.fold(n, ["key"], {"acc": zero}, step, by=["region"]).select("region", "acc.n", "acc.keys")


@query("SELECT r_regionkey AS r, CAST(i AS BIGINT) AS i FROM region, range(3) t(i)")
def product_domain(spark, sf):
    return collection.product(table(spark, sf, "region").select(F.col("r_regionkey").alias("r")), collection.extent(spark, 3).withColumnRenamed("pos", "i"))


@query("SELECT n_nationkey AS k, CAST((SELECT count(*) FROM nation) AS BIGINT) AS n FROM nation")
def one_row_value(spark, sf):
    n = table(spark, sf, "nation")
    return collection.with_scalar(n.select(F.col("n_nationkey").alias("k")), n.agg(size().alias("n")), n="n")


@query("SELECT p_partkey AS k, p_size - p_size // 4 AS paid FROM part")
def contract_checked(spark, sf):
    @refine.contract(requires={"discount": refine.NON_NEGATIVE}, ensures=lambda r, price, discount: r <= price)
    def paid(price, discount):
        return price - discount

    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), paid(price=F.col("p_size"), discount=scalars.int_div(F.col("p_size"), F.lit(4))).alias("paid"))


# --- streams -----------------------------------------------------------------------------------


def _events(spark, sf) -> DataFrame:
    static = table(spark, sf, "events")
    return arriving(spark, f"{sf}/event[s].parquet", static.schema)  # a pattern, for the table may be one file


@query(f"SELECT event_id, '> ' || event_type AS line, {VALUE} AS cents FROM events WHERE value > 10")
def stream_filter_map(spark, sf):
    e = _events(spark, sf)
    return live.drained(Comprehension(e=e).where(lambda r: r.e.value > 10).select(event_id=lambda r: r.e.event_id, line=lambda r: F.concat(F.lit("> "), r.e.event_type), cents=lambda r: cents(r.e.value)))


@query(f"SELECT event_type, count(*) AS n, CAST(sum({VALUE}) AS BIGINT) AS cents FROM events GROUP BY event_type")
def stream_terminal_group(spark, sf):
    return live.terminal(_events(spark, sf), lambda df: Groups(df, event_type=F.col("event_type")).agg(n=size(), cents=total(cents("value"))))


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'signup'")
def stream_join(spark, sf):
    buys = _events(spark, sf).filter("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("event_id").alias("a"))
    joins = _events(spark, sf).filter("event_type = 'signup'").select(F.col("user_id").alias("v"), F.col("event_id").alias("b"))
    return live.drained(live.bounded_join(buys, joins, F.expr("u = v")).select("a", "b"))


@query("SELECT e.event_id AS event_id, c_name AS name FROM events e JOIN customer ON c_custkey = e.user_id")
def stream_static_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return live.drained(_events(spark, sf).join(c, "user_id").select("event_id", "name"))


@query(FOLD_SQL + "SELECT user_id, CAST(n AS BIGINT) AS n, CAST(acc AS BIGINT) AS acc FROM f")
def stream_running_state(spark, sf):
    e = _events(spark, sf).select("user_id", "ts", "event_id", cents("value").alias("cents"))

    def step(state, row):
        state["n"] += 1
        if state["acc"] + row["cents"] <= CAP:
            state["acc"] += row["cents"]
        return state["n"], state["acc"]

    return live.drained(live.stateful(e, ["user_id"], ["ts", "event_id"], {"n": 0, "acc": 0}, step, "n long, acc long", "n long, acc long"))


@query(FOLD_SQL + "SELECT user_id, CAST(n AS BIGINT) AS n, CAST(acc AS BIGINT) AS acc FROM f")
def stream_shuffled_batches(spark, sf):
    """As ``stream_running_state``, with the rows in four files of any order, one for each micro-batch."""
    e = table(spark, sf, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    folder = shared_path(spark, "shuffled")
    dealt = e.select("user_id", "at", cents("value").alias("cents"))
    dealt.repartition(4, F.xxhash64("user_id", "at")).write.parquet(folder)
    rows = arriving(spark, folder, dealt.schema, files_at_once=1)

    def step(state, row):
        state["n"] += 1
        if state["acc"] + row["cents"] <= CAP:
            state["acc"] += row["cents"]
        return state["n"], state["acc"]

    return live.drained(live.stateful(rows, ["user_id"], ["at"], {"n": 0, "acc": 0}, step, "n long, acc long", "n long, acc long", position="at"))
