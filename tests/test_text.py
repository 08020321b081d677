"""Programs as text, over the driver's tables; the answers come from plain Python over the same rows."""

import pytest
from conftest import SMALL, bag
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewell.plans.text import Prepared, Text, TextError


@pytest.fixture(scope="module")
def rows(spark):
    return {n: [r.asDict() for r in spark.read.parquet(f"{SMALL}/{n}.parquet").collect()] for n in ("nation", "region", "part")}


@pytest.fixture(scope="module")
def text(spark):
    from pyspark.sql import functions as F

    found = {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("nation", "region", "part")}
    return Text(spark, **{n: df.withColumn("pos", F.col(df.columns[0]).cast("long")) for n, df in found.items()})


def values(text, program):
    return [tuple(r) if len(r) > 1 else r[0] for r in bag(text.run(program))]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-40, 40), st.integers(-9, 9).filter(bool), st.booleans())
def test_scalars(text, a, b, c):
    cut = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    assert values(text, f"({a} + {b}) * {b} - {a} // {b}") == [(a + b) * b - cut]
    assert values(text, f"{a} < {b} <= {a} + 3 or not {c}") == [a < b <= a + 3 or not c]
    assert values(text, f"{a} if {c} else {b} // ({a} - {a})" if c else f"{a} // ({a} - {a}) if {c} else {b}") == [a if c else b]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), max_size=6), st.lists(st.integers(-5, 5), max_size=6))
def test_lists(text, xs, ys):
    same(values(text, f"{xs} ++ {ys}"), xs + ys)
    same(values(text, f"[x * y for x in {xs} for y in {ys} if x + y > 1]"), [x * y for x in xs for y in ys if x + y > 1])
    assert values(text, f"sum({xs}) * 100 + count({ys})") == [sum(xs) * 100 + len(ys)]
    groups = {x // 1 % 3: 0 for x in xs}
    same(values(text, f"[count(g) for g in groupby({xs}, lambda x: x * x)]"), [sum(x * x == k for x in xs) for k in {x * x for x in xs}])
    assert len(groups) <= 3


def test_tables(text, rows):
    nation, part = rows["nation"], rows["part"]
    same(values(text, "[n.n_name for n in nation if n.n_regionkey == 3 if n.n_nationkey > 5]"), [n["n_name"] for n in nation if n["n_regionkey"] == 3 and n["n_nationkey"] > 5])
    assert values(text, "max([p.p_size for p in part if p.p_partkey < 50]) - min([p.p_size for p in part])") == [max(p["p_size"] for p in part if p["p_partkey"] < 50) - min(p["p_size"] for p in part)]
    same(values(text, "[sum([n.n_nationkey for n in g]) for g in groupby(nation, lambda n: n.n_regionkey) if count(g) > 4]"), [sum(n["n_nationkey"] for n in nation if n["n_regionkey"] == k) for k in range(5) if sum(n["n_regionkey"] == k for n in nation) > 4])
    assert values(text, "sum([n.n_nationkey for n in groupby(nation, lambda n: n.n_regionkey)[2]])") == [sum(n["n_nationkey"] for n in nation if n["n_regionkey"] == 2)]
    assert values(text, "nation[7].n_name + '!'") == [nation[7]["n_name"] + "!"]
    with pytest.raises(Exception, match="no element"):
        text.run("nation[99].n_name").collect()


def test_join_of_records(text, rows):
    got = text.run("[rec(nation=n.n_name, region=r.r_name) for n in nation for r in region if n.n_regionkey == r.r_regionkey]")
    name = {r["r_regionkey"]: r["r_name"] for r in rows["region"]}
    assert got.columns == ["nation", "region"]
    same(bag(got), [(n["n_name"], name[n["n_regionkey"]]) for n in rows["nation"]])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_strings_and_comments_stay(text):
    assert values(text, "'a++b' + \"`x := 1\" # ++ := `\n") == ["a++b`x := 1"]
    assert values(text, "'it\\'s ++' + '#'") == ["it's ++#"]
    assert Prepared("x := 1\ny = 'a:=b'").changes == {1}


def test_functions(text, rows):
    program = """
def rank(n: Int, step: Int):
    far = n * step
    if far > 40:
        return "far"
    elif far > 20:
        return "near"
    "here" if far > 5 else "home"

[rank(n.n_nationkey, 2) for n in nation]
"""
    want = ["far" if f > 40 else "near" if f > 20 else "here" if f > 5 else "home" for f in (2 * n["n_nationkey"] for n in rows["nation"])]
    same(values(text, program), want)


def test_tags(text, rows):
    program = """
def found(n):
    `first(n.n_nationkey) if n.n_regionkey == 0 else `second(n.n_name) if n.n_regionkey == 1 else `none

def told(v):
    match v:
        case `first(k): "key " + ("big" if k > 9 else "small")
        case `second(name): name
        case `never(x): 1 // 0
        case _: "-"

[told(found(n)) for n in nation]
"""
    want = [("key " + ("big" if n["n_nationkey"] > 9 else "small")) if n["n_regionkey"] == 0 else n["n_name"] if n["n_regionkey"] == 1 else "-" for n in rows["nation"]]
    same(values(text, program), want)
    assert values(text, "v = `a(4)\nx = match v:\n    case `a(n): n * n\nx + 1") == [17]
    assert values(text, "vs = [`a(4), `b, `a(6)]\nt = 0\nfor v in vs:\n    match v:\n        case `a(n): t += n\n        case `b: t = t * 10\nt") == [46]
    nested = values(text, "v = `out(`in(5))\nx = match v:\n    case `out(w):\n        match w:\n            case `in(n): n + 2\nx")
    assert nested == [7]


def test_generators_and_feeds(text, rows):
    program = """
def twice(ns, of):
    for n in ns:
        if n.n_regionkey == of:
            both = n.n_nationkey * 2
            yield both
            for r in region:
                if r.r_regionkey > 2:
                    yield both + r.r_regionkey
twice(nation, 4)
"""
    want = [x for n in rows["nation"] if n["n_regionkey"] == 4 for x in (2 * n["n_nationkey"], *(2 * n["n_nationkey"] + r["r_regionkey"] for r in rows["region"] if r["r_regionkey"] > 2))]
    same(values(text, program), want)
    program = """
odd = defer()
rest = defer()
late = defer()
def keep(v):
    v
for n in nation:
    v = `odd(n.n_nationkey) if n.n_regionkey == 1 else `even
    match v:
        case `odd(k): odd << keep(k)
        case _: rest << n.n_name
odd << 1000
late <<= [x + 1 for x in odd]
sum(late) + count(rest)
"""
    ones = [n["n_nationkey"] for n in rows["nation"] if n["n_regionkey"] == 1] + [1000]
    assert values(text, program) == [sum(x + 1 for x in ones) + sum(n["n_regionkey"] != 1 for n in rows["nation"])]


def test_transactions(text, rows):
    program = """
left: Mut(Int, Txn) := 60
log: Mut(Int, Txn) := 0
most = 9
said = defer()
def price(n):
    if n.n_nationkey < 0:
        return 1 // 0
    n.n_nationkey + most
for n in nation:
    with begin():
        cost = price(n)
        if n.n_regionkey == 2:
            left += cost
        elif left >= cost:
            left -= cost
            said << (n.n_nationkey, left)
        else:
            log = log * 2 + 1
with begin():
    log += 100
"""
    left, log, said = 60, 0, []
    for n in rows["nation"]:
        cost = n["n_nationkey"] + 9
        if n["n_regionkey"] == 2:
            left += cost
        elif left >= cost:
            left -= cost
            said.append((n["n_nationkey"], left))
        else:
            log = log * 2 + 1
        if n["n_nationkey"] == 0:  # the block on its own arrives with position 0
            log += 100
    same(values(text, program + "[rec(k=k, left=rest) for k, rest in said]"), said)
    assert values(text, program + "await_final(left) - await_final(log)") == [left - log]


def test_a_final_value_seeds_a_later_phase(text, rows):
    """The second store starts from what the first ended with; the third has nothing to do with either."""
    program = """
open: Mut(Int, Txn) := 40
apart: Mut(Int, Txn) := 1
for n in nation:
    with begin():
        if n.n_nationkey < open:
            open -= 3
later: Mut(Int, Txn) := await_final(open) * 10
told = defer()
for r in region:
    with begin():
        later = later * 2 - r.r_regionkey
        told << later
for r in region:
    with begin():
        apart += r.r_regionkey
"""
    left, apart, told = 40, 1 + sum(r["r_regionkey"] for r in rows["region"]), []
    for n in sorted(rows["nation"], key=lambda n: n["n_nationkey"]):
        left -= 3 * (n["n_nationkey"] < left)
    later = left * 10
    for r in sorted(rows["region"], key=lambda r: r["r_regionkey"]):
        later = later * 2 - r["r_regionkey"]
        told.append(later)
    assert values(text, program + "await_final(later) * 1000 + await_final(apart)") == [later * 1000 + apart]
    same(values(text, program + "told"), told)


@pytest.mark.parametrize("program, says", [
    ("x", "not defined"), ("1 + 'a'", "not for"), ("[1, 'a']", "one type"), ("max([True])", "not for"), ("1 < 'a'", "compared"), ("nation.gone", "scalar"), ("[n.gone for n in nation]", "no field"),
    ("for x in [1]:\n    y += x\n1", "initial value"), ("while True: pass", "not part"), ("1 +", "line 1"), ("x = 1", "last line"), ("1 / 2", "not for"), ("if True:\n    1", "every branch"), ("'a", "does not end"),
    ("match 3:\n    case `a: 1", "tagged"), ("match `a(1):\n    case `a: 1", "a value"), ("match `a:\n    case `a(x): 1", "no value"), ("match `a:\n    case `b: 1", "no case"), ("match `a:\n    case `a: 1\n    case `a: 2", "second case"), ("match `a:\n    case _: 1\n    case `a: 2", "last"),
    ("h = defer()\nh", "nothing was put"), ("x = 1\nx << 2", "deferred"), ("h = defer()\nh << 1\nh << 'a'\nh", "one type"), ("h = defer()\nh <<= [1]\nh <<= [2]\nh", "twice"),
    ("x: Mut(Int, Txn) := 1\nx", "await_final"), ("x: Mut(Int, Txn) := 1\nx = 2\n1", "transactions alone"), ("x: Mut(Int, Txn) := 1\nfor r in region:\n    with begin():\n        with begin():\n            x += 1\n1", "nest"), ("x: Mut(Int, Txn) := 1\nwith begin():\n    x = 'a'\nawait_final(x)", "bigint"),
    ("x: Mut(Int, Txn) := 1\nwith begin():\n    x += 1\ny = await_final(x)\nwith begin():\n    x += y\ny", "read already, with 'x'"),
    ("x: Mut(Int, Txn) := 1\nz: Mut(Int, Txn) := 1\nwith begin():\n    x += z\ny = await_final(x)\nwith begin():\n    z += 1\ny", "read already, with 'z'"),
    ("x: Int := 1\nx", "go together"), ("def f(n: Int): return n\nf('a')", "bigint"), ("def f(n): return n\nf(1, 2)", "arguments"), ("a, b = (1, 2, 3)\na", "names"),
])
def test_mistakes_name_their_line(text, program, says):
    with pytest.raises(TextError, match=says) as fault:
        text.run(program)
    assert "line" in str(fault.value)


def test_all_mistakes_are_told(text):
    with pytest.raises(TextError) as fault:
        text.run("a = 1 + 'x'\nb = a + 1\nc = gone\nd = [1]\nd[True] + c")
    assert "line 1" in str(fault.value) and "line 3" in str(fault.value) and "line 2" not in str(fault.value)
