import random
import re

import numpy as np
import pytest

from tidewell.llm import jaccard_join as jj
from tidewell.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, width, percent):
    """doc_id to (size, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common, either = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if sets[x] and sets[y] and 100 * common >= percent * either:
                parent[root(x)] = root(y)
    least = {}
    for x, (d, _) in enumerate(rows):
        least[root(x)] = min(d, least.get(root(x), d))
    return sorted((d, len(sets[x]), least[root(x)]) for x, (d, _) in enumerate(rows))


def copies(seed, n=150):
    rng = random.Random(seed)
    base = [[str(rng.randrange(300)) for _ in range(rng.choice([1, 2, 3, 9, 12, 30, 90]))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = str(rng.randrange(3000))
        rows.append((k, " ".join(w)))
    return rows


def found(spark, rows, width, percent):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int")
    return sorted(map(tuple, jj.groups(df, width, percent).collect()))


@pytest.mark.parametrize("width, percent, seed", [(3, 90, 1), (5, 80, 2)])
def test_groups_equal_all_pairs(spark, width, percent, seed):
    rows = copies(seed)
    assert found(spark, rows, width, percent) == plain(rows, width, percent)


def test_large_groups_are_searched_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "SHARED", 1)
    rng = random.Random(4)
    base = [str(k) for k in range(60)]
    rows = []
    for k in range(120):  # near copies, some near only to each other
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((k, " ".join(w)))
    assert found(spark, rows, 3, 90) == plain(rows, 3, 90)


@pytest.mark.parametrize("pool, seed", [(10_000, 11), (4, 12), (2, 13)])
def test_near_texts_that_mostly_do_not_link(spark, monkeypatch, pool, seed):
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "SHARED", 1)
    monkeypatch.setattr(jj, "ASKED", 2)
    rng, rows = random.Random(seed), []
    base = [str(k) for k in range(120)]
    for k in range(150):
        w = list(base[: rng.randrange(100, 120)])
        for at in rng.sample(range(100), rng.choice([2, 3, 4])):
            w[at] = f"{at}x{rng.randrange(pool)}"
        rows.append((k, " ".join(w)))
    want = plain(rows, 3, 90)
    assert found(spark, rows, 3, 90) == want and len({c for _, _, c in want}) > 20


def test_search_in_lists_equals_all_pairs():
    rng, hashes = random.Random(6), jj.Hashes()
    for percent in (60, 80, 90, 100):
        sets = [jj.shingles(t.encode(), 2, hashes) for _, t in copies(percent, 200)]
        block = jj.Block(sets, percent)
        for x in rng.sample(range(len(sets)), 60):
            common = [len(np.intersect1d(sets[x], y)) for y in sets]
            want = [y for y, c in enumerate(common) if 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c)]
            assert sorted(block.search(sets[x], lambda y: False)) == want


def test_edge_cases(spark):
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "A b"), (5, "a\x0bB"), (4, "a"), (3, "x y z"), (2, "X Y Z"), (1, "é É"), (10, "É É"), (11, "a b a b a b a b a b"), (12, "a b a b"), (13, "w " * 40_000)]
    assert found(spark, rows, 3, 90) == plain(rows, 3, 90)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q r s t"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, jj.groups(df).collect()), key=str)
    assert got == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 2), (2, 2, 1)], key=str)
    assert jj.groups(df.filter("false")).count() == 0


def test_linked_sets_share_enough_contents():
    hashes = jj.Hashes()
    for width, percent in ((3, 90), (5, 80)):
        sets = [jj.shingles(t.encode(), width, hashes) for _, t in copies(7, 120)]
        shared = [{(up + jj.band_of(len(s))[0]): (need, set(k.tolist())) for up, need, k in jj.contents(s, percent)} for s in sets]
        for x in range(len(sets)):
            for y in range(x):
                common = len(np.intersect1d(sets[x], sets[y]))
                if 100 * common < percent * (len(sets[x]) + len(sets[y]) - common) or len(sets[x]) == len(sets[y]) == common:
                    continue
                bands = set(shared[x]) & set(shared[y])
                assert any(len(shared[x][b][1] & shared[y][b][1]) >= max(1, min(shared[x][b][0], shared[y][b][0])) for b in bands)


def test_links_through_nodes_that_are_out(spark):
    hashes, fresh = jj.Hashes(), (f"w{k}" for k in range(1_000_000))
    edges = jj.ranges(2 * jj.band_of(30)[2] * 20 // 180 + 2)
    n = len(edges)

    def word(part):
        return next(w for w in fresh if np.searchsorted(edges, jj.shingles(w.encode(), 1, hashes)[0], "right") - 1 == part)

    def node(words):
        return jj.node_of(jj.shingles(" ".join(words).encode(), 1, hashes))

    base = [[word(p) for _ in range(3)] for p in range(n)]
    pair = [sum(base, []), sum(base, [])]
    pair[1][0] = word(0)
    tasks = []
    for own in pair:  # in each task, every content of the pair has a lesser node with which the task's own shares nothing else
        held = [own]
        for p in range(n):
            while node(other := [w for q in range(n) for w in (own[3 * p : 3 * p + 3] if p == q else [word(q) for _ in range(3)])]) >= min(map(node, pair)):
                pass
            held.append(other)
        tasks.append(held)
    rows = [(k, " ".join(w)) for k, w in enumerate(sum(tasks, []))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    want = plain(rows, 1, 80)
    assert [c for d, _, c in want if d != c] == [0] and sorted(map(tuple, jj.groups(df, 1, 80).collect())) == want


def test_links_over_several_bands(spark):
    rows = [(10 * n + m, " ".join(f"{n}x{k}" for k in range(m))) for n in (1, 3, 7, 10, 16) for m in (n, 2 * n)]
    want = plain(rows, 1, 50)
    assert sum(d != c for d, _, c in want) == 5 and found(spark, rows, 1, 50) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
