"""Trees of any depth, and spans near each other, against plain restatements."""

import random

from palimpsest.operators import bands, hierarchy


def test_trees_with_chains_orphans_and_cycles(spark):
    rng = random.Random(1)
    parent = {0: None, **{i: rng.choice([i - 1, i - 1, rng.randrange(i)]) for i in range(1, 60)}, 70: 71, 71: 72, 72: 70, 73: 72, 80: 80, 81: 80, 90: 9999, None: 3}
    nodes = spark.createDataFrame([(i, p, f"n{i}", f"v{i}" if (i or 0) % 5 == 0 else None) for i, p in parent.items()], "node_id long, parent_id long, label string, v string")
    got = {r.node_id: r for r in hierarchy.hierarchy(nodes, "label", "v").collect()}
    assert set(got) == set(parent) - {None}
    lines = {}
    for i in got:
        line, at = [], i
        while at is not None and at not in line:
            line.append(at)
            at = parent[at] if parent[at] in got else None
        lines[i] = None if at is not None else line
    for i, line in lines.items():
        if line is None:
            assert got[i].cyclic and got[i].depth is None and got[i].breadcrumb is None and got[i].n_below is None
            continue
        assert not got[i].cyclic and got[i].depth == len(line) - 1 and got[i].breadcrumb == [f"n{x}" for x in reversed(line)]
        assert got[i].inherited == next((f"v{x}" for x in line if x % 5 == 0), None)
        assert got[i].n_below == sum(1 for other in lines.values() if other and i in other[1:])


def test_an_empty_tree(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "node_id long, parent_id long, label string, v string"), "label", "v").count() == 0


def test_nearest_spans(spark):
    rng = random.Random(2)
    spans = lambda n, most: [(rng.randrange(3), a := rng.randrange(3000), a + rng.randrange(1, most)) for _ in range(n)]
    left, right = sorted(set(spans(80, 30))), sorted(set(spans(60, 900)))
    frame = lambda rows: spark.createDataFrame(rows, "k int, start int, end int")
    for window in (10, 400):
        near = lambda a, b: max(a[1] - b[2], b[1] - a[2], 0)
        pairs = sorted((*a, *b[1:], near(a, b)) for a in left for b in right if a[0] == b[0] and near(a, b) <= window)
        got = bands.near_pairs(frame(left), frame(right), "k", window).select("k", "start", "end", "r_start", "r_end", "distance")
        assert sorted(map(tuple, got.collect())) == pairs
        best = {}
        for p in pairs:
            best[p[:3]] = min(best.get(p[:3], p), p, key=lambda x: (x[5], x[3], x[4]))
        found = bands.nearest(frame(left), frame(right), "k", window).select("k", "start", "end", "r_start", "r_end", "distance")
        assert sorted(map(tuple, found.collect())) == sorted(best.values())
