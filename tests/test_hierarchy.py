from __future__ import annotations

import random

from quarrylight.operators.hierarchy import cycle_ids, descendants, hierarchy, other_parents, paths as paths_of

SCHEMA = "child long, parent long, id long"


def frame(spark, links):
    return spark.createDataFrame([(c, p, 0) for c, p in links], SCHEMA)


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = {c for c, _ in links if c is not None} | {p for c, p in links if p is not None and c is not None}
    paths, bad = {}, set()
    for n in nodes:
        path, seen = [n], {n}
        while path[0] in parent:
            up = parent[path[0]]
            if up in seen:
                bad.add(n)
                break
            seen.add(up)
            path.insert(0, up)
        else:
            paths[n] = path
    return paths, bad


def check(spark, links):
    paths, bad = brute(links)
    df = frame(spark, links)
    assert {r.id for r in cycle_ids(df, "child", "parent").collect()} == bad
    tree = hierarchy(df, "child", "parent")
    rows = {r.id: r for r in tree.collect()}
    assert {r.id: list(r.path) for r in paths_of(tree).collect()} == paths
    assert sorted((r.id, r.descendant) for r in descendants(tree).collect()) == sorted((a, n) for n, path in paths.items() for a in path[:-1])
    for i, r in rows.items():
        assert (r.root, r.depth) == (paths[i][0], len(paths[i]) - 1)
        below = {j for j, x in rows.items() if x.root == r.root and r.lft < x.lft <= r.rgt}
        assert below == {j for j, p in paths.items() if i in p[:-1]} and r.descendants == len(below)


def test_random_forests_with_cycles(spark):
    r = random.Random(3)
    links = [(i, r.randrange(max(0, i - 12), i)) for i in range(1, 120) if r.random() < 0.9]
    links += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 203), (205, 205), (206, 205)]
    links += links[:20] + [(300, None), (None, 301), (301, 300)]
    check(spark, links)


def test_deep_chain_and_wide_parent(spark):
    check(spark, [(i, i - 1) for i in range(1, 150)] + [(1000 + i, 0) for i in range(100)])


def test_empty(spark):
    df = frame(spark, [])
    assert cycle_ids(df, "child", "parent").count() == 0 and hierarchy(df, "child", "parent").count() == 0


def test_null_only(spark):
    df = frame(spark, [(None, None), (None, 1)])
    assert hierarchy(df, "child", "parent").count() == 0


def test_ranges_unroll_in_pieces(spark, monkeypatch):
    import quarrylight.operators.hierarchy as h

    monkeypatch.setattr(h, "RANGE_PIECE", 7)
    check(spark, [(i, i // 3) for i in range(1, 60)])


def test_further_parents_are_named(spark):
    df = frame(spark, [(5, 2), (5, 1), (5, 3), (5, 3), (6, 5), (7, None), (None, 1)])
    assert sorted(tuple(r) for r in other_parents(df, "child", "parent").collect()) == [(5, 2), (5, 3)]
    assert other_parents(frame(spark, []), "child", "parent").count() == 0
