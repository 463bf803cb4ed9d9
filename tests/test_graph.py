from __future__ import annotations

import random

import pytest

from quarrylight.operators import graph
from quarrylight.operators.snapshots import SnapshotStore, alerts, retained
from quarrylight.operators.symbols import QueryError, structure_filter, symbols_of
from quarrylight.operators.activity import parse_log
from quarrylight.streaming.watch import classify, debounced, watch

E = "src long, dst long, import_type string"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "internal") for a, b in pairs], E)


def nodes(spark, ids):
    return spark.createDataFrame([(i, f"p{i}.rs") for i in ids], "id long, path string")


def test_reach_of_a_diamond(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, None)])
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {tuple(r) for r in graph.reach(e, seeds, 5).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {tuple(r) for r in graph.reach(e, seeds, 0).collect()} == {(1, 0)}
    assert graph.reach(edges(spark, []), seeds).count() == 1


def closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[a] = seen
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_against_brute_force(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(34)] + [(50, 50), (60, 61), (61, 60), (61, 60)]
    reach = closure(pairs)
    want = {}
    for a in reach:
        if a in reach[a]:
            want[a] = max(b for b in reach if a in reach[b] and b in reach[a])
    got = {row.id: row.component for row in graph.strong_components(edges(spark, pairs)).collect()}
    assert got == want
    assert graph.strong_components(edges(spark, [(1, 2), (2, 3)])).count() == 0
    assert graph.strong_components(edges(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(30)]
    ids = range(45)
    reach = closure(pairs + [(b, a) for a, b in pairs])
    want = {i: min(reach.get(i, set()) | {i}) for i in set(ids) | set(reach)}
    got = {row.id: row.component for row in graph.components(nodes(spark, ids), edges(spark, pairs)).collect()}
    assert got == want


def test_unused_hotspots_dependents(spark):
    n = spark.createDataFrame([(1, "src/lib.rs"), (2, "tests/t.rs"), (3, "src/a.rs"), (4, "src/b.rs"), (5, "src/c.rs")], "id long, path string")
    e = edges(spark, [(1, 3), (1, 3), (2, 3)])
    exports = edges(spark, [(3, 4)])
    assert [r.path for r in graph.unused(n, e, exports).collect()] == ["src/c.rs"]
    assert [tuple(r) for r in graph.hotspots(e).collect()] == [(3, 3, 2)]
    assert {tuple(r) for r in graph.dependents(e).collect()} == {(3, 1), (3, 2)}


def test_alerts(spark):
    def two(rows):
        return spark.createDataFrame(rows, "subject string, value long")

    grown = spark.createDataFrame([("a", 100, 199), ("b", 100, 200), ("c", 0, 900)], "subject string, old long, new long")
    got = {(r.severity, r.category, r.subject) for r in alerts(two([("x", 9), ("y", 10), ("z", 25)]), two([("c2", 2), ("c3", 3)]), two([("m", 49), ("n", 50)]), grown).collect()}
    assert got == {("warning", "fan_in", "y"), ("critical", "fan_in", "z"), ("warning", "circular_dependency", "c3"), ("warning", "module_size", "n"), ("warning", "line_growth", "b")}


def test_retention(spark):
    ids = [f"2025{m:02d}{d:02d}_000000" for m in range(1, 5) for d in range(1, 29, 4)]
    kept = {r.snapshot_id for r in retained(spark.createDataFrame([(i,) for i in ids], "snapshot_id string")).collect() if r.kept}
    newest = sorted(ids, reverse=True)
    assert set(newest[:7]) <= kept and {"20250125_000000", "20250225_000000", "20250325_000000"} <= kept and "20250101_000000" not in kept


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.list() == []
    store.write("20250101_000000", nodes(spark, [1]), edges(spark, [(1, 1)]))
    store.write("20250201_000000", nodes(spark, [1, 2]), edges(spark, [(1, 2)]))
    (tmp_path / "edges" / "snapshot_id=20250301_000000").mkdir()  # never finished
    assert store.list() == ["20250201_000000", "20250101_000000"]
    assert store.read("files", "20250201_000000").count() == 2
    store.drop("20250101_000000")
    assert store.list() == ["20250201_000000"]


def test_debounce_on_table_and_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(t + dt.timedelta(seconds=s), "r", f"f{s}.rs", s == 5) for s in (0, 2, 5, 40)]
    schema = "ts timestamp, source string, path string, is_removal boolean"
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.events for r in debounced(df, ["source"]).collect()) == [1, 3]
    late = spark.createDataFrame([(t + dt.timedelta(hours=1), "r", "z.rs", False)], schema)  # moves the watermark on
    df.write.json(str(tmp_path / "in"))
    got = []
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda b, i: got.extend((r.events, sorted(r.changed), sorted(r.deleted)) for r in b.collect()), extensions=["rs"]).awaitTermination()
        late.write.mode("append").json(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda b, i: got.extend((r.events, sorted(r.changed), sorted(r.deleted)) for r in b.collect()), extensions=["rs"]).awaitTermination()
    assert (3, ["f0.rs", "f2.rs"], ["f5.rs"]) in got and (1, ["f40.rs"], []) in got


def test_classify(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "2"), ("c", None), ("d", "1")], "path string, hash string")
    assert {tuple(r) for r in classify(old, new).collect()} == {("a", "modified"), ("b", "deleted"), ("c", "unchanged"), ("d", "new")}


def test_symbols_and_structure(spark):
    text = "struct A {\n    x: i64,\n}\n\nimpl A {\n    fn run(&self) {\n        // }\n    }\n}\n\npub fn main() {\n}\n"
    assert [(n, k, a, b) for n, k, a, b, _ in symbols_of(text, "rust")] == [("A", "Struct", 1, 3), ("run", "Method", 6, 8), ("main", "Function", 11, 12)]
    text = "X = 1\n\nclass K:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    assert [(n, k, a, b) for n, k, a, b, _ in symbols_of(text, "python")] == [("X", "Constant", 1, 1), ("K", "Class", 3, 5), ("f", "Method", 4, 5), ("g", "Function", 7, 8)]
    assert symbols_of("", "go") == [] and symbols_of("x", "cobol") == []
    df = spark.createDataFrame([("main", "Function"), ("A", "Struct")], "name string, kind string")
    assert [r.name for r in structure_filter(df, '(function_item name: (identifier) @n) @f (#eq? @n "main")').collect()] == ["main"]
    for bad in ("(nothing) @x", "((a) (b)) @x", "(function_item)"):
        with pytest.raises(QueryError):
            structure_filter(df, bad)


def test_commit_log(spark):
    log = ["abcdef1|ann|a@x|100|first", "", "src/a.rs", "src/b.rs", "abcdef2|bob|b@x|200|no|files"]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(log)], "source string, line_no int, value string")
    got = {(r.hash, r.author, r.ts, r.subject, r.path) for r in parse_log(df).collect()}
    assert got == {("abcdef1", "ann", 100, "first", "src/a.rs"), ("abcdef1", "ann", 100, "first", "src/b.rs"), ("abcdef2", "bob", 200, "no|files", None)}


def test_rounds_of_joins_agree_with_one_task(spark, monkeypatch):
    """What one task solves and what rounds of joins find is the same, on random graphs with loops and repeats."""
    import random

    from quarrylight.operators import graph as g

    r = random.Random(5)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)] + [(50, 51), (51, 50), (60, 60), (None, 1), (2, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(70)], "id long")
    results = []
    for limit in (1_000_000, 0):
        monkeypatch.setattr(g, "LOCAL_EDGES", limit)
        results.append((sorted(map(tuple, g.strong_components(df).collect())), sorted(map(tuple, g.components(nodes, df).collect()))))
    assert results[0] == results[1]
    assert (50, 51) in results[0][0] and (60, 60) in results[0][0] and len(results[0][1]) == 70
