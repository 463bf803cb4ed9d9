from __future__ import annotations

import datetime as dt
import hashlib
import random

from quarrylight import reference_queries as q

SNAP = "snapshot_id string, id long, path string, language string, line_count int"
EDGES = "snapshot_id string, source_file_id long, target_file_id long, import_type string"
FILES = "file_id long, path string, language string, content string, hash string, line_count int, branch string, last_indexed timestamp"
CORE = "file_id long, path string, language string, line_count int"


def tables(spark, folder, **rows):
    """A data directory of tables: name=(rows, schema)."""
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def snapshot_tables(spark, folder, seed):
    """Two snapshots of 40 files with random imports, parent declarations among them; ids 1 and 2 are the core."""
    r = random.Random(seed)
    snaps, edges = [], []
    for s in ("20250101_000000", "20250201_000000"):
        snaps += [(s, i, f"m{i % 3}/f{i:02d}.rs", "rust", 10) for i in range(3, 41)] * 2  # loaded twice
        pairs = [(a, a + 1) for a in (3, 4, 5)] + [(6, 3), (10, 11), (11, 10), (20, 20)] + [(r.randrange(7, 36), r.randrange(7, 36)) for _ in range(22)]
        edges += [(s, a, b, "internal") for a, b in pairs] * 2 + [(s, 38, 39, "mod_decl"), (s, 39, 38, "internal"), (s, 3, None, "external"), (s, 40, 1, None)]
        if s.startswith("202501"):
            edges += [(s, a, a % 40 + 1, "internal") for a in range(1, 41)]  # one cycle of all, in the old one only
    data = tables(spark, folder, snap_files=(snaps, SNAP), dependency_edges=(edges, EDGES), core_files=([(1, "core/a.rs", "rust", 5), (2, "core/b.rs", "rust", 5)], CORE))
    last = "20250201_000000"
    paths = {i: p for s, i, p, *_ in snaps if s == last} | {1: "core/a.rs", 2: "core/b.rs"}
    return data, paths, {(a, b, t) for s, a, b, t in edges if s == last}


def reachable(start, pairs):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        for a, b in pairs:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def cycles_by_brute_force(edges):
    pairs = {(a, b) for a, b, t in edges if t != "mod_decl" and b is not None}
    reach = {a: reachable(a, pairs) for p in pairs for a in p}
    return {frozenset(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}


def test_threshold_alerts_have_the_cycles(spark, tmp_path):
    data, paths, edges = snapshot_tables(spark, tmp_path, 1)
    want = {(min(paths[i] for i in c), float(len(c))) for c in cycles_by_brute_force(edges) if len(c) >= 3}
    got = [(r.subject, r.value) for r in q.q_threshold_alerts(spark, data).collect() if r.category == "circular_dependency"]
    assert ("m0/f03.rs", 4.0) in want and sorted(got) == sorted(want)


def test_analysis_summary_by_brute_force(spark, tmp_path):
    data, paths, edges = snapshot_tables(spark, tmp_path, 2)
    both = {(a, b) for a, b, _ in edges if b is not None}
    both |= {(b, a) for a, b in both}
    islands = {frozenset({i} | reachable(i, both)) for i in paths}
    into = [b for _, b, _ in edges if b is not None]
    exports = {(a, b) for a, b, t in edges if t == "mod_decl"}
    alive = set(into).union(*(reachable(b, exports) for b in into))
    want = {
        "hotspots": sum(into.count(b) >= 2 for b in set(into)), "unused": len(set(paths) - alive), "files": len(paths), "cycles": len(cycles_by_brute_force(edges)),
        "islands": len(islands), "multi_file_islands": sum(len(i) > 1 for i in islands), "singleton_islands": sum(len(i) == 1 for i in islands),
    }
    assert want["cycles"] >= 3 and want["singleton_islands"] >= 1 and want["multi_file_islands"] >= 2
    assert [r.asDict() for r in q.q_analysis_summary(spark, data).collect()] == [want]


def fingerprint(lines):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    leaves = sorted(map(sha, lines))
    buckets = sorted({x[:3] for x in leaves})
    return sha("".join(sha("".join(x for x in leaves if x[:3] == b)) for b in buckets))


def test_fingerprint_of_index_and_snapshots(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    files = [(i, f"a/{i}.rs", "rust", "", f"h{i}", 1, "main", at) for i in range(300)]
    newer = (7, "a/7.rs", "rust", "x", "new", 1, "main", at + dt.timedelta(days=1))
    snaps = [(s, i, f"a/{i}.rs", "rust", 9 if (s, i) == ("b", 5) else 1) for s in "abc" for i in range(300)]
    data = tables(spark, tmp_path, files=(files + [newer], FILES), snap_files=(snaps + snaps[:9], SNAP))
    got = {r.snapshot_id: (r.files, r.fingerprint) for r in q.q_fingerprint(spark, data).collect()}
    want = {s: (300, fingerprint(f"{p}:{x}:{n}\n" for z, _, p, x, n in snaps if z == s)) for s in "abc"}
    want["index"] = (300, fingerprint(f"{f[1]}:{'new' if f[0] == 7 else f[4]}\n" for f in files))
    assert got == want and got["a"] == got["c"] != got["b"]
