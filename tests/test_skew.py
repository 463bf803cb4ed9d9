from __future__ import annotations

import random
from collections import Counter, defaultdict

from quarrylight.operators.skew import heavy_keys, salted_aggregate

SCHEMA = "snapshot_id string, source_file_id long, target_file_id long, import_type string, rows string"


def edges(seed=1, n=3000):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        target = 4 if r.random() < 0.4 else r.choice([None, *range(300)])
        out.append((f"s{r.randrange(5)}", r.choice([None, *range(100)]), target, r.choice([None, "internal", "external"]), "x"))
    return out + out[:200]


def test_against_brute_force(spark):
    data = edges()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.target_file_id: (r["rows"], r.importers, r.types) for r in salted_aggregate(df, "target_file_id", {"importers": "source_file_id", "types": "import_type"}, 0.05, 8).collect()}
    want = defaultdict(lambda: [0, set(), set()])
    for _, s, t, k, _ in data:
        if t is not None:
            want[t][0] += 1
            want[t][1].add(s)
            want[t][2].add(k)
    assert got == {t: (n, len(s - {None}), len(k - {None})) for t, (n, s, k) in want.items()}


def test_heavy_keys_count_repeats_and_null_rows(spark):
    data = [("s", 1, 1, None, "x")] * 3 + [("s", 1, None, None, "x")] * 97
    df = spark.createDataFrame(data, SCHEMA)
    assert [tuple(r) for r in heavy_keys(df, "target_file_id", 0.03).collect()] == [(1, 3)]
    assert heavy_keys(df, "target_file_id", 0.04).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert salted_aggregate(df, "target_file_id", {"importers": "source_file_id"}).count() == 0
    assert Counter() == Counter(heavy_keys(df, "target_file_id", 0.1).collect())
