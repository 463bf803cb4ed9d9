from __future__ import annotations

import random

import numpy as np

from quarrylight.operators.snapdiff import diff, differing

SCHEMA = "snapshot_id string, kind string, path string, lines int, language string, _old int"


def test_differing_keys_of_arrays():
    a = (np.array([1, 2, 3, 3]), np.array([5, 6, 7, 8]))
    b = (np.array([3, 3, 2, 4]), np.array([8, 7, 9, 1]))
    assert differing(a, b).tolist() == [1, 2, 4]
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    assert differing(none, none).tolist() == [] and differing(a, none).tolist() == [1, 2, 3]


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = [(s, r.choice("fe"), f"p{r.randrange(30)}", r.choice([None, 1, 2]), r.choice([None, "x"]), 0) for s in ("a", "b", "c") for _ in range(40)]
    one = {}
    for row in rows:  # one row per key and snapshot
        one.setdefault(row[:3], row)
    rows = list(one.values())
    got = sorted(tuple(x) for x in diff(spark.createDataFrame(rows + rows[:30], SCHEMA), ["kind"], ["path"], ["lines", "language"], ["c", "a", "b"]).collect())
    want = []
    for old, new in (("a", "b"), ("b", "c")):
        o = {x[1:3]: x[3:5] for x in rows if x[0] == old}
        n = {x[1:3]: x[3:5] for x in rows if x[0] == new}
        for k in o.keys() | n.keys():
            change = "added" if k not in o else "removed" if k not in n else "changed" if o[k] != n[k] else None
            if change:
                want.append((new, k[0], change, k[1]))
    assert got == sorted(want)


def test_empty_and_single_snapshot(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert diff(df, ["kind"], ["path"], ["lines"], []).count() == 0
    df = spark.createDataFrame([("a", "f", "p", None, None, 0)], SCHEMA)
    assert diff(df, ["kind"], ["path"], ["lines"], ["a"]).count() == 0
    assert [tuple(r) for r in diff(df, ["kind"], ["path"], ["lines"], ["a", "b"]).collect()] == [("b", "f", "removed", "p")]
