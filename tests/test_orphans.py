from __future__ import annotations

import random

from quarrylight.operators.orphans import OrphanTracker

REFS = "table_name string, field_name string, period string, scope string, id long, extra int"
KEYS = "scope string, id long"


def refs(spark, rows):
    return spark.createDataFrame([("t", "f", "2025-01", s, i, 0) for s, i in rows], REFS)


def keys(spark, rows):
    return spark.createDataFrame(rows, KEYS)


def open_ids(tracker):
    return sorted((r.scope, r.id) for r in tracker.orphans().collect())


def test_arrivals_resolve_and_deletions_reopen(spark, tmp_path):
    t = OrphanTracker(spark, str(tmp_path), 4)
    assert open_ids(t) == []
    t.advance(refs(spark, [("", 1), ("", 2), ("", 2), ("", None), ("a", 1)]), keys(spark, [("", 1), ("", None)]))
    assert open_ids(t) == [("", 2), ("a", 1)]
    t.advance(arrived=keys(spark, [("", 2)]))
    assert open_ids(t) == [("a", 1)]
    t.advance(deleted=keys(spark, [("", 1)]))
    assert open_ids(t) == [("", 1), ("a", 1)]
    t.advance(refs(spark, [("", 1), ("", 9)]), keys(spark, [("", 1)]))
    assert open_ids(OrphanTracker(spark, str(tmp_path), 4)) == [("", 9), ("a", 1)]
    assert [tuple(r) for r in t.counts().collect()] == [("t", "f", "2025-01", 2)]


def test_a_batch_that_dies_leaves_the_state(spark, tmp_path):
    t = OrphanTracker(spark, str(tmp_path), 4)
    t.advance(refs(spark, [("", 1)]))
    (tmp_path / "batch=2" / "_bucket=0").mkdir(parents=True)  # written in part, never committed
    assert open_ids(t) == [("", 1)]
    assert t.advance(arrived=keys(spark, [("", 1)])) == 2
    assert open_ids(t) == []


def test_any_split_into_batches_gives_the_same(spark, tmp_path):
    r = random.Random(5)
    references = [("", r.randrange(40)) for _ in range(60)]
    parents = [("", r.randrange(40)) for _ in range(25)]
    want = sorted({x for x in references if x not in parents})
    for n in (1, 3):
        t = OrphanTracker(spark, str(tmp_path / str(n)), 8)
        for k in range(n):
            t.advance(refs(spark, references[k::n]), keys(spark, parents[k::n]))
        assert open_ids(t) == want


def test_empty_batches(spark, tmp_path):
    t = OrphanTracker(spark, str(tmp_path), 4)
    assert t.advance() == 0
    t.advance(refs(spark, []), keys(spark, []))
    assert open_ids(t) == []
