from __future__ import annotations

import datetime as dt

from quarrylight.operators.incremental import PartitionedRefresh, completed_versions, fingerprints, pending_files

T = dt.datetime(2025, 1, 1)
FILES = "file_id long, last_indexed timestamp_ntz, hash string, extra string"
SYMBOLS = "file_id long, file_hash string, run_id long, path string"
STATUS = "run_id long, state string, updated_at timestamp_ntz"


def at(days):
    return T + dt.timedelta(days=days)


def tables(spark, files, symbols, status):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(status, STATUS)


def pending(files, symbols, status):
    return pending_files(files, completed_versions(symbols, status))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_pending_rules(spark):
    files = [
        (1, at(0), "old", None), (1, at(1), "new", None), (1, at(1), "new", None),  # repeated; only the old version is done
        (2, at(0), "a", None),  # done
        (3, at(0), "a", None),  # by a failed run
        (4, None, "a", None), (4, at(0), "b", None),  # NULL time is older than any
        (5, at(0), None, None),  # no hash
        (6, at(0), "x", None), (6, at(0), "y", None),  # a tie: the greatest hash
        (None, at(0), "z", None),
    ]
    symbols = [(1, "old", 1, "p"), (2, "a", 1, "p"), (2, "a", 1, "p"), (3, "a", 2, "p"), (4, "b", 1, None), (5, None, 1, "p"), (6, "y", 1, "p"), (None, "a", 1, "p")]
    status = [(1, "running", at(0)), (1, "completed", at(1)), (2, "completed", at(0)), (2, "failed", at(3)), (3, "running", None)]
    assert ids(pending(*tables(spark, files, symbols, status))) == [1, 3, 5]


def test_pending_of_empty_tables(spark):
    assert ids(pending(*tables(spark, [], [], []))) == []


def test_refresh_recomputes_changed_partitions_only_and_survives_a_crash(spark, tmp_path):
    files = [(i, at(0), "v1", None) for i in range(200)]
    symbols = [(i, "v1", 1, "p") for i in range(0, 200, 2)]
    status = [(1, "completed", at(1))]
    seen = []

    def run(refresh, files, symbols, fail=False):
        f, s, st = tables(spark, files, symbols, status)

        def compute(sources):
            seen.append(sources["files"].count())
            if fail:
                raise RuntimeError("lost")
            return pending_files(sources["files"], sources["done"])

        return refresh.run({"files": f, "done": completed_versions(s, st)}, compute)

    refresh = PartitionedRefresh(spark, str(tmp_path), "file_id", 16)
    assert len(run(refresh, files, symbols)) == 16
    assert ids(refresh.result()) == list(range(1, 200, 2))
    assert run(refresh, files, symbols) == []  # nothing new
    assert ids(refresh.result()) == list(range(1, 200, 2))
    changed = [(7, at(2), "v2", None)]
    done = symbols + [(1, "v1", 1, "p")]
    try:
        run(refresh, files + changed, done, fail=True)
    except RuntimeError:
        pass
    assert ids(refresh.result()) == list(range(1, 200, 2))  # the last good state
    again = run(refresh, files + changed, done)
    assert 1 <= len(again) <= 2 and seen[-1] < 60
    assert ids(refresh.result()) == [i for i in range(3, 200, 2)]
    # a partition that loses all of its rows is emptied
    run(refresh, files + changed, done + [(i, "v1", 1, "p") for i in range(200)] + [(7, "v2", 1, "p")])
    assert ids(refresh.result()) == []
    # a second state object sees the same
    assert ids(PartitionedRefresh(spark, str(tmp_path), "file_id", 16).result()) == []


def state(spark, refresh, files, symbols, status, compute=pending_files):
    f, s, st = tables(spark, files, symbols, status)
    return refresh.run({"files": f, "done": completed_versions(s, st)}, lambda x: compute(x["files"], x["done"]))


def test_a_run_that_completes_later_changes_its_files_only(spark, tmp_path):
    files = [(i, at(0), "v", None) for i in range(64)]
    symbols = [(i, "v", 1, "p") for i in range(60)] + [(60, "v", 2, "p"), (61, "v", 2, "p")]
    refresh = PartitionedRefresh(spark, str(tmp_path), "file_id", 32)
    state(spark, refresh, files, symbols, [(1, "completed", at(1)), (2, "running", at(1))])
    assert ids(refresh.result()) == [60, 61, 62, 63]
    changed = state(spark, refresh, files, symbols, [(1, "completed", at(1)), (2, "running", at(1)), (2, "completed", at(2))])
    assert 1 <= len(changed) <= 2
    assert ids(refresh.result()) == [62, 63]
    changed = state(spark, refresh, files, symbols, [(1, "completed", at(1)), (2, "failed", at(3))])
    assert 1 <= len(changed) <= 2
    assert ids(refresh.result()) == [60, 61, 62, 63]


def test_a_crash_after_the_result_was_replaced_and_sources_that_go_back(spark, tmp_path, monkeypatch):
    files, symbols, status = [(i, at(0), "v", None) for i in range(20)], [(i, "v", 1, "p") for i in range(10)], [(1, "completed", at(1))]
    refresh = PartitionedRefresh(spark, str(tmp_path), "file_id", 8)
    state(spark, refresh, files, symbols, status)
    real = PartitionedRefresh._replace

    def dies(self, df, name):
        if name == "fingerprints":
            raise RuntimeError("lost")
        real(self, df, name)

    monkeypatch.setattr(PartitionedRefresh, "_replace", dies)
    try:
        state(spark, refresh, files, symbols + [(15, "v", 1, "p")], status)
    except RuntimeError:
        pass
    monkeypatch.setattr(PartitionedRefresh, "_replace", real)
    assert ids(refresh.result()) == [10, 11, 12, 13, 14, 16, 17, 18, 19]
    assert state(spark, refresh, files, symbols, status) != []  # the fingerprints are equal, the note is there
    assert ids(refresh.result()) == list(range(10, 20))
    assert state(spark, refresh, files, symbols, status) == []
    assert ids(refresh.result()) == list(range(10, 20))


def test_a_null_that_moves_is_a_change(spark):
    def of(rows):
        return [tuple(r) for r in fingerprints(spark.createDataFrame(rows, "k long, a string, b string"), "k", 4).collect()]

    assert of([(1, "x", None)]) != of([(1, None, "x")])
    assert of([(1, "x", None), (1, "y", "z")]) == of([(1, "y", "z"), (1, "x", None)])


def test_a_state_keeps_its_partitions_and_key(spark, tmp_path):
    assert PartitionedRefresh(spark, str(tmp_path), "file_id", 8).partitions == 8
    assert PartitionedRefresh(spark, str(tmp_path), "file_id", 99).partitions == 8
    try:
        PartitionedRefresh(spark, str(tmp_path), "path", 8)
        raise AssertionError("another key was taken")
    except ValueError:
        pass
