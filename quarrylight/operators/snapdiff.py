"""Differences between consecutive full snapshots, by hashes first.

Each record is reduced to two 64-bit hashes, one of its key and one of its key and values. Buckets of key hashes hold
these compact arrays of all snapshots; within a bucket they are sorted in numpy and compared by searchsorted. Only the
key hashes that differ go on, and full values are fetched for them alone and compared exactly: a difference can only go
unseen where key and row hash of two different records are both equal, 128 bits in all.

Repeated rows count once. A NULL value differs from a value and equals NULL. Records of one key with different values
in one snapshot are compared as sets: the key has changed if the sets differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def consecutive(snapshots: list[str]) -> list[tuple[str, str]]:
    ordered = sorted(snapshots)
    return list(zip(ordered, ordered[1:]))


def _sorted_rows(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order: repeats go here, so no shuffle has to look for them."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    if len(keys):
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[first], rows[first]
    return keys, rows


def _missing(keys: np.ndarray, rows: np.ndarray, in_keys: np.ndarray, in_rows: np.ndarray) -> np.ndarray:
    """Keys of the (key, row) pairs that the sorted second arrays lack."""
    at = np.searchsorted(in_keys, keys, "left")
    end = np.searchsorted(in_keys, keys, "right")
    found = np.zeros(len(keys), bool)
    once = end - at == 1
    found[once] = in_rows[at[once]] == rows[once]
    for i in np.flatnonzero(end - at > 1):  # several rows of one key: rare
        found[i] = bool((in_rows[at[i] : end[i]] == rows[i]).any())
    return keys[~found]


def differing(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distinct key hashes whose sets of row hashes differ."""
    old, new = _sorted_rows(*old), _sorted_rows(*new)
    return np.unique(np.concatenate([_missing(*old, *new), _missing(*new, *old)]))


def candidates(compact: DataFrame, snapshots: list[str], buckets: int) -> DataFrame:
    """(_step, _k, later, snapshot_id): key hashes that differ between two consecutive snapshots, once for each of the two.

    compact  (snapshot_id, _k, _r): hashes of the key and of key and values of each record
    """
    steps = consecutive(snapshots)
    buckets = max(buckets, 12)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {s: (g["_k"].to_numpy(), g["_r"].to_numpy()) for s, g in pdf.groupby("snapshot_id", sort=False)}
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        found = [(after, differing(arrays.get(before, none), arrays.get(after, none))) for before, after in steps]
        steps_of = np.concatenate([np.empty(0, object), *(np.full(len(k), s, object) for s, k in found)])
        return pd.DataFrame({"_step": steps_of, "_k": np.concatenate([none[0], *(k for _, k in found)])})

    bucketed = compact.select("snapshot_id", "_k", "_r", F.pmod(F.col("_k"), F.lit(buckets)).cast("int").alias("_bucket"))
    found = bucketed.groupBy("_bucket").applyInPandas(compare, "_step string, _k long")
    before_of = F.create_map(*[F.lit(x) for before, after in steps for x in (after, before)]) if steps else F.create_map(F.lit(""), F.lit(""))
    sides = F.array(F.struct(F.lit(True).alias("later"), F.col("_step").alias("snapshot_id")), F.struct(F.lit(False).alias("later"), before_of[F.col("_step")].alias("snapshot_id")))
    return found.select("_step", "_k", F.explode(sides).alias("_side")).select("_step", "_k", "_side.later", "_side.snapshot_id")


def classified(full: DataFrame, group: list[str], key: list[str], values: list[str]) -> DataFrame:
    """(snapshot_id, *group, change, *key) by exact comparison of the full values of candidates.

    full  (_step, later, *group, *key, *values): the records behind the candidates, of both snapshots
    """
    sets = full.groupBy("_step", *group, *key).agg(*[F.collect_set(F.when(F.col("later") == later, F.struct(*values))).alias(name) for later, name in ((True, "_new"), (False, "_old"))])
    change = F.when(F.size("_old") == 0, "added").when(F.size("_new") == 0, "removed").when(F.array_sort("_new") != F.array_sort("_old"), "changed")
    return sets.select(F.col("_step").alias("snapshot_id"), *group, change.alias("change"), *key).where("change IS NOT NULL")


def row_hash(identity: list, values: list[str]):
    """Hash of a record's identity and values, in which NULL differs from every value."""
    return F.xxhash64(F.lit("row"), *identity, *[x for c in values for x in (F.col(c).isNull(), F.col(c))])


def diff(records: DataFrame, group: list[str], key: list[str], values: list[str], snapshots: list[str], buckets: int | None = None) -> DataFrame:
    """(snapshot_id, *group, change, *key): changes between each two consecutive snapshots of ``snapshots``.

    records  has snapshot_id, the columns of group and key, and values; records of other snapshots are ignored
    group    columns that are part of the identity but stand for kinds of records
    change   added, removed or changed; snapshot_id is the later snapshot
    """
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*group, *key)]
    hashed = records.withColumn("_k", F.xxhash64(*identity)).withColumn("_r", row_hash(identity, values))
    if buckets is None:
        buckets = -(-records.count() // ROWS_PER_BUCKET)
    found = candidates(hashed.select("snapshot_id", "_k", "_r"), snapshots, buckets)
    full = hashed.select("snapshot_id", "_k", *group, *key, *values).join(found, ["snapshot_id", "_k"])
    return classified(full, group, key, values)
