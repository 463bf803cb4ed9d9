"""Aggregation by key where a few keys hold most rows.

Stage one counts rows per (key, salt), where the salt of a row comes from its own hash: a lost task that runs again
salts the same way, and each partial result is small. Keys that hold at least ``heavy_share`` of all rows are the heavy
ones, at most ``1 / heavy_share`` of them. Stage two aggregates rows per (key, salt), salted for heavy keys only; stage
three merges the partial results of a key. Distinct counts stay exact, because the salt for a distinct column is taken
from that column: equal values meet in one salt, so the counts of the salts add up.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salt_of(columns: list[Column], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def key_counts(df: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """(key, rows) of all non-NULL keys, counted in two stages so that no task gets all rows of a key."""
    partial = df.where(F.col(key).isNotNull()).groupBy(F.col(key), salt_of([F.col(c) for c in df.columns], salts).alias("_salt")).agg(F.count(F.lit(1)).alias("_n"))
    return partial.groupBy(key).agg(F.sum("_n").alias("rows"))


def heavy_keys(df: DataFrame, key: str, share: float, salts: int = 32) -> DataFrame:
    """(key, rows) of the keys that hold at least ``share`` of all rows, NULL keys and repeats counted as rows."""
    return key_counts(df, key, salts).where(F.col("rows") >= F.lit(share * df.count()))


def salted_aggregate(df: DataFrame, key: str, distinct: dict[str, str], heavy_share: float = 0.005, salts: int = 32) -> DataFrame:
    """Rows and exact distinct counts per key.

    distinct  output column -> column whose distinct non-NULL values are counted
    Returns (key, rows, *distinct). Rows with a NULL key are left out; an empty table gives an empty result.
    """
    heavy = F.broadcast(heavy_keys(df, key, heavy_share, salts).select(F.col(key).alias("_key"), F.lit(True).alias("_heavy")))  # at most 1 / heavy_share rows
    columns = list(dict.fromkeys(distinct.values()))
    marked = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)], F.xxhash64(*df.columns).alias("_row")).join(heavy, "_key", "left")

    def salt(of: Column) -> Column:
        return F.when(F.col("_heavy"), F.pmod(F.xxhash64(of), F.lit(salts))).otherwise(F.lit(0)).alias("_salt")

    rows = marked.groupBy("_key", salt(F.col("_row"))).agg(F.count(F.lit(1)).alias("_n"), *[F.lit(0).cast("long").alias(f"_d{i}") for i in range(len(columns))])
    parts = [rows]
    for i in range(len(columns)):
        values = marked.where(F.col(f"_v{i}").isNotNull()).groupBy("_key", salt(F.col(f"_v{i}")), f"_v{i}").agg(F.lit(1).alias("_one"))
        counted = values.groupBy("_key", "_salt").agg(F.count("_one").alias("_c"))
        parts.append(counted.select("_key", "_salt", F.lit(0).cast("long").alias("_n"), *[(F.col("_c") if i == j else F.lit(0).cast("long")).alias(f"_d{j}") for j in range(len(columns))]))
    merged = functools.reduce(DataFrame.unionByName, parts).groupBy("_key").agg(F.sum("_n").alias("rows"), *[F.sum(f"_d{j}").alias(f"_d{j}") for j in range(len(columns))])
    return merged.select(F.col("_key").alias(key), "rows", *[F.col(f"_d{columns.index(c)}").alias(name) for name, c in distinct.items()])
