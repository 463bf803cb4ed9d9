"""A trigram index over lines: a table of byte grams, looked up by gram and intersected by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import trigram_array


def grams_of(pattern: str) -> list[str]:
    """Distinct byte trigrams of a literal as upper-case hex."""
    raw = pattern.encode()
    return sorted({raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)})


def postings(line_rows: DataFrame, distinct: bool = True) -> DataFrame:
    """(gram, path, line_no[, offset]) of all lines; with distinct, a gram counts once per line."""
    if distinct:
        return line_rows.select("path", "line_no", F.explode(F.array_distinct(trigram_array(F.col("line")))).alias("gram")).select("gram", "path", "line_no")
    return line_rows.select("path", "line_no", F.posexplode(trigram_array(F.col("line"))).alias("offset", "gram")).select("gram", "path", "line_no", "offset")


def write_index(line_rows: DataFrame, path: str, buckets: int = 64) -> None:
    """The index as Parquet, in folders by hash of the gram and sorted by gram, so that a lookup reads few row groups."""
    rows = postings(line_rows).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8))).sortWithinPartitions("bucket", "gram", "path", "line_no").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(index: DataFrame, grams: list[str], buckets: int | None = None) -> DataFrame:
    """The postings of some grams; with buckets, only their folders are read."""
    out = index.where(F.col("gram").isin(grams))
    if buckets is not None:
        wanted = index.sparkSession.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")).distinct().collect()
        out = out.where(F.col("bucket").isin([r[0] for r in wanted]))
    return out


def intersect(index: DataFrame, grams: list[str]) -> DataFrame:
    """(path, line_no) of the lines that have all of the grams."""
    return lookup(index, grams).groupBy("path", "line_no").agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams)).select("path", "line_no")
