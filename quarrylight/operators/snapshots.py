"""Structural snapshots: write, list, drop, retention, and the reports on two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.sources.shared import Folder

# Thresholds of alerts and snapshots kept per tier.
FAN_IN_CRITICAL, FAN_IN_WARNING, CYCLE_LENGTH, MODULE_FILES, GROWTH = 25, 10, 3, 50, 2.0
DAILY, WEEKLY, MONTHLY = 7, 4, 12


class SnapshotStore:
    """Snapshots as folders ``snapshot_id=...`` of one Parquet table each for files and edges."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)

    def write(self, snapshot_id: str, files: DataFrame, edges: DataFrame) -> None:
        files.write.mode("overwrite").parquet(f"{self.root}/files/snapshot_id={snapshot_id}")
        edges.write.mode("overwrite").parquet(f"{self.root}/edges/snapshot_id={snapshot_id}")

    def list(self) -> list[str]:
        """Ids, the newest first; a snapshot counts once both of its tables are complete."""
        ids = [n.removeprefix("snapshot_id=") for n in self.folder.names("edges") if n.startswith("snapshot_id=")]
        return sorted((i for i in ids if self.valid(i)), reverse=True)

    def valid(self, snapshot_id: str) -> bool:
        return all(self.folder.exists(f"{t}/snapshot_id={snapshot_id}/_SUCCESS") for t in ("files", "edges"))

    def drop(self, snapshot_id: str) -> None:
        for t in ("edges", "files"):
            self.folder.remove(f"{t}/snapshot_id={snapshot_id}")

    def read(self, name: str, snapshot_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}")


def retained(ids: DataFrame) -> DataFrame:
    """(snapshot_id, kept): whether a tier keeps it: the newest DAILY, the newest of the last WEEKLY weeks and MONTHLY months.

    A week's key is the calendar year with the ISO week, a month's the year and month of the id.
    """
    day = F.to_date(F.substring("snapshot_id", 1, 8), "yyyyMMdd")
    keyed = ids.select("snapshot_id").distinct().withColumn("week", F.concat(F.substring("snapshot_id", 1, 4), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))).withColumn("month", F.substring("snapshot_id", 1, 6))
    newest = Window.orderBy(F.desc("snapshot_id"))  # one row per snapshot, not per file

    def tier(key: str, most: int) -> Column:
        first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("snapshot_id"))) == 1
        return first, most

    rows = keyed.withColumn("_d", F.row_number().over(newest))
    for key, most in (("week", WEEKLY), ("month", MONTHLY)):
        first, _ = tier(key, most)
        rows = rows.withColumn(f"_{key}", first).withColumn(f"_{key}_n", F.sum(F.col(f"_{key}").cast("int")).over(newest))
    kept = (F.col("_d") <= DAILY) | F.col("_week") & (F.col("_week_n") <= WEEKLY) | F.col("_month") & (F.col("_month_n") <= MONTHLY)
    return rows.select("snapshot_id", kept.alias("kept"))


def module_metrics(files: DataFrame, by: list[str], module: Column) -> DataFrame:
    """(*by, module, files, lines): size of the modules; NULL line counts add nothing."""
    return files.groupBy(*by, module.alias("module")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))


def fingerprints(rows: DataFrame, by: list[str], path: Column, state: Column) -> DataFrame:
    """(*by, files, fingerprint) over path and state of all rows, in no order that one task would have to make.

    Rows hash to leaves; the sorted leaves of one of 4,096 buckets hash to one digest, the digests by bucket to the result.
    """
    leaf = F.sha2(F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.coalesce(state, F.lit("")), F.lit("\n")).cast("binary"), 256)
    leaves = rows.select(*by, leaf.alias("_leaf"))
    buckets = leaves.groupBy(*by, F.substring("_leaf", 1, 3).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_leaf")), "").cast("binary"), 256).alias("_digest"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))), lambda x: x["_digest"])
    return buckets.groupBy(*by).agg(F.sum("_n").alias("files"), F.sha2(F.array_join(digests, "").cast("binary"), 256).alias("fingerprint"))


def alerts(hotspots: DataFrame, cycles: DataFrame, modules: DataFrame, grown: DataFrame) -> DataFrame:
    """(severity, category, subject, value) of what passes its threshold.

    hotspots (subject, value imports), cycles (subject, value length), modules (subject, value files) and
    grown (subject, old, new line counts; an old count of 0 never alerts)
    """
    fan_in = hotspots.where(F.col("value") >= FAN_IN_WARNING).select(F.when(F.col("value") >= FAN_IN_CRITICAL, "critical").otherwise("warning").alias("severity"), F.lit("fan_in").alias("category"), F.col("subject").cast("string").alias("subject"), F.col("value").cast("double").alias("value"))

    def warn(df: DataFrame, category: str, least: float, value: Column) -> DataFrame:
        return df.where(value >= least).select(F.lit("warning").alias("severity"), F.lit(category).alias("category"), F.col("subject").cast("string").alias("subject"), value.cast("double").alias("value"))

    return fan_in.unionByName(warn(cycles, "circular_dependency", CYCLE_LENGTH, F.col("value"))).unionByName(warn(modules, "module_size", MODULE_FILES, F.col("value"))).unionByName(warn(grown.where("old > 0"), "line_growth", GROWTH, F.col("new") / F.col("old")))
