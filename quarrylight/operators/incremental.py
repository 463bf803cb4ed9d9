"""Recomputing only the partitions whose input has changed.

Keys are hashed into a fixed number of partitions. The fingerprint of a partition holds, for each source, the number
of its rows and the sum of their hashes; both are additive, so repeated, late or reordered deliveries are seen exactly
as they change the rows, and each is one partial aggregation before a shuffle of at most a row per partition and task.
A run compares the fingerprints with those of the last successful run, recomputes the partitions that differ and
replaces each of them through dynamic partition overwrite. What it is about to replace is noted first and struck out
last, after the fingerprints: a run that dies anywhere in between leaves its note, and the next run recomputes those
partitions whatever the fingerprints say, even if the sources have gone back to what they were before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.shared import Folder

PART = "_part"


def part_of(key: str, partitions: int) -> Column:
    """Partition of a key; NULL keys share one."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(partitions)).cast("int")


def fingerprints(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """(_part, rows, hash_sum): the row count and the sum of the hashes of all columns of each partition.

    A NULL has a flag of its own in the hash, so a value that moves from one column to the next is a change.
    """
    parts = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    return (
        df.select(part_of(key, partitions).alias(PART), F.xxhash64(*parts).cast("decimal(20,0)").alias("_h"))
        .groupBy(PART)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("_h").alias("hash_sum"))
    )


class PartitionedRefresh:
    """A result table that follows its sources by recomputing changed partitions only.

    state_dir   folder of the state, on a file system all executors share
    key         column by which sources and result are partitioned; a source without rows is fine, a NULL key is a key
    partitions  number of partitions of a new state; it is stored there, and a state keeps the number it began with

    ``compute`` gets the sources cut down to the changed partitions and returns rows that contain ``key``.
    """

    def __init__(self, spark: SparkSession, state_dir: str, key: str, partitions: int = 32) -> None:
        self.spark, self.key = spark, key
        self.state_dir = state_dir.rstrip("/")
        self.folder = Folder(spark, self.state_dir)
        if not self.folder.exists("settings.json"):
            self.folder.put_json("settings.json", {"key": key, "partitions": partitions})
        settings = self.folder.get_json("settings.json")
        if settings["key"] != key:
            raise ValueError(f"{self.state_dir} is partitioned by {settings['key']}, not by {key}")
        self.partitions = settings["partitions"]

    def _fingerprints(self, sources: dict[str, DataFrame]) -> DataFrame:
        """One row per (partition, source)."""
        out = None
        for name, df in sorted(sources.items()):
            one = fingerprints(df, self.key, self.partitions).withColumn("source", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out.select(PART, "source", "rows", F.col("hash_sum").cast("string").alias("hash_sum"))

    def _known(self) -> set[tuple]:
        if not self.folder.names("fingerprints"):
            return set()
        known = self.spark.read.parquet(f"{self.state_dir}/fingerprints").where("source IS NOT NULL")
        return {(r[PART], r["source"], r["rows"], r["hash_sum"]) for r in known.collect()}

    def _notes(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("replacing-")]

    def run(self, sources: dict[str, DataFrame], compute: Callable[[dict[str, DataFrame]], DataFrame]) -> list[int]:
        """Bring the result up to date; returns the partitions that were recomputed."""
        now = {(r[PART], r["source"], r["rows"], r["hash_sum"]) for r in self._fingerprints(sources).collect()}  # at most partitions x sources rows
        before, notes = self._known(), self._notes()
        left_over = {p for n in notes for p in self.folder.get_json(n)}
        changed = sorted({row[0] for row in now ^ before} | left_over)
        if not changed and self.folder.exists("result"):
            return []
        note = f"replacing-{uuid.uuid4().hex}.json"
        self.folder.put_json(note, changed)
        part = part_of(self.key, self.partitions)
        if len(changed) < self.partitions:
            sources = {name: df.where(part.isin(changed)) for name, df in sources.items()}
        result = compute(sources).withColumn(PART, part).withColumn("_live", F.lit(True))
        # A row per changed partition, so that one left without rows is replaced too.
        marks = self.spark.createDataFrame([(p,) for p in changed or [0]], f"{PART} int")
        marks = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema if f.name not in (PART, "_live")], PART, F.lit(False).alias("_live"))
        self._replace(result.unionByName(marks).repartition(PART), "result")
        rows = [r for r in now if r[0] in set(changed)] + [(p, None, None, None) for p in changed or [0]]
        self._replace(self.spark.createDataFrame(rows, f"{PART} int, source string, rows long, hash_sum string").coalesce(1), "fingerprints")
        for name in [*notes, note]:
            self.folder.remove(name)
        return changed

    def _replace(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.state_dir}/{name}")

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.state_dir}/result").where("_live").drop(PART, "_live")


def run_states(status: DataFrame) -> DataFrame:
    """(run_id, state): the state of each run is that of its row with the greatest updated_at (ties: the greatest state)."""
    return status.groupBy("run_id").agg(F.max(F.struct("updated_at", "state"))["state"].alias("state"))


def completed_versions(symbols: DataFrame, status: DataFrame) -> DataFrame:
    """(file_id, hash) of the rows of symbols that completed runs made.

    As a source of a refresh it lets a run that turns out completed, or failed after all, change the partitions of its files.
    """
    completed = run_states(status).where("state = 'completed'").select("run_id")
    return symbols.join(completed, "run_id", "left_semi").select("file_id", F.col("file_hash").alias("hash"))


def pending_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """file_id of the files whose current version is not among the completed ones (file_id, hash).

    The current version is the row with the greatest last_indexed; NULL is older than any time, and of rows of one
    time the greatest hash counts. A NULL hash has never been processed; rows without file_id are no files.
    """
    current = (
        files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("last_indexed", "hash"))["hash"].alias("hash"))
    )
    return current.join(done, ["file_id", "hash"], "left_anti").select("file_id")
