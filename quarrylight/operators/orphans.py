"""References to records that do not exist, kept up to date batch by batch.

The state is hashed by key into buckets and holds, per key, whether a parent exists and which references name it. A
batch brings new references, parents that arrived and parents that were deleted; only the buckets it touches are read
and rewritten: new references probe the parents, an arriving parent resolves the references that wait for it and a
deletion reopens them. A batch becomes visible by one commit file that names the version of each bucket, so a batch
that dies halfway leaves the state as it was and can run again.

Keys are (scope, id): ids of one scope share a parent index. NULL ids are no references and no parents; repeats count
once. Parents are counted as present or not, so a parent that arrives twice is gone after one deletion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.shared import Folder

REFERENCE = ["table_name", "field_name", "period", "scope", "id"]
STATE = "scope string, id long, present boolean, table_name string, field_name string, period string"


class OrphanTracker:
    def __init__(self, spark: SparkSession, state_dir: str, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.folder = Folder(spark, state_dir)

    def _last(self) -> tuple[int, dict[str, int]]:
        """Number of the last committed batch and the batch that wrote each bucket."""
        done = [int(n.removeprefix("commit-").removesuffix(".json")) for n in self.folder.names() if n.startswith("commit-")]
        return (max(done), self.folder.get_json(f"commit-{max(done)}.json")) if done else (0, {})

    def _read(self, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.folder.path}/batch={b}/_bucket={bucket}" for bucket, b in versions.items()])

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64("scope", "id"), F.lit(self.buckets)).cast("int"))

    def advance(self, references: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Apply a batch: references (table_name, field_name, period, scope, id), parents (scope, id) that came or went.

        A parent in both arrived and deleted is gone. Returns the number of the batch.
        """
        batch, versions = self._last()
        none = [F.lit(None).cast("string").alias(c) for c in REFERENCE[:3]]
        parts = []
        if references is not None:
            parts.append(references.where("id IS NOT NULL").select("scope", "id", F.lit(0).alias("rank"), *REFERENCE[:3]))
        for rank, df in ((1, arrived), (2, deleted)):
            if df is not None:
                parts.append(df.where("id IS NOT NULL").select("scope", "id", F.lit(rank).alias("rank"), *none))
        if not parts:
            return batch
        fresh = parts[0]
        for part in parts[1:]:
            fresh = fresh.unionByName(part)
        fresh = self._bucketed(fresh.distinct())
        if versions:
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most `buckets` rows
            old = self._bucketed(self._read({k: v for k, v in versions.items() if int(k) in set(touched)}))
            # Stored presence has the least say: rank 1 of the batch makes a key present, rank 2 absent.
            kept = old.select("scope", "id", F.when(F.col("present"), F.lit(-1)).otherwise(F.lit(-2)).alias("rank"), *REFERENCE[:3], "_bucket")
            fresh = fresh.unionByName(kept)
        # NULL ranks do not count: 0 says only that a reference names the key.
        saying = fresh.where("rank <> 0").groupBy("_bucket", "scope", "id").agg(F.max("rank").alias("said"))
        present = saying.select("_bucket", "scope", "id", F.col("said").isin(1, -1).alias("present"))
        named = fresh.select("_bucket", "scope", "id", *REFERENCE[:3]).where("table_name IS NOT NULL").distinct()
        # keys differ from rows only where a key has several references, so the join is one to few
        state = named.join(present, ["_bucket", "scope", "id"], "full_outer").withColumn("present", F.coalesce("present", F.lit(False)))
        out = f"batch={batch + 1}"
        self.folder.remove(out)  # left by a batch that died
        state.select("scope", "id", "present", *REFERENCE[:3], "_bucket").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.path}/{out}")
        written = {n.split("=")[1]: batch + 1 for n in self.folder.names(out) if n.startswith("_bucket=")}
        self.folder.put_json(f"commit-{batch + 1}.json", versions | written)
        return batch + 1

    def orphans(self) -> DataFrame:
        """(table_name, field_name, period, scope, id) of all references whose parent does not exist now."""
        return self._read(self._last()[1]).where("table_name IS NOT NULL AND NOT present").select(*REFERENCE)

    def counts(self) -> DataFrame:
        """(table_name, field_name, period, orphans) as of the last batch."""
        return self.orphans().groupBy("table_name", "field_name", "period").agg(F.countDistinct("id").alias("orphans"))
