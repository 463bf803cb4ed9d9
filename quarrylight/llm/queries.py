"""Queries of the text problems 3, 5, 8, 9 and 10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe, garbled, packing, parsing, provenance
from quarrylight.plans.registry import Registry
from quarrylight.sources.shared import cut
from quarrylight.sources.tables import table

REGISTRY = Registry()


def _verdicts(spark: SparkSession, data_dir: str) -> DataFrame:
    return parsing.verdicts(table(spark, data_dir, "files").select("file_id", "path", "content", "hash", "last_indexed"))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _verdicts(spark, data_dir).where(F.col("verdict") != parsing.VALID).select("file_id")


@REGISTRY.add("p3_rates")
def p3_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Failures per repository and language; each row also has the failed_files that the last completed run reported in all."""
    status = table(spark, data_dir, "indexing_status").groupBy("run_id").agg(F.max(F.struct("updated_at", "state", "failed_files")).alias("r"))
    last = status.where("r.state = 'completed'").agg(F.max(F.struct("r.updated_at", "r.failed_files"))["failed_files"].alias("reported_failed_files"))
    reported = last.first()[0]  # one number
    return parsing.failure_rates(_verdicts(spark, data_dir)).withColumn("reported_failed_files", F.lit(reported).cast("long"))


def _origins(spark: SparkSession, data_dir: str) -> DataFrame:
    files = table(spark, data_dir, "files").select("file_id", "path", "content", "hash", "last_indexed")
    return provenance.origins(files, table(spark, data_dir, "vendor_catalog"))


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _origins(spark, data_dir).where("origin IS NOT NULL").select("file_id")


@REGISTRY.add("p5_origins")
def p5_origins(spark: SparkSession, data_dir: str) -> DataFrame:
    """Files per repository and origin; NULL is hand-written."""
    return _origins(spark, data_dir).groupBy(F.substring_index("path", "/", 1).alias("repository"), "origin").agg(F.count(F.lit(1)).alias("files"))


@REGISTRY.add("p8_ids")
def p8_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    return bpe.encode(table(spark, data_dir, "documents").select("doc_id", "text"))


def _packed(spark: SparkSession, data_dir: str, leftovers: tuple[bool, ...] = (True,)) -> list[DataFrame]:
    counts = cut(bpe.count_tokens(table(spark, data_dir, "documents").select("doc_id", "text")), "token-counts")
    containers = [(r.container_type, r.capacity_tokens) for r in table(spark, data_dir, "containers").where("container_type IS NOT NULL AND capacity_tokens > 0").orderBy("container_type").collect()]  # a fixed table
    return [packing.fill(counts, containers, leftovers=x) for x in leftovers]


@REGISTRY.add("p9_containers")
def p9_containers(spark: SparkSession, data_dir: str) -> DataFrame:
    """The container of every text, or of every piece of a text that alone exceeds the capacity."""
    return _packed(spark, data_dir)[0]


@REGISTRY.add("p9_harmonic")
def p9_harmonic(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same by independent classes with a fixed number of texts to a container."""
    return _packed(spark, data_dir, (False,))[0]


@REGISTRY.add("p9_fill")
def p9_fill(spark: SparkSession, data_dir: str) -> DataFrame:
    """Containers used by type and the share of their capacity that is filled, with and without the use of leftover space."""
    both = _packed(spark, data_dir, (True, False))
    placed = both[0].withColumn("leftovers", F.lit(True)).unionByName(both[1].withColumn("leftovers", F.lit(False)))
    used = placed.groupBy("leftovers", "container_type", "container_id").agg(F.sum("n_tokens").alias("used")).groupBy("leftovers", "container_type").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return used.join(table(spark, data_dir, "containers"), "container_type").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


@REGISTRY.add("p10_found")
def p10_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return garbled.restore(table(spark, data_dir, "documents").select("doc_id", "text")).select("doc_id")


@REGISTRY.add("p10_restored")
def p10_restored(spark: SparkSession, data_dir: str) -> DataFrame:
    """The garbled documents with the chain that garbled them and their text as far as it can be restored."""
    return garbled.restore(table(spark, data_dir, "documents").select("doc_id", "text"))
