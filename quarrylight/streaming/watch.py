"""File events as a stream: debounced batches of changed and deleted paths, and incremental classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET = "15 seconds"
EVENTS = "ts timestamp, source string, path string, is_removal boolean"


def eligible(events: DataFrame, extensions: list[str]) -> DataFrame:
    """Events of source files: no hidden files, only known extensions; removals of paths without extension stay."""
    name = F.element_at(F.split("path", "/"), -1)
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(extensions)
    return events.where(~name.startswith(".") & (known | F.col("is_removal") & ~F.contains(name, F.lit("."))))


def debounced(events: DataFrame, keys: list[str], time: str = "ts", quiet: str = QUIET, aggregates: list | None = None) -> DataFrame:
    """A row per burst of events: it ends when none came for ``quiet``. Works on tables and, with a watermark, on streams."""
    window = F.session_window(time, quiet)
    out = events.groupBy(window.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events"), *(aggregates or []))
    return out.select(*keys, F.col("_w.start").alias("began"), F.col("_w.end").alias("ended"), "events", *[c for c in out.columns if c not in ("_w", "events", *keys)])


def watch(spark: SparkSession, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], late: str = "1 minute", extensions: list[str] | None = None) -> StreamingQuery:
    """Follow a folder of event files and hand each ended burst of each source to ``on_batch``; starts the query.

    A burst holds its changed and deleted paths as sets. Events that come later than ``late`` after the newest one are
    dropped by the watermark, which also bounds the state.
    """
    stream = spark.readStream.schema(EVENTS).json(folder)
    if extensions:
        stream = eligible(stream, extensions)
    sets = [F.collect_set(F.when(~F.col("is_removal"), F.col("path"))).alias("changed"), F.collect_set(F.when(F.col("is_removal"), F.col("path"))).alias("deleted")]
    bursts = debounced(stream.withWatermark("ts", late), ["source"], aggregates=sets)
    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(availableNow=True).start()


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of (path, hash) tables: new, modified, unchanged or deleted."""
    o, n = old.select("path", F.col("hash").alias("_o"), F.lit(True).alias("_in_o")), new.select("path", F.col("hash").alias("_n"), F.lit(True).alias("_in_n"))
    status = F.when(F.col("_in_o").isNull(), "new").when(F.col("_in_n").isNull(), "deleted").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("modified")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))
