"""Queries of the general data problems 1, 2, 4, 6 and 7, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.hierarchy import cycle_ids, descendants, hierarchy, paths
from quarrylight.operators.incremental import PartitionedRefresh, completed_versions, pending_files
from quarrylight.operators.orphans import OrphanTracker
from quarrylight.operators.skew import salted_aggregate
from quarrylight.operators.snapdiff import ROWS_PER_BUCKET, candidates, classified, row_hash
from quarrylight.plans.registry import Registry
from quarrylight.sources.shared import cut, shared_dir
from quarrylight.sources.tables import table

REGISTRY = Registry()
HEAVY_SHARE = 0.015
STATE_ROWS = 2_000_000  # rows per partition of a state table


def _partitions(*tables: DataFrame) -> int:
    """Partitions for the state of tables, from their row counts in the Parquet footers."""
    return max(32, -(-sum(t.count() for t in tables) // STATE_ROWS))


_P1_SQL = """
    WITH cur AS (SELECT file_id, arg_max(hash, coalesce(last_indexed, TIMESTAMP '0001-01-01')) AS hash FROM files GROUP BY file_id),
    runs AS (SELECT run_id, arg_max(state, updated_at) AS state FROM indexing_status GROUP BY run_id)
    SELECT file_id FROM cur WHERE NOT EXISTS (SELECT 1 FROM symbols s JOIN runs r ON s.run_id = r.run_id
        WHERE r.state = 'completed' AND s.file_id = cur.file_id AND s.file_hash = cur.hash)
    """


def _sources1(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, data_dir, "files").select("file_id", "last_indexed", "hash"),
        table(spark, data_dir, "symbols").select("file_id", "file_hash", "run_id", "last_cached"),
        table(spark, data_dir, "indexing_status").select("run_id", "state", "updated_at"),
    )


def _refresh1(refresh: PartitionedRefresh, files: DataFrame, symbols: DataFrame, status: DataFrame) -> list[int]:
    return refresh.run({"files": files, "done": completed_versions(symbols, status)}, lambda s: pending_files(s["files"], s["done"]))


@REGISTRY.add("p1_found", _P1_SQL)
def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Files whose current version no completed run has processed: a first run of the refreshed result."""
    files, symbols, status = _sources1(spark, data_dir)
    refresh = PartitionedRefresh(spark, shared_dir(spark, "pending-files"), "file_id", _partitions(files, symbols))
    _refresh1(refresh, files, symbols, status)
    return refresh.result()


def _refreshed_thrice(spark: SparkSession, data_dir: str) -> tuple[PartitionedRefresh, list[int]]:
    """The tables as of a day before the last index time, then as they are, then unchanged; partitions recomputed by each run."""
    files, symbols, status = _sources1(spark, data_dir)
    refresh = PartitionedRefresh(spark, shared_dir(spark, "pending-files"), "file_id", _partitions(files, symbols))
    day_before = files.agg(F.max("last_indexed") - F.expr("INTERVAL 1 DAY")).first()[0]

    def earlier(df: DataFrame, time: str) -> DataFrame:
        return df.where(F.col(time).isNull() | (F.col(time) < F.lit(day_before)))

    runs = [_refresh1(refresh, earlier(files, "last_indexed"), earlier(symbols, "last_cached"), earlier(status, "updated_at"))]
    runs += [_refresh1(refresh, files, symbols, status) for _ in range(2)]
    return refresh, [len(changed) for changed in runs]


@REGISTRY.add("p1_refreshed", _P1_SQL)
def p1_refreshed(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same result by a state that was built on earlier tables and then followed the changes."""
    return _refreshed_thrice(spark, data_dir)[0].result()


@REGISTRY.add("p1_runs")
def p1_runs(spark: SparkSession, data_dir: str) -> DataFrame:
    """How many partitions each of the three runs recomputed; the last one, on unchanged tables, none."""
    refresh, runs = _refreshed_thrice(spark, data_dir)
    return spark.createDataFrame([(i + 1, n, refresh.partitions) for i, n in enumerate(runs)], "run int, recomputed int, partitions int")


@REGISTRY.add(
    "p2_found",
    """
    SELECT target_file_id FROM dependency_edges WHERE target_file_id IS NOT NULL GROUP BY target_file_id
    HAVING count(*) >= 0.015 * (SELECT count(*) FROM dependency_edges)
    """,
)
def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    edges = table(spark, data_dir, "dependency_edges")
    least = HEAVY_SHARE * edges.count()  # from the Parquet footers
    return salted_aggregate(edges, "target_file_id", {}).where(F.col("rows") >= F.lit(least)).select("target_file_id")


@REGISTRY.add(
    "p2_targets",
    """
    SELECT target_file_id, count(*) AS rows, count(DISTINCT source_file_id) AS importers, count(DISTINCT snapshot_id) AS snapshots,
        count(DISTINCT import_type) AS types
    FROM dependency_edges WHERE target_file_id IS NOT NULL GROUP BY target_file_id
    """,
)
def p2_targets(spark: SparkSession, data_dir: str) -> DataFrame:
    """Importers, snapshots and import types of every target, complete."""
    edges = table(spark, data_dir, "dependency_edges")
    return salted_aggregate(edges, "target_file_id", {"importers": "source_file_id", "snapshots": "snapshot_id", "types": "import_type"})


_MOD_LINKS = """
    links AS (SELECT DISTINCT source_file_id AS parent, target_file_id AS child FROM dependency_edges
        WHERE import_type = 'mod_decl' AND target_file_id IS NOT NULL AND snapshot_id = (SELECT max(snapshot_id) FROM dependency_edges)),
    ids AS (SELECT child AS id FROM links UNION SELECT parent FROM links WHERE parent IS NOT NULL),
    tree AS (SELECT id, id AS root, 0 AS depth, [id] AS path FROM ids WHERE id NOT IN (SELECT child FROM links WHERE parent IS NOT NULL)
        UNION ALL SELECT l.child, t.root, t.depth + 1, list_append(t.path, l.child) FROM tree t JOIN links l ON l.parent = t.id)
"""


def _mod_links(spark: SparkSession, data_dir: str) -> DataFrame:
    edges = table(spark, data_dir, "dependency_edges")
    last = edges.agg(F.max("snapshot_id")).first()[0]
    return edges.where((F.col("import_type") == "mod_decl") & (F.col("snapshot_id") == F.lit(last))).select("source_file_id", "target_file_id")


@REGISTRY.add("p4_found", f"WITH RECURSIVE {_MOD_LINKS} SELECT id AS file_id FROM ids WHERE id NOT IN (SELECT id FROM tree)")
def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return cycle_ids(_mod_links(spark, data_dir), "target_file_id", "source_file_id").select(F.col("id").alias("file_id"))


@REGISTRY.add(
    "p4_hierarchy",
    f"""WITH RECURSIVE {_MOD_LINKS}, below AS (SELECT a AS id, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS a FROM tree) GROUP BY a)
    SELECT t.id AS file_id, t.root, t.depth, array_to_string(t.path, '/') AS path, b.descendants FROM tree t JOIN below b ON t.id = b.id""",
)
def p4_hierarchy(spark: SparkSession, data_dir: str) -> DataFrame:
    """Path from the root, depth, root and number of descendants of every file in a tree."""
    tree = hierarchy(_mod_links(spark, data_dir), "target_file_id", "source_file_id")
    whole = tree.join(paths(tree), "id")
    return whole.select(F.col("id").alias("file_id"), "root", F.col("depth").cast("int").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "descendants")


@REGISTRY.add(
    "p4_descendants",
    f"WITH RECURSIVE {_MOD_LINKS} SELECT a AS file_id, id AS descendant FROM (SELECT id, unnest(path) AS a FROM tree) WHERE a <> id",
)
def p4_descendants(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every file with each of its descendants: the files in its nested-set range."""
    tree = hierarchy(_mod_links(spark, data_dir), "target_file_id", "source_file_id")
    return descendants(tree).select(F.col("id").alias("file_id"), "descendant")


def _month(snapshot_id: str = "snapshot_id"):
    return F.concat(F.substring(snapshot_id, 1, 4), F.lit("-"), F.substring(snapshot_id, 5, 2))


def _references(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    of_symbols = symbols.select(F.lit("symbols").alias("table_name"), F.lit("file_id").alias("field_name"), F.date_format("last_cached", "yyyy-MM").alias("period"), F.lit("").alias("scope"), F.col("file_id").alias("id"))
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("id")) for c in ("source_file_id", "target_file_id")]))
    of_edges = edges.select("snapshot_id", ends.alias("end"))
    of_edges = of_edges.select(F.lit("dependency_edges").alias("table_name"), "end.field_name", _month().alias("period"), F.col("snapshot_id").alias("scope"), "end.id")
    return of_symbols.unionByName(of_edges)


def _parents(files: DataFrame, snap_files: DataFrame) -> DataFrame:
    return files.select(F.lit("").alias("scope"), F.col("file_id").alias("id")).unionByName(snap_files.select(F.col("snapshot_id").alias("scope"), "id"))


def _tables6(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    core = table(spark, data_dir, "core_files").select("file_id").withColumnRenamed("file_id", "id")
    return (
        table(spark, data_dir, "symbols").select("file_id", "last_cached"),
        table(spark, data_dir, "dependency_edges").select("snapshot_id", "source_file_id", "target_file_id", "loaded_at"),
        table(spark, data_dir, "files").select("file_id", "last_indexed"),
        table(spark, data_dir, "snap_files").select("snapshot_id", "id", "loaded_at"),
        core,
    )


def _not_core(df: DataFrame, core: DataFrame) -> DataFrame:
    """The shared core exists in every scope; it is the same 40 files at every scale, so it is taken out by broadcast."""
    return df.join(F.broadcast(core), "id", "left_anti")


_P6_REFS = """
    refs AS (SELECT 'symbols' AS table_name, 'file_id' AS field_name, strftime(last_cached, '%Y-%m') AS period, '' AS scope, file_id AS id FROM symbols
        UNION SELECT 'dependency_edges', 'source_file_id', substr(snapshot_id, 1, 4) || '-' || substr(snapshot_id, 5, 2), snapshot_id, source_file_id FROM dependency_edges
        UNION SELECT 'dependency_edges', 'target_file_id', substr(snapshot_id, 1, 4) || '-' || substr(snapshot_id, 5, 2), snapshot_id, target_file_id FROM dependency_edges),
    parents AS (SELECT '' AS scope, file_id AS id FROM files UNION SELECT snapshot_id, id FROM snap_files),
    orphans AS (SELECT DISTINCT table_name, field_name, period, id AS file_id FROM refs r WHERE id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM core_files c WHERE c.file_id = r.id) AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.scope = r.scope AND p.id = r.id))
"""


def _tracked(spark: SparkSession, data_dir: str) -> OrphanTracker:
    symbols, edges, files, snap_files, core = _tables6(spark, data_dir)
    tracker = OrphanTracker(spark, shared_dir(spark, "orphans"), _partitions(symbols, edges))
    tracker.advance(references=_not_core(_references(symbols, edges), core), arrived=_parents(files, snap_files))
    return tracker


@REGISTRY.add("p6_found", f"WITH {_P6_REFS} SELECT * FROM orphans")
def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _tracked(spark, data_dir).orphans().select("table_name", "field_name", "period", F.col("id").alias("file_id")).distinct()


@REGISTRY.add("p6_counts", f"WITH {_P6_REFS} SELECT table_name, field_name, period, count(DISTINCT file_id) AS orphans FROM orphans GROUP BY ALL")
def p6_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same state fed in two batches, split where half of the load times are past: late rows meet what waits for them."""
    symbols, edges, files, snap_files, core = _tables6(spark, data_dir)
    middle = F.lit(edges.agg(F.expr("timestamp_micros(bigint(avg(unix_micros(cast(loaded_at AS timestamp)))))")).first()[0])
    tracker = OrphanTracker(spark, shared_dir(spark, "orphans"), _partitions(symbols, edges))
    for first in (True, False):
        def now(df: DataFrame, time: str) -> DataFrame:
            early = F.coalesce(F.col(time).cast("timestamp") < middle, F.lit(False))
            return df.where(early if first else ~early)

        references = _references(now(symbols, "last_cached"), now(edges, "loaded_at"))
        tracker.advance(references=_not_core(references, core), arrived=_parents(now(files, "last_indexed"), now(snap_files, "loaded_at")))
    return tracker.counts()


_P6_LEFT = _P6_REFS.replace("UNION SELECT snapshot_id, id FROM snap_files)", "UNION SELECT snapshot_id, id FROM snap_files WHERE snapshot_id < (SELECT max(snapshot_id) FROM snap_files))")


@REGISTRY.add("p6_reopened", f"WITH {_P6_LEFT} SELECT table_name, field_name, period, count(DISTINCT file_id) AS orphans FROM orphans GROUP BY ALL")
def p6_reopened(spark: SparkSession, data_dir: str) -> DataFrame:
    """A further batch that deletes the files of the last snapshot: what referred to them waits again."""
    tracker = _tracked(spark, data_dir)
    snap_files = table(spark, data_dir, "snap_files").select("snapshot_id", "id")
    last = snap_files.agg(F.max("snapshot_id")).first()[0]
    tracker.advance(deleted=snap_files.where(F.col("snapshot_id") == F.lit(last)).select(F.col("snapshot_id").alias("scope"), "id"))
    return tracker.counts()


def _with_ends(edges: DataFrame, known: DataFrame, core: DataFrame) -> DataFrame:
    """Edges with source_v and target_v, what ``known`` (snapshot_id, id, v) or the core (id, v) says of their ends.

    Edges with an unknown end are left out. The hottest targets are core files, which a broadcast of the fixed table of 40
    rows answers; such rows then join by a hash that no file has, so they are spread instead of meeting in one task.
    """
    core = F.broadcast(core.select("id", F.col("v").alias("_core")))
    out = edges
    for end, name in (("target_file_id", "target_v"), ("source_file_id", "source_v")):
        out = out.join(core.withColumnRenamed("id", end), end, "left").withColumn("_done", F.col("_core").isNotNull())
        out = out.withColumn("_id", F.when(F.col("_done"), F.xxhash64("source_file_id", "target_file_id")).otherwise(F.col(end)))
        of = known.select("snapshot_id", F.col("id").alias("_id"), F.col("v").alias("_v"), F.lit(False).alias("_done"))
        out = out.join(of, ["snapshot_id", "_id", "_done"], "left").withColumn(name, F.coalesce("_core", "_v")).drop("_core", "_v", "_id", "_done").where(F.col(name).isNotNull())
    return out


def _changes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Changes of files and edges. Edges are compared by the hashes of their paths; paths are fetched for what differs."""
    files = table(spark, data_dir, "snap_files").select("snapshot_id", "id", "path", "language", "line_count").where("path IS NOT NULL")
    edges = table(spark, data_dir, "dependency_edges").select("snapshot_id", "source_file_id", "target_file_id", "import_type")
    core = table(spark, data_dir, "core_files").select(F.col("file_id").alias("id"), F.col("path").alias("v"))
    known = files.select("snapshot_id", "id", F.col("path").alias("v")).distinct()
    snapshots = [r[0] for r in files.select("snapshot_id").union(edges.select("snapshot_id")).where("snapshot_id IS NOT NULL").distinct().collect()]  # one row per snapshot
    buckets = -(-(files.count() + edges.count()) // ROWS_PER_BUCKET)  # counts from the Parquet footers

    whole = edges.where("source_file_id IS NOT NULL AND target_file_id IS NOT NULL")
    hashed = cut(_with_ends(whole, known.withColumn("v", F.xxhash64("v")), core.withColumn("v", F.xxhash64("v"))), "edge-hashes")
    ends = [F.lit("edge"), F.col("source_v"), F.col("target_v")]
    edge_rows = hashed.select("snapshot_id", "source_file_id", "target_file_id", "import_type", F.xxhash64(*ends).alias("_k"), row_hash(ends, ["import_type"]).alias("_r"))
    path = [F.lit("file"), F.col("path")]
    file_rows = files.drop("id").select("*", F.xxhash64(*path).alias("_k"), row_hash(path, ["language", "line_count"]).alias("_r"))
    found = cut(candidates(edge_rows.select("snapshot_id", "_k", "_r").unionByName(file_rows.select("snapshot_id", "_k", "_r")), snapshots, buckets), "differing-keys")

    of_edges = _with_ends(edge_rows.join(found, ["snapshot_id", "_k"]).select("snapshot_id", "source_file_id", "target_file_id", "import_type", "_step", "later"), known, core)
    of_edges = of_edges.select("_step", "later", F.lit("edge").alias("record_kind"), F.col("source_v").alias("path"), F.col("target_v").alias("target_path"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("line_count"), "import_type")
    of_files = file_rows.join(found, ["snapshot_id", "_k"]).select("_step", "later", F.lit("file").alias("record_kind"), "path", F.lit("").alias("target_path"), "language", "line_count", F.lit(None).cast("string").alias("import_type"))
    return classified(of_edges.unionByName(of_files), ["record_kind"], ["path", "target_path"], ["language", "line_count", "import_type"])


_P7_BASE = """
    snaps AS (SELECT snapshot_id, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS later FROM (SELECT DISTINCT snapshot_id FROM (SELECT snapshot_id FROM snap_files UNION SELECT snapshot_id FROM dependency_edges))),
    known AS (SELECT DISTINCT snapshot_id, id, path FROM snap_files UNION SELECT s.snapshot_id, c.file_id, c.path FROM snaps s, core_files c),
    recs AS (SELECT DISTINCT snapshot_id, 'file' AS record_kind, path, '' AS target_path, coalesce(language, chr(1)) || chr(2) || coalesce(line_count::VARCHAR, chr(1)) AS v FROM snap_files
        UNION SELECT e.snapshot_id, 'edge', s.path, t.path, coalesce(e.import_type, chr(1)) FROM dependency_edges e
            JOIN known s ON s.snapshot_id = e.snapshot_id AND s.id = e.source_file_id JOIN known t ON t.snapshot_id = e.snapshot_id AND t.id = e.target_file_id),
    news AS (SELECT r.* FROM recs r),
    olds AS (SELECT s.later AS snapshot_id, record_kind, path, target_path, v FROM recs r JOIN snaps s ON r.snapshot_id = s.snapshot_id WHERE s.later IS NOT NULL),
    changes AS (SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.record_kind, o.record_kind) AS record_kind,
            CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(n.path, o.path) AS path, coalesce(n.target_path, o.target_path) AS target_path
        FROM (SELECT * FROM news WHERE snapshot_id <> (SELECT min(snapshot_id) FROM snaps)) n
        FULL JOIN olds o ON n.snapshot_id = o.snapshot_id AND n.record_kind = o.record_kind AND n.path = o.path AND n.target_path = o.target_path
        WHERE n.path IS NULL OR o.path IS NULL OR n.v <> o.v)
"""


@REGISTRY.add("p7_found", f"WITH {_P7_BASE} SELECT DISTINCT snapshot_id, record_kind, change, path, target_path FROM changes")
def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _changes(spark, data_dir).select("snapshot_id", "record_kind", "change", "path", "target_path")
