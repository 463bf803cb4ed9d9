"""The present versions of the indexed files, as rows and as lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import clean_path, clean_path_sql, language_of, language_sql
from quarrylight.functions.text import LINES_SQL, line_array


def _located(files: DataFrame) -> DataFrame | None:
    """The rows with the file and the place in it that hold them, for tables of files; None for others."""
    try:
        return files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None


def corpus(files: DataFrame, content: bool = True) -> DataFrame:
    """(file_id, path, language, content, hash, line_count, branch, last_indexed) of the current row of each file.

    The current row, of repeats one, is found on narrow columns: it is known by its place in its file, so the texts are
    only read where they are and meet a set of places. A filter on the content runs at the scan and only what passes it
    is ever moved. Without content, it is not read. Tables that come from no files are told apart by their values.
    """
    path = clean_path(F.col("path"))
    columns = ["file_id", path.alias("path"), language_of(path).alias("language"), *["content"] * content, "hash", "line_count", "branch", "last_indexed"]
    located = _located(files)
    if located is not None and content:
        places = located.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("last_indexed", "hash", "_file", "_row")).alias("_k")).select("_k._file", "_k._row")
        return located.join(places, ["_file", "_row"], "left_semi").select(*columns)
    if located is not None:
        rest = ["path", "line_count", "branch"]
        newest = files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("last_indexed", "hash", *rest)).alias("_k"))
        return newest.select("file_id", "_k.*").select(*columns)
    current = files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("last_indexed", "hash")).alias("_k")).select(F.col("file_id").alias("_id"), "_k.*")
    current = current.withColumnsRenamed({"last_indexed": "_at", "hash": "_hash"})
    same = (F.col("file_id") == F.col("_id")) & F.col("last_indexed").eqNullSafe(F.col("_at")) & F.col("hash").eqNullSafe(F.col("_hash"))
    return files.join(current, same, "left_semi").select(*columns).distinct()


CORPUS_SQL = f"""
    cur AS (SELECT DISTINCT file_id, {clean_path_sql("path")} AS path, {language_sql("path")} AS language, content, hash, line_count, branch, last_indexed FROM files
        WHERE file_id IS NOT NULL QUALIFY rank() OVER (PARTITION BY file_id ORDER BY last_indexed DESC NULLS LAST, hash DESC NULLS LAST) = 1)
"""


def lines(texts: DataFrame, text: str = "content") -> DataFrame:
    """Rows of ``texts`` with line_no from 1 and line instead of the text."""
    kept = [c for c in texts.columns if c != text]
    return texts.select(*kept, F.posexplode(line_array(F.col(text))).alias("_pos", "line")).select(*kept, (F.col("_pos") + 1).alias("line_no"), "line")


LINES_CTE = f"{CORPUS_SQL}, lin AS (SELECT file_id, path, language, unnest(range(1, 1 + len(l)))::INT AS line_no, unnest(l) AS line FROM (SELECT *, {LINES_SQL.format('content')} AS l FROM cur))"
