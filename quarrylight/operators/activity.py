"""Who changed what and when: contributors, churn, weekly summaries, module activity; and parsing of commit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def week_of(ts: Column) -> Column:
    """Monday of the week of a time."""
    return F.to_date(F.date_trunc("week", ts))


def parse_log(text: DataFrame, column: str = "value") -> DataFrame:
    """(hash, author, email, ts, subject, path) of log lines ``hash|author|email|epoch|subject`` and, below each, its paths.

    The input has line_no, the order of its lines, and source, the log it is from.
    """
    head = r"^([0-9a-f]{7,40})\|([^|]*)\|([^|]*)\|(\d+)\|(.*)$"
    begins = F.col(column).rlike(head)
    w = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = text.withColumn("_c", F.sum(begins.cast("int")).over(w)).where("_c > 0")
    heads = rows.where(begins).select("source", "_c", *[F.regexp_extract(column, head, i).alias(n) for i, n in enumerate(("hash", "author", "email", "ts", "subject"), 1)])
    paths = rows.where(~begins & (F.trim(column) != "")).select("source", "_c", F.col(column).alias("path"))
    return heads.join(paths, ["source", "_c"], "left").select("hash", "author", "email", F.col("ts").cast("long").alias("ts"), "subject", "path")


RECORD = "\x1e"  # ends a commit in logs written as ``%H|%an|%ae|%at|%s`` with this sign before each


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, author, email, ts, subject, path) of log files whose commits RECORD parts: each is a row, so a log of any size splits."""
    return parse_records(spark.read.option("lineSep", RECORD).text(path), "value")


def parse_records(records: DataFrame, column: str) -> DataFrame:
    """(hash, author, email, ts, subject, path) of commits, one text each: the head line and below it the paths, NULL where there is none."""
    rows = F.filter(F.split(F.trim(column), "\r?\n"), lambda x: F.trim(x) != "")
    head = r"^([0-9a-f]{7,40})\|([^|]*)\|([^|]*)\|(\d+)\|(.*)$"
    cut = records.select(rows.alias("_rows")).where(F.get("_rows", F.lit(0)).rlike(head))
    fields = [F.regexp_extract(F.col("_rows")[0], head, i).alias(n) for i, n in enumerate(("hash", "author", "email", "ts", "subject"), 1)]
    return cut.select(*fields, F.explode_outer(F.slice("_rows", F.lit(2), F.size("_rows"))).alias("path")).withColumn("ts", F.col("ts").cast("long")).select("hash", "author", "email", "ts", "subject", "path")


def contributors(commits: DataFrame) -> DataFrame:
    """(author, email, commits): commits per author, with the email of the first one."""
    return commits.groupBy("author").agg(F.min_by("email", F.struct("ts", "hash")).alias("email"), F.count_distinct("hash").alias("commits"))


def churn(changes: DataFrame, by: list[str]) -> DataFrame:
    """(*by, changes, top_author): number of changes and the author with most of them, the least of equal ones."""
    per = changes.groupBy(*by, "author").agg(F.count(F.lit(1)).alias("_n"))
    top = F.max(F.struct(F.col("_n"), (-F.col("author")).alias("_a")))
    return per.groupBy(*by).agg(F.sum("_n").alias("changes"), top.alias("_t")).select(*by, "changes", (-F.col("_t._a")).alias("top_author"))


def weekly(changes: DataFrame) -> DataFrame:
    """(week, commits, authors, files) per week that begins on Monday."""
    return changes.groupBy(week_of(F.col("ts")).alias("week")).agg(F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("authors"), F.count_distinct("file").alias("files"))


def top_per_week(changes: DataFrame, column: str, most: int = 3) -> DataFrame:
    """(week, column, changes, place): the busiest values of a column in each week."""
    per = changes.groupBy(week_of(F.col("ts")).alias("week"), column).agg(F.count(F.lit(1)).alias("changes"))
    w = Window.partitionBy("week").orderBy(F.desc("changes"), column)
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
