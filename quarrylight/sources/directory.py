"""A folder of source files as a corpus, and a corpus as a store of contents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.paths import clean_path, glob_regex, language_of, prefixes
from quarrylight.functions.text import line_array
from quarrylight.sources.shared import Folder

MAX_BYTES = 10_485_760  # fixed value: larger files are not read


def ignore_pattern(rule: str, folder: str = "") -> tuple[str, bool] | None:
    """(pattern for whole paths, whether it takes back) of a line of an ignore file in a folder; None for blank lines and comments."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[back:]
    only_folders = rule.endswith("/")
    anchored = "/" in rule.rstrip("/")
    rule = rule.strip("/")
    body = "".join(
        {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", rule)
    )
    top = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    return f"^{top}{'' if anchored else '(?:.*/)?'}{body}{'/.+' if only_folders else '(?:/.*)?'}$", back


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a folder: files (path, language, content, hash, line_count, bytes), skipped (reason, files, bytes).

    Read are files of a known language, no larger than ``max_bytes``, that no ignore file above them names, that fit the
    globs and are UTF-8; what lies below a hidden folder is not seen. Sizes and paths decide before a byte is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = Folder(spark, root)._path("").toUri().getPath().rstrip("/")
    path = clean_path(F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", ""))
    listed = found.select(path.alias("path"), "length", "content").where(~F.col("path").rlike(r"(^|/)\.[^/]+(/|$)"))
    folders = listed.select(F.explode(F.concat(F.array(F.lit("")), prefixes(F.col("path")))).alias("f")).distinct().collect()  # one row per folder
    store, patterns = Folder(spark, root), []
    for folder in sorted((r.f for r in folders), key=lambda f: (f.count("/"), f)):
        name = f"{folder}/.gitignore".lstrip("/")
        if store.exists(name):
            patterns += [p for line in store.get_text(name).splitlines() if (p := ignore_pattern(line, folder))]
    ignored = F.lit(False)
    for pattern, back in patterns:  # the last that fits decides
        ignored = F.when(F.col("path").rlike(pattern), F.lit(not back)).otherwise(ignored)
    language = language_of(F.col("path"))
    wanted = F.lit(True)
    if include:
        wanted = F.col("path").rlike("|".join(glob_regex(g) for g in include))
    if exclude:
        wanted = wanted & ~F.col("path").rlike("|".join(glob_regex(g) for g in exclude))
    reason = F.when(ignored, "ignored").when(language.isNull(), "language").when(~wanted, "pattern").when(F.col("length") > max_bytes, "size")
    judged = listed.withColumn("reason", reason)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = judged.where("reason IS NULL").select("path", language.alias("language"), text.alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"))
    files = read.where("content IS NOT NULL").withColumn("line_count", F.size(line_array(F.col("content")))).select("path", "language", "content", "hash", "line_count", "bytes")
    skipped = judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return files, skipped


STORE_COLUMNS = {"path", "language", "content", "hash"}
STORE_VERSION = 1


class ContentStore:
    """The contents of a corpus by hash bucket of the path: written once, read by whole scans or by path."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.folder, self.buckets = spark, root.rstrip("/"), Folder(spark, root), buckets

    def write(self, files: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        rows = files.withColumn("bucket", bucket)
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/content")
        self.folder.remove("store.json")
        self.folder.put_json("store.json", {"version": STORE_VERSION, "buckets": self.buckets})

    def problem(self) -> str | None:
        """What is wrong with the store: missing, of another version, or without a column; None if it can be read."""
        if not self.folder.exists("store.json") or not self.folder.exists("content"):
            return "missing"
        settings = self.folder.get_json("store.json")
        if settings.get("version") != STORE_VERSION:
            return "version"
        self.buckets = settings["buckets"]
        lacking = STORE_COLUMNS - set(self.spark.read.parquet(f"{self.root}/content").columns)
        return f"columns {sorted(lacking)}" if lacking else None

    def read(self, rebuild=None) -> DataFrame:
        """The contents; a store that can't be read is written again from ``rebuild()`` or refused."""
        if problem := self.problem():
            if rebuild is None:
                raise FileNotFoundError(f"{self.root}: {problem}")
            self.write(rebuild())
        return self.spark.read.parquet(f"{self.root}/content")

    def one(self, path: str) -> DataFrame:
        """The row of a path: one folder is read."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(path)), F.lit(self.buckets)).cast("int")).first()[0]
        return self.read().where((F.col("bucket") == bucket) & (F.col("path") == path)).drop("bucket")


