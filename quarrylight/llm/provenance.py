"""Files that no person of the repository wrote: generated, minified, vendored, or data stored as code.

Vendored code is found by Merkle hashes over the directory trees. A leaf is the hash of a file's text without comments
and white space, so cosmetic edits do not show; a directory is the hash of the sum and the number of its children's
hashes, which is additive, so a directory with very many children is no hot group. Names take no part. A subtree that
occurs in unrelated repositories, packages of the vendor catalog counting as repositories, is foreign if a copy of it
is known as foreign or it occurs in at least ``MANY_REPOSITORIES``; small files count only as part of a larger shared
subtree. Folders whose name says that they hold foreign code are vendored too.

Generated files show by a header among the comments before the first line of code, by the place or name that tools
write to, or by a layout of numbered declarations; minified files by dense long lines; data by consisting of literals.

Defined cases: NULL or empty content is no case but by its folder; unknown extensions are judged like the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quarrylight.llm.parsing import clean_path
from quarrylight.sources.shared import cut

LEAST_SHARED_CHARS = 200
MANY_REPOSITORIES = 3

VENDOR_FOLDER = r"(^|/)(third[_-]?party|3rd[_-]?party|vendor|vendored|vendors|external|externals|deps|extern|node_modules|bower_components|site-packages)/"
_GENERATED_PATH = re.compile(r"(^|/)(gen|generated|autogen|__generated__|auto_generated|codegen-out)/|\.(gen|g|generated|pb|pb\.gw|designer)\.\w+$|([._-](generated|autogen|gen|pb2|grpc)|Grpc)(?=[._-])[^/]*$", re.I)
_MINIFIED_PATH = re.compile(r"[._-](min|bundle|prod)(?=[._-])[^/]*\.(js|ts|css)$")
_HEADER = re.compile(
    r"^[\s/*#<!;-]*("
    r"code generated (by|with|from)\b|(this|the) (file|code|source|module) (was|is|has been) (auto|machine|mechanic|generated|created by a)|auto-?\s?generated (file|code|source|with|by|from)\b"
    r"|generated (source|code|file|by|from|with)\b|@generated\b|<auto-?generated|machine[- ](generated|written|made)\b|(diese|die) datei wurde (automatisch|maschinell)|automatisch (erzeugt|generiert)"
    r"|(ce fichier|este (archivo|ficheiro|arquivo)) (a été|fue|ha sido|foi) (généré|generado|gerado)|produced (automatically|mechanically) by)",
    re.I,
)
#: Strings are matched first and kept: they may hold what looks like a comment.
_COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`)|/\*.*?(?:\*/|\Z)|//[^\n]*|^\s*=begin\b.*?(?:^=end\b[^\n]*|\Z)|(?:#(?!\s*(?:include|define|if|endif|pragma|else|undef)\b|!?\[))[^\n]*", re.S | re.M)
_NUMBERED = re.compile(r"\b[A-Za-z_]\w*?(\d+)\b")
_BLOB = re.compile(r"\"[A-Za-z0-9+/=]{44,}\"|(?:(?:0[xX][\da-fA-F]+|-?\d+(?:\.\d+)?)\s*,\s*){12,}|\{\s*\"\w+\"\s*:\s*[^{}]*\}")


def _lines_of(text: str) -> Iterator[str]:
    """The lines of a text, one at a time: what follows the header is not cut up."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        if end < 0:
            yield text[at:]
            return
        yield text[at:end]
        at = end + 1


def header_lines(text: str) -> list[str]:
    """The comment lines before the first line of code, however many there are."""
    out, block = [], ""
    for line in _lines_of(text):
        bare = line.strip()
        if block:
            out.append(bare)
            if block in bare:
                block = ""
        elif bare.startswith(("/*", "<!--")):
            out.append(bare)
            block = "" if "*/" in bare or "-->" in bare else "*/" if bare[0] == "/" else "-->"
        elif bare.startswith("=begin"):
            block = "=end"
        elif not bare or bare.startswith("//") or bare[0] == "#" and not re.match(r"#\s*(include|define|if|ifndef|ifdef|pragma)\b|#!?\[", bare):
            out.append(bare)
        else:
            break
    return out


def _numbered_layout(code: str, lines: int) -> bool:
    """Declarations named by a running number make up the file."""
    numbers = [int(n) for n in _NUMBERED.findall(code) if len(n) < 6]
    if len(numbers) < 6 or len(numbers) * 12 < lines:
        return False
    seen = sorted(set(numbers))
    run = best = 1
    for a, b in zip(seen, seen[1:]):
        run = run + 1 if b == a + 1 else 1
        best = max(best, run)
    # small numbers as in left1 or i64 also occur by hand; a run that counts through most of them does not
    return best >= 6 and best * 2 > len(seen)


def origin(path: str, text: str | None) -> str | None:
    """generated, minified, data, or None for what looks written by hand."""
    if _GENERATED_PATH.search(path):
        return "generated"
    if not text:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if any(map(_HEADER.match, header_lines(text))):
        return "generated"
    code = _COMMENT.sub(r"\1", text).strip()
    size = len(code)
    if not size:
        return None
    lines = code.count("\n") + 1
    if path.endswith((".js", ".ts")):
        blank = sum(map(code.count, " \t\n"))
        strings = sum(map(len, re.findall(r'"(?:[^"\\\n]|\\.)*"', code)))
        if blank < 0.08 * size and (size - strings) / lines > 150:
            return "minified"
        if _MINIFIED_PATH.search(path) and size / lines > 200:
            return "minified"
    if sum(len(m[0]) for m in _BLOB.finditer(code)) > 0.6 * size:
        return "data"
    if _numbered_layout(code, lines):
        return "generated"
    return None


def leaf(text: str | None) -> tuple[int, int]:
    """Hash and length of a text without comments and white space."""
    bare = "".join(_COMMENT.sub(r"\1", (text or "").replace("\r", "")).split())
    return xxhash.xxh3_64_intdigest(bare) - (1 << 63), len(bare)


@pandas_udf(StructType([StructField("origin", StringType()), StructField("leaf", LongType()), StructField("size", IntegerType())]))
def _features(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for paths, texts in parts:
        rows = [(origin(p or "", t), *leaf(t)) for p, t in zip(paths, texts)]
        yield pd.DataFrame(rows, columns=["origin", "leaf", "size"])


def _nodes(leaves: DataFrame) -> DataFrame:
    """(repository, folder, hash, files, size) of all folders, hashed bottom-up; a repository's root is left out."""
    here = leaves.select("repository", F.expr("slice(segments, 1, size(segments) - 1)").alias("folder"), F.xxhash64("leaf").alias("hash"), F.lit(1).cast("long").alias("files"), F.col("size").cast("long").alias("size"))
    deepest = here.agg(F.max(F.size("folder"))).first()[0] or 0
    done = level = None
    for depth in range(deepest, 1, -1):
        at = here.where(F.size("folder") == depth)
        if done is not None:
            up = level.select("repository", F.expr("slice(folder, 1, size(folder) - 1)").alias("folder"), F.xxhash64("hash", F.lit("folder")).alias("hash"), "files", "size")
            at = at.unionByName(up)
        level = at.groupBy("repository", "folder").agg(F.xxhash64(F.sum(F.col("hash").cast("decimal(20,0)")), F.count(F.lit(1))).alias("hash"), F.sum("files").alias("files"), F.sum("size").alias("size"))
        done = level if done is None else done.unionByName(level)
    return done if done is not None else here.limit(0)


def shared_subtrees(nodes: DataFrame) -> DataFrame:
    """(hash) of the subtrees in unrelated repositories; nodes has repository, hash, size and known (foreign)."""
    per = nodes.where(F.col("size") >= LEAST_SHARED_CHARS).groupBy("hash", "repository").agg(F.max("known").alias("known"))
    return per.groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"), F.max("known").alias("known")).where(f"repositories >= {MANY_REPOSITORIES} OR repositories > 1 AND known").select("hash")


def origins(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_id, path, origin) of the current row of each file; origin is generated, minified, data, vendored or NULL."""
    path = clean_path(F.col("path"))
    seen = files.where("file_id IS NOT NULL").select("file_id", "last_indexed", "hash", F.coalesce(path, F.lit("")).alias("path"), "content")
    seen = seen.withColumn("f", _features("path", "content"))
    current = seen.groupBy("file_id").agg(F.max(F.struct("last_indexed", "hash", "path", "f")).alias("r")).select("file_id", "r.path", "r.f.origin", "r.f.leaf", "r.f.size")
    current = cut(current, "origins").withColumn("segments", F.split("path", "/")).withColumn("repository", F.col("segments")[0]).withColumn("known", F.col("path").rlike(VENDOR_FOLDER))
    foreign = catalog.select(F.concat(F.lit("catalog:"), "package_name").alias("repository"), _features(F.lit(""), "content").alias("f"))
    folders = _nodes(current)
    of_files = current.select("repository", F.xxhash64("leaf").alias("hash"), F.col("size").cast("long").alias("size"), "known")
    of_catalog = foreign.select("repository", F.xxhash64("f.leaf").alias("hash"), F.col("f.size").cast("long").alias("size"), F.lit(True).alias("known"))
    of_folders = folders.where("files > 1").select("repository", "hash", "size", F.lit(False).alias("known"))
    shared = cut(shared_subtrees(of_files.unionByName(of_catalog).unionByName(of_folders)), "shared-subtrees")
    by_leaf = current.where(F.col("size") >= LEAST_SHARED_CHARS).select("file_id", F.xxhash64("leaf").alias("hash")).join(shared, "hash", "left_semi").select("file_id")
    shared_folders = folders.where("files > 1").join(shared, "hash", "left_semi").select("repository", "folder")
    above = current.select("file_id", "repository", F.explode(F.expr("transform(sequence(2, greatest(size(segments) - 1, 2)), n -> slice(segments, 1, n))")).alias("folder"))
    by_folder = above.join(shared_folders, ["repository", "folder"], "left_semi").select("file_id")
    vendored = by_leaf.unionByName(by_folder).distinct().withColumn("_shared", F.lit(True))
    kind = F.coalesce("origin", F.when(F.col("known") | F.col("_shared"), F.lit("vendored")))
    return current.join(vendored, "file_id", "left").select("file_id", "path", kind.alias("origin"))
