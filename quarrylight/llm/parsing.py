"""Source files that are not valid in the language of their path.

A text is parsed against all grammars, and the tokens that begin its lines rank the languages that accept it. A
text that its own grammar accepts is valid; one that only others accept has a wrong extension, and the first of them in
ranked order is its language; one that none accepts is corrupt. Rows are judged where they are read, equal texts of a
task once, and only verdicts are shuffled to find each file's current row.

Defined cases: NULL content is no failure; an empty file and one of comments only are valid; a path without a known
extension is not judged (verdict NULL), nor is Python nested beyond what its parser holds; ``failure_rates`` counts both
as unjudged. A leading byte order mark is no part of the text; CR LF and CR end lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quarrylight.llm.grammars import EXTENSIONS, FOREIGN, PARSERS

VALID, CORRUPT = "valid", "corrupt"
REMEMBERED = 50_000

_FIRST = re.compile(r"^[ \t]*([#@]?[^\W\d]\w*|[#}/@;])", re.M)
#: Tokens that suggest a language when they begin a line.
_HINTS = {
    "py": "from import def class elif except with pass raise if for return self",
    "rs": "use pub fn let impl mod trait match struct enum #",
    "go": "package func import type var defer go if for return",
    "js": "const function var let export module require if for return",
    "ts": "import export interface const type enum private readonly var if for return",
    "java": "package import public private protected static final @Override class if for return",
    "c": "#include #define #ifdef #ifndef #endif static struct typedef long int void char if for return",
    "rb": "require require_relative def end class module attr_reader elsif unless puts if",
}
_WEIGHTS: dict[str, dict[str, float]] = {}
for _name, _words in _HINTS.items():
    for _word in _words.split():
        _WEIGHTS.setdefault(_word, {})[_name] = 1.0
for _of in _WEIGHTS.values():  # what several languages share says less
    for _name in _of:
        _of[_name] = 1.0 / len(_of)


def ranked(text: str) -> list[str]:
    """All languages, the likeliest first; ties keep the order of EXTENSIONS."""
    votes = dict.fromkeys(EXTENSIONS, 0.0)
    for token, n in Counter(_FIRST.findall(text)).items():
        for name, weight in _WEIGHTS.get(token, {}).items():
            votes[name] += n * weight
    return sorted(EXTENSIONS, key=lambda name: -votes[name])


def clean_path(path: Column) -> Column:
    """The path with slashes only, without ``.`` segments and repeated or leading slashes."""
    slashes = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(slashes, r"(?:(?<=/)|^)(?:\./)+", ""), r"^/", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def accepting(text: str, own: str) -> list[str] | None:
    """The languages whose grammars accept a text, the likeliest first; None if its own parser cannot tell."""
    text = text.removeprefix("﻿")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = {}
    for name in sorted(EXTENSIONS, key=lambda x: x != own):
        if name == "ts" and found.get("js") and own != "ts":
            found[name] = True  # TypeScript is a superset of JavaScript's syntax
        else:
            found[name] = PARSERS[name](text) if name == own else FOREIGN[name](text)
        if found[name] is None and name == own:
            return None
    names = [name for name in EXTENSIONS if found[name]]
    return names if len(names) < 2 else [name for name in ranked(text) if found[name]]


def judge(text: str | None, language: str) -> tuple[str | None, list[str]]:
    """The verdict (valid, corrupt, or the language that accepts the text instead of its own) and all that accept it."""
    if language not in PARSERS:
        return None, []
    if not text:
        return VALID, []
    names = accepting(text, language)
    if names is None:
        return None, []
    return VALID if language in names else names[0] if names else CORRUPT, names


@pandas_udf(StructType([StructField("verdict", StringType()), StructField("accepted", ArrayType(StringType()))]))
def _judged(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[bytes, str], tuple[str | None, list[str]]] = {}
    for text, language in texts:
        rows = []
        for t, x in zip(text, language):
            key = (xxhash.xxh3_128_digest(t), x) if t else (b"", x)
            out = known.get(key)
            if out is None:
                out = judge(t, x)
                if len(known) < REMEMBERED:
                    known[key] = out
            rows.append(out)
        yield pd.DataFrame(rows, columns=["verdict", "accepted"])


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, path, language, verdict, accepted) of the current row of each file: the greatest last_indexed, then hash."""
    path = clean_path(F.col("path"))
    judged = files.where("file_id IS NOT NULL").select("file_id", "last_indexed", "hash", path.alias("path"), extension(path).alias("language"), "content")
    judged = judged.withColumn("_j", _judged("content", "language"))
    latest = judged.groupBy("file_id").agg(F.max(F.struct("last_indexed", "hash", "path", "language", "_j")).alias("r"))
    return latest.select("file_id", "r.path", "r.language", "r._j.verdict", "r._j.accepted")


def failure_rates(judged: DataFrame) -> DataFrame:
    """(repository, language, files, unjudged, failed, wrong_extension, corrupt, failure_rate) of the rows of ``verdicts``.

    files counts all; the rate is of those that were judged, NULL where none was.
    """
    failed = F.coalesce(F.col("verdict") != VALID, F.lit(False))
    corrupt = F.coalesce(F.col("verdict") == CORRUPT, F.lit(False))
    return (
        judged.groupBy(F.substring_index("path", "/", 1).alias("repository"), "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict").isNull()).alias("unjudged"), F.count_if(failed).alias("failed"), F.count_if(failed & ~corrupt).alias("wrong_extension"), F.count_if(corrupt).alias("corrupt"))
        .withColumn("failure_rate", F.try_divide("failed", F.col("files") - F.col("unjudged")))
    )
