"""Lines, patterns, trigrams and previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """A pattern outside the regular language that both engines share."""


def line_array(content: Column) -> Column:
    """Lines of a text: split at LF or CR LF, without an empty line after the last one; NULL and empty give none."""
    parts = F.split(content, "\r?\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(kept)


#: The same in DuckDB.
LINES_SQL = """list_transform(range(1, 1 + (CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE len(string_split_regex({0}, '\r?\n')) - (CASE WHEN ends_with({0}, chr(10)) THEN 1 ELSE 0 END) END)), lambda n: string_split_regex({0}, '\r?\n')[n])"""


def word_pattern(literal: str) -> str:
    """Java pattern for a literal at word boundaries in the Unicode sense."""
    return r"(?U)\b" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal) + r"\b"


def word_pattern_re2(literal: str) -> str:
    """The same for engines whose \\b knows ASCII only; for literals that begin and end with word characters."""
    return r"(^|[^\p{L}\p{M}\p{N}_])" + re.escape(literal) + r"($|[^\p{L}\p{M}\p{N}_])"


def checked_regex(pattern: str) -> str:
    """The pattern, if it has neither look-around nor back-references and compiles."""
    if re.search(r"\(\?[=!]|\(\?<[=!]|\\[1-9]|\(\?P=|\\k<|\(\?>|[*+?}]\+", pattern):
        raise PatternError(f"look-around, back-references and possessive quantifiers are not supported: {pattern}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(f"invalid pattern {pattern!r}: {e}") from e
    return pattern


def required_literals(pattern: str) -> list[str]:
    """Literals of at least three bytes that every match of the pattern contains; none where that isn't certain.

    Only the top level of the pattern counts: alternations, groups, classes and anything optional give nothing.
    """
    if re.search(r"\(\?[a-zA-Z]*i", pattern):
        return []
    depth, i, run, out = 0, 0, "", []

    def end() -> None:
        nonlocal run
        if len(run.encode()) >= 3:
            out.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if pattern[i + 1].isalnum():  # a class or an anchor
                end()
            elif depth == 0:
                run += pattern[i + 1]
            i += 2
            continue
        if c == "[":
            end()
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            j += pattern[j : j + 1] == "]"
            while j < len(pattern) and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            i = j + 1
            continue
        if c == "(":
            end()
            depth += 1
        elif c == ")":
            end()
            depth -= 1
        elif c == "|":
            if depth == 0:
                return []
        elif c in "?*" or c == "{":
            run = run[:-1]
            end()
            if c == "{":
                i = pattern.find("}", i) if "}" in pattern[i:] else len(pattern)
        elif c == "+":
            end()
        elif c in ".^$":
            end()
        elif depth == 0:
            run += c
        i += 1
    end()
    return out


def trigram_array(text: Column) -> Column:
    """Overlapping three-byte grams of a text as upper-case hex, in order, repeats included."""
    bytes_ = text.cast("binary")
    n = F.octet_length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.hex(F.substring(bytes_, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def truncated(preview: Column, most: int) -> Column:
    """The preview if it has at most ``most`` bytes; else cut at the last space among its first ``most`` characters."""
    head = F.substring(preview, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.octet_length(preview) <= most, preview).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("…")))
