"""Text and symbol search: a QuerySpec over a corpus gives hits; hits are ordered, paged, grouped and given context."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.corpus import lines
from quarrylight.functions.paths import glob_regex
from quarrylight.functions.text import checked_regex, line_array, required_literals, word_pattern
from quarrylight.plans.spec import QuerySpec, check
from quarrylight.sources.shared import cut

ORDER = ["path", "start_line"]


def _or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def file_filter(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """Language, globs (any), excludes (none) and file substring."""
    if spec.language:
        df = df.where(F.col("language") == spec.language)
    if spec.globs:
        df = df.where(_or([F.col("path").rlike(glob_regex(g)) for g in spec.globs]))
    if spec.excludes:
        df = df.where(~_or([F.col("path").rlike(glob_regex(g)) for g in spec.excludes]))
    if spec.file:
        df = df.where(F.contains("path", F.lit(spec.file)))
    return df


def line_match(spec: QuerySpec, line: Column) -> tuple[Column, list[str]]:
    """Whether a line matches, and literals that its whole text must contain."""
    if spec.use_regex:
        pattern = checked_regex(spec.pattern)
        return line.rlike(pattern), required_literals(pattern)
    if spec.use_contains:
        return F.contains(line, F.lit(spec.pattern)), [spec.pattern]
    return F.contains(line, F.lit(spec.pattern)) & line.rlike(word_pattern(spec.pattern)), [spec.pattern]


_SLASHES = r"//.*|/\*.*?(?:\*/|$)"
_QUOTES = r"\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?"
_DOUBLE = r"\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)'"
#: What of a line is comment or string, by language; strings stand first, so what they hold begins no comment. The
#: patterns are in the syntax that Java and RE2 share, and see one line only.
NOT_CODE = {
    "rust": rf"r#*\".*?\"#*|{_DOUBLE}|{_SLASHES}", "c": rf"{_DOUBLE}|{_SLASHES}", "cpp": rf"{_DOUBLE}|{_SLASHES}", "go": rf"`[^`]*`?|{_DOUBLE}|{_SLASHES}", "java": rf"{_DOUBLE}|{_SLASHES}",
    "javascript": rf"`[^`]*`?|{_QUOTES}|{_SLASHES}", "typescript": rf"`[^`]*`?|{_QUOTES}|{_SLASHES}", "vue": rf"`[^`]*`?|{_QUOTES}|{_SLASHES}|<!--.*?(?:-->|$)", "svelte": rf"`[^`]*`?|{_QUOTES}|{_SLASHES}|<!--.*?(?:-->|$)",
    "python": rf"\"\"\".*?(?:\"\"\"|$)|'{{3}}.*?(?:'{{3}}|$)|{_QUOTES}|#.*", "ruby": rf"{_QUOTES}|#.*", "php": rf"{_QUOTES}|#.*|{_SLASHES}", "csharp": rf"@\"(?:[^\"]|\"\")*\"?|{_DOUBLE}|{_SLASHES}", "kotlin": rf"\"\"\".*?(?:\"\"\"|$)|{_DOUBLE}|{_SLASHES}", "zig": rf"\\\\.*|{_DOUBLE}|//.*",
}


def code_of(line: Column, language: Column) -> Column:
    """A line without its comments and strings; lines of other languages stay whole."""
    pattern = F.create_map(*[F.lit(x) for pair in NOT_CODE.items() for x in pair])
    return F.call_function("regexp_replace", line, F.coalesce(F.try_element_at(pattern, language), F.lit("(?!)")), F.lit(" "))


def code_of_sql(line: str, language: str) -> str:
    return f"CASE {language} " + " ".join("WHEN '{}' THEN regexp_replace({}, '{}', ' ', 'g')".format(name, line, p.replace("'", "''")) for name, p in NOT_CODE.items()) + f" ELSE {line} END"


def in_code(files: DataFrame, pattern: str) -> DataFrame:
    """The files that hold a literal outside of comments and strings, as far as single lines tell."""
    found = files.where(F.contains("content", F.lit(pattern)))
    return found.where(F.exists(line_array(F.col("content")), lambda line: F.contains(line, F.lit(pattern)) & F.contains(code_of(line, F.col("language")), F.lit(pattern))))


def text_hits(files: DataFrame, spec: QuerySpec, indexed: int | None = None) -> DataFrame:
    """(path, language, start_line, end_line, preview), one row per matching line; the checks of the spec come first.

    Literals that every match contains are tested on the whole text, which reaches the scan, before lines are made.
    indexed  number of files, for the check of short patterns in large corpora
    """
    check(spec, files=indexed)
    df = file_filter(files, spec)
    match, literals = line_match(spec, F.col("line"))
    for literal in literals:
        df = df.where(F.contains("content", F.lit(literal)))
    hits = lines(df.select("path", "language", "content")).where(match)
    return hits.select("path", "language", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("preview"))


def symbol_hits(symbols: DataFrame, spec: QuerySpec, files: DataFrame | None = None, candidates: int | None = None) -> DataFrame:
    """(path, language, start_line, end_line, kind, symbol, preview) of the symbols a spec asks for.

    A keyword lists all symbols; a regex keeps the symbols one of whose lines matches it; kind Function admits methods.
    Symbols of one name that begin on one line count once, functions before methods. With ``files``, a name is looked
    for in files that have it outside of comments and strings only.
    candidates  number of files that may have hits, for the checks of broad searches
    """
    spec = spec.resolved()
    check(spec, candidates=candidates)
    df = file_filter(symbols.where("symbol IS NOT NULL"), spec)
    if spec.use_regex:
        matched = text_hits(files, QuerySpec(pattern=spec.pattern, use_regex=True, language=spec.language, globs=spec.globs, excludes=spec.excludes, file=spec.file))
        matched = matched.groupBy("path").agg(F.sort_array(F.collect_set("start_line")).alias("_lines"))
        df = df.join(matched, "path").where(F.exists("_lines", lambda n: (n >= F.col("start_line")) & (n <= F.col("end_line")))).drop("_lines")
    elif spec.keyword:
        pass
    elif files is not None:
        df = df.join(in_code(file_filter(files, spec), spec.pattern).select("path").distinct(), "path", "left_semi")
    if spec.use_regex or spec.keyword:
        pass
    elif spec.use_contains:
        df = df.where(F.contains("symbol", F.lit(spec.pattern)))
    else:
        df = df.where(F.col("symbol") == spec.pattern)
    one = Window.partitionBy("path", "start_line", "symbol").orderBy("kind", "end_line", "preview")
    df = df.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    if spec.kind:
        df = df.where(F.col("kind").isin("Function", "Method") if spec.kind == "Function" else F.col("kind") == spec.kind)
    return df.select("path", "language", "start_line", "end_line", "kind", "symbol", "preview")


def paths_only(hits: DataFrame) -> DataFrame:
    """The first hit of each path."""
    rest = [c for c in hits.columns if c != "path"]
    return hits.groupBy("path").agg(F.min(F.struct("start_line", *[c for c in rest if c != "start_line"])).alias("_h")).select("path", *[F.col(f"_h.{c}").alias(c) for c in rest])


@dataclass
class Page:
    rows: DataFrame
    total: int
    count: int
    offset: int
    limit: int | None

    @property
    def has_more(self) -> bool:
        return self.total > self.offset + self.count


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy(*ORDER, *[c for c in hits.columns if c not in ORDER])


def page(hits: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """A slice in total order; an offset beyond the end gives no rows."""
    out = ordered(hits)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def paged(hits: DataFrame, spec: QuerySpec) -> Page:
    """A page with the number of all hits, both from one evaluation."""
    kept = cut(hits, "hits")
    total = kept.count()
    rows = page(kept, spec.offset, spec.limit)
    count = max(0, min(total - spec.offset, spec.limit if spec.limit is not None else total))
    return Page(rows, total, count, spec.offset, spec.limit)


def grouped(hits: DataFrame) -> DataFrame:
    """(path, language, matches) with the matches of a path in line order."""
    fields = [c for c in hits.columns if c not in ("path", "language")]
    return hits.groupBy("path").agg(F.min("language").alias("language"), F.sort_array(F.collect_list(F.struct(*sorted(fields, key=lambda c: c != "start_line")))).alias("matches"))


def with_context(hits: DataFrame, files: DataFrame, before: int, after: int) -> DataFrame:
    """Hits with the lines before and after them, cut off at the ends of the file.

    The hits of a file are gathered first and cut out of its lines once, so no text is copied per hit.
    """
    columns = [c for c in hits.columns if c != "path"]
    per_file = hits.groupBy("path").agg(F.collect_list(F.struct(*columns)).alias("_hits"))
    texts = files.select("path", "content").join(per_file, "path").select("path", "_hits", line_array(F.col("content")).alias("_l"))
    none = F.array().cast("array<string>")

    def shown(hit: Column) -> Column:
        start, end = hit["start_line"], hit["end_line"]
        first = F.greatest(start - before, F.lit(1))
        above, below = F.slice("_l", first, start - first), F.when(end < F.size("_l"), F.slice("_l", end + 1, F.lit(after))).otherwise(none)
        return F.struct(*[hit[c].alias(c) for c in columns], above.alias("context_before"), below.alias("context_after"))

    return texts.select("path", F.explode(F.transform("_hits", shown)).alias("_h")).select("path", *[F.col(f"_h.{c}").alias(c) for c in columns], "_h.context_before", "_h.context_after")


def expanded(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of several lines show them all instead of their preview."""
    many = files.join(hits.select("path").distinct(), "path", "left_semi").select("path", line_array(F.col("content")).alias("_l"))
    body = F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return hits.join(many, "path", "left").withColumn("preview", F.when((F.col("start_line") < F.col("end_line")) & F.col("_l").isNotNull(), body).otherwise(F.col("preview"))).drop("_l")


def merged(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Hits of several searches; of hits with the same place the one of the first search stays."""
    union = None
    for rank, df in parts:
        df = df.select("path", "language", "start_line", "end_line", "preview").withColumn("search", F.lit(rank))
        union = df if union is None else union.unionByName(df)
    return union.groupBy("path", "start_line", "end_line").agg(F.min(F.struct("search", "language", "preview")).alias("_h")).select("path", "_h.language", "start_line", "end_line", "_h.preview", "_h.search")


# Words that do not count as keywords of a question.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "should", "could", "may", "might", "can", "what", "how",
    "where", "when", "why", "which", "who",
)


def question_words(question: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"\s+", question.lower().strip())) if len(w) > 2 and w not in STOP_WORDS]


SECTIONS, SECTION_LINES = 3, 150  # fixed values: sections shown of a text, and lines after which a section ends a text


def section_scores(texts: DataFrame, question: str, key: str) -> DataFrame:
    """(key, section, title, score) of the first three sections of marked-up texts that score at least 2 for a question.

    A section begins at a line that starts with #; a keyword in the heading counts 10, each further line with it 1. A
    text is read up to the first section of more than 150 lines, that one left out.
    """
    words = question_words(question)
    numbered = lines(texts.select(key, "content"))
    heading = F.col("line").startswith("#")
    section = F.sum(heading.cast("int")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = sum((F.contains(F.lower("line"), F.lit(w)).cast("int") for w in words), F.lit(0))
    scored = numbered.withColumn("section", section).withColumn("_s", hits * F.when(heading, 10).otherwise(1))
    sections = scored.groupBy(key, "section").agg(F.max(F.when(heading, F.col("line"))).alias("title"), F.sum("_s").alias("score"), F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(key).orderBy("section")
    read = sections.withColumn("_long", F.max((F.col("_n") > SECTION_LINES).cast("int")).over(in_order)).where("_long = 0 AND score >= 2")
    return read.withColumn("_rank", F.row_number().over(in_order)).where(F.col("_rank") <= SECTIONS).select(key, "section", "title", "score")
