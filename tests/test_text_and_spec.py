from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.corpus import corpus, lines
from quarrylight.functions.paths import clean_path, glob_regex, language_of, normalized_lookup, path_variants
from quarrylight.functions.text import PatternError, checked_regex, required_literals, trigram_array, truncated
from quarrylight.operators import search, trigram
from quarrylight.plans.spec import QueryError, QuerySpec, check, evaluation_score, instruction, parse_command

FILES = "path string, language string, content string"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def hits(df):
    return sorted((r.path, r.start_line) for r in df.collect())


def test_line_model(spark):
    rows = [("a", None, "a\nb\n"), ("b", None, ""), ("c", None, "a\r\nb"), ("d", None, "\n"), ("e", None, None), ("f", None, "x\r")]
    got = {}
    for r in lines(files(spark, rows)).collect():
        got.setdefault(r.path, []).append((r.line_no, r.line))
    assert got == {"a": [(1, "a"), (2, "b")], "c": [(1, "a"), (2, "b")], "d": [(1, "")], "f": [(1, "x\r")]}


WORDS = ["cat", "concat", "cat,dog", "CAT", "leéè", "@cat"]


def test_word_and_contains(spark):
    df = files(spark, [("f", "rust", "\n".join(WORDS)), ("n", None, None), ("e", None, "")])
    assert [n for _, n in hits(search.text_hits(df, QuerySpec(pattern="cat")))] == [1, 3, 6]
    assert [n for _, n in hits(search.text_hits(df, QuerySpec(pattern="cat", use_contains=True)))] == [1, 2, 3, 6]
    assert hits(search.text_hits(df, QuerySpec(pattern="le", force=True))) == []
    assert [n for _, n in hits(search.text_hits(df, QuerySpec(pattern=re.escape("cat"), use_regex=True)))] == [1, 2, 3, 6]


def test_index_finds_what_a_scan_finds(spark):
    df = lines(files(spark, [("f", None, "abcabc\nabd abc\nxéab\n\nab"), ("g", None, "zabcz")]))
    found = trigram.intersect(trigram.postings(df), trigram.grams_of("abc"))
    assert sorted(map(tuple, found.collect())) == [("f", 1), ("f", 2), ("g", 1)]
    sizes = spark.createDataFrame([("ab",), ("abc",), ("aébc",), (None,)], "s string").select(F.size(trigram_array(F.col("s"))))
    assert [r[0] for r in sizes.collect()][:3] == [0, 1, 3]


def test_pages_join_to_the_whole(spark):
    df = files(spark, [(p, None, "hit\nmiss\nhit") for p in "abcd"])
    every = search.text_hits(df, QuerySpec(pattern="hit"))
    pages = [search.paged(every, QuerySpec(pattern="hit", limit=3, offset=o)) for o in (0, 3, 6, 9)]
    assert [p.count for p in pages] == [3, 3, 2, 0] and {p.total for p in pages} == {8}
    assert [p.has_more for p in pages] == [True, True, False, False]
    assert [(r.path, r.start_line) for p in pages for r in p.rows.collect()] == hits(every)


def test_grouping_context_and_filters(spark):
    df = files(spark, [("src/a.go", "go", "1\n2\nhit\n4\n5"), ("b.rs", "rust", "hit")])
    spec = QuerySpec(pattern="hit", language="go", globs=("**/*.go",), excludes=("tests/**",))
    out = search.text_hits(df, spec)
    row = search.with_context(out, df, 1, 5).first()
    assert (row.context_before, row.context_after) == (["2"], ["4", "5"])
    assert [(r.path, len(r.matches)) for r in search.grouped(out).collect()] == [("src/a.go", 1)]
    assert [r.start_line for r in search.paths_only(out).collect()] == [3]


def test_regex_literals_are_sound():
    want = {"foo|ab": [], "[abc]x": [], "(foo)?ba": [], "(?i)test": [], "a.*b": [], "class.*Controller": ["class", "Controller"], "abcd?e": ["abc"], "ab{2}cde": ["cde"], r"fn\s+main": ["main"], r"a\.bc": ["a.bc"], "[]abc]xyz": ["xyz"]}
    assert {p: required_literals(p) for p in want} == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc.*?+|()[]", max_size=8), st.text(alphabet="abc", max_size=10))
def test_required_literals_are_in_every_match(pattern, text):
    try:
        matched = re.search(pattern, text)
    except re.error:
        return
    if matched:
        assert all(x in text for x in required_literals(pattern))


def test_patterns_outside_the_dialect_are_refused():
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "a++", "("):
        with pytest.raises(PatternError):
            checked_regex(bad)
    assert checked_regex(r"fn test_\d+") == r"fn test_\d+"


def test_checks():
    def code(spec, **kw):
        with pytest.raises(QueryError) as e:
            check(spec, **kw)
        return e.value.code

    assert code(QuerySpec(pattern="ab")) == "short"
    check(QuerySpec(pattern="ab", force=True))
    check(QuerySpec(pattern="ab", use_regex=True))
    check(QuerySpec(pattern="fn", symbols=True))
    assert code(QuerySpec(pattern="abc"), files=30_000) == "broad"
    check(QuerySpec(pattern="abcd"), files=30_000)
    assert code(QuerySpec(pattern="x", use_regex=True, use_contains=True)) == "conflict"
    assert code(QuerySpec(pattern="abc", limit=0)) == "limit"
    assert code(QuerySpec(pattern="(x)", use_ast=True)) == "language"
    assert code(QuerySpec(pattern="(x)", use_ast=True, language="rust"), candidates=100) == "broad"
    assert code(QuerySpec(pattern="class", symbols=True), candidates=20_001) == "broad"


def test_keywords_stand_for_kinds():
    assert QuerySpec(pattern="fn", symbols=True).resolved().kind == "Function"
    assert QuerySpec(pattern="record", symbols=True).resolved().kind == "Struct"
    assert QuerySpec(pattern="class", kind="Method").resolved().kind == "Method"
    assert not QuerySpec(pattern="CLASS", symbols=True).keyword
    assert QuerySpec(pattern="abc", paths_only=True).resolved().limit is None


def test_command_strings():
    spec = parse_command('query "fn main" --lang rs --kind function --limit 5 --glob "**/*.rs" --what')
    assert (spec.pattern, spec.language, spec.kind, spec.limit, spec.globs, spec.unknown) == ("fn main", "rust", "Function", 5, ("**/*.rs",), ("--what",))
    assert parse_command("query abc").limit is None
    for bad in ("query", "query --lang rust", "query x --limit many", "query x --lang"):
        with pytest.raises(QueryError):
            parse_command(bad)


def test_instruction_and_score():
    assert instruction(1, 1, False, QuerySpec(pattern="abc", symbols=True)) == "single_symbol"
    assert instruction(3, 3, False, QuerySpec(pattern="abc", language="go")) == "language_narrow"
    assert evaluation_score(0, 1, 10, 1, gathered=True)[0] == pytest.approx(0.4)
    assert evaluation_score(0, 0, 10, 1, confidence=0.95) == (1.0, True)


def test_globs():
    assert re.match(glob_regex("**/*.rs"), "src/a.rs") and re.match(glob_regex("**/*.rs"), "a.rs")
    assert re.match(glob_regex("src/*.rs"), "src/x/y.rs") and not re.match(glob_regex("src/*.rs"), "lib/y.rs")
    assert re.match(glob_regex("*.{ts,js}"), "a/b.js") and re.match(glob_regex("[!a]?"), "bc")


def test_paths(spark):
    df = spark.createDataFrame([("./a//b/./c.RS",), ("a\\b.py",), ("/x/y.txt",), (None,)], "p string")
    out = df.select(clean_path(F.col("p")).alias("p")).select("p", language_of(F.col("p")).alias("l")).collect()
    assert [tuple(r) for r in out] == [("a/b/c.RS", "rust"), ("a/b.py", "python"), ("x/y.txt", None), (None, None)]
    looked = spark.createDataFrame([("../../a.py",), ("/home/me/app/src/x.php",), ("/etc/hosts",)], "p string").select(normalized_lookup(F.col("p"))).collect()
    assert [r[0] for r in looked] == ["a.py", "src/x.php", "hosts"]
    variants = spark.createDataFrame([("crate::a::b",)], "p string").select(path_variants(F.col("p"))).first()[0]
    assert variants[:2] == ["crate/a/b.php", "crate/a/b.rs"] and variants[-1] == "b.py"


def test_previews_are_cut_at_spaces(spark):
    rows = [("short",), ("aaa bbb ccc",), ("a" * 20,)]
    got = spark.createDataFrame(rows, "s string").select(truncated(F.col("s"), 9)).collect()
    assert [r[0] for r in got] == ["short", "aaa bbb…", "a" * 9 + "…"]


def test_current_rows_of_files(spark):
    schema = "file_id long, path string, language string, content string, hash string, line_count int, branch string, last_indexed timestamp, extra int"
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(1, "./a.rs", None, "old", "h0", 1, None, t, 1), (1, "a.rs", None, "new", "h1", 1, None, t + dt.timedelta(1), 1), (1, "a.rs", None, "new", "h1", 1, None, t + dt.timedelta(1), 1), (2, "b", None, None, None, None, None, None, 1), (None, "c", None, "x", "h", 1, None, t, 1)]
    got = sorted((r.file_id, r.path, r.language, r.content) for r in corpus(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "a.rs", "rust", "new"), (2, "b", None, None)]
    assert corpus(spark.createDataFrame([], schema)).count() == 0
