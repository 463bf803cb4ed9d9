from __future__ import annotations

import datetime as dt

import pytest

from quarrylight.engine import Engine
from quarrylight.operators import search, symbols
from quarrylight.plans.spec import QueryError, QuerySpec
from quarrylight.sources.directory import ContentStore, ignore_pattern, scan

RUST = "// ledger in a comment\nfn ledger_open(a: u8) {\n    let s = \"ledger\";\n}\nfn other() {}\n"
ONLY_TALK = "// ledger_open is elsewhere\nlet s = \"ledger_open\";\n"


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame([("r/a.rs", "rust", RUST), ("r/b.rs", "rust", ONLY_TALK), ("r/c.py", "python", "def f():\n    pass\n"), ("r/d.txt", None, None)], "path string, language string, content string")
    rows = symbols.extract(files, ["path", "language"]).withColumnRenamed("name", "symbol")
    return Engine(spark, files, rows)


def paths(df):
    return sorted((r.path, r.start_line) for r in df.collect())


def test_searches(engine):
    assert paths(engine.search(QuerySpec(pattern="ledger"))) == [("r/a.rs", 1), ("r/a.rs", 3)]
    assert paths(engine.find_symbol("ledger_open")) == [("r/a.rs", 2)]
    assert paths(engine.list_by_kind("Function")) == [("r/a.rs", 2), ("r/a.rs", 5), ("r/c.py", 1)]
    assert paths(engine.search_ast('(function_item name: (identifier) @n) (#match? @n "^led")', "rust", ("**/*.rs",))) == [("r/a.rs", 2)]
    assert paths(engine.search_ast("(function_item) @f", "rust", text_filter="fn other")) == [("r/a.rs", 2), ("r/a.rs", 5)]
    out = engine.search_with_metadata(QuerySpec(pattern="ledger", limit=1, context_after=1))
    assert (out.page.total, out.page.count, out.page.has_more) == (2, 1, True) and out.page.rows.first()["context_after"] == ["fn ledger_open(a: u8) {"]
    assert engine.command('query "ledger" --paths').page.count == 1


def test_refusals_and_warnings(engine, spark):
    for spec, code in ((QuerySpec(pattern="ab"), "short"), (QuerySpec(pattern="a", use_regex=True, use_contains=True), "conflict"), (QuerySpec(pattern="(x) @x", use_ast=True), "language"), (QuerySpec(pattern="abc", limit=0), "limit")):
        with pytest.raises(QueryError) as e:
            engine.search(spec)
        assert e.value.code == code
    with pytest.raises(QueryError) as e:
        Engine(spark, engine.files).find_symbol("x_y_z")
    assert e.value.code == "index"
    with pytest.raises(QueryError):
        Engine(spark, engine.files.drop("content"))
    assert "every file is read" in engine.search_with_metadata(QuerySpec(pattern="a.b", use_regex=True)).warnings[0]
    big = Engine(spark, engine.files)
    big._indexed = 30_000
    with pytest.raises(QueryError) as e:
        big.search(QuerySpec(pattern="abc"))
    assert e.value.code == "broad"


def test_time_limit(engine, spark):
    slow = engine.files.withColumn("content", spark_udf_sleep(spark)("content"))
    with pytest.raises(QueryError) as e:
        Engine(spark, slow).search(QuerySpec(pattern="ledger", timeout=2))
    assert e.value.code == "timeout"


def spark_udf_sleep(spark):
    from pyspark.sql.functions import udf

    def wait(x):
        import time

        time.sleep(20)
        return x

    return udf(wait, "string")


def test_status(engine, spark):
    t = dt.datetime(2025, 1, 1)
    files = engine.files.withColumn("last_indexed", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(t))
    runs = "run_id long, state string, updated_at timestamp"
    of = lambda rows, **kw: Engine(spark, files, None, spark.createDataFrame(rows, runs), **kw).status().state
    assert of([(1, "completed", t + dt.timedelta(1))]) == "fresh"
    assert of([(1, "completed", t - dt.timedelta(1))]) == "stale"
    assert of([(1, "running", t)]) == "missing" and of([]) == "missing"
    branches = spark.createDataFrame([("main", "abc")], "branch string, commit string")
    assert of([(1, "completed", t + dt.timedelta(1))], branches=branches, branch="main", commit="abc") == "fresh"
    assert of([(1, "completed", t + dt.timedelta(1))], branches=branches, branch="main", commit="def") == "stale"
    assert of([(1, "completed", t + dt.timedelta(1))], branches=branches, branch="other") == "stale"


def test_code_without_comments_and_strings(spark):
    from pyspark.sql import functions as F

    cases = [("rust", 'a("x // y"); // b', "a( ); "), ("python", "x = 'a' # b", "x =   "), ("go", "a := `b` /* c */ d", "a :=     d"), ("c", "a; /* open", "a;  "), ("ruby", 'p "x#{y}" # z', "p   "), ("other", "// x", "// x"), ("zig", "x \\\\ y", "x  ")]
    df = spark.createDataFrame(cases, "language string, line string, want string")
    for r in df.select("*", search.code_of(F.col("line"), F.col("language")).alias("got")).collect():
        assert r.got.split() == r.want.split(), r


def test_folder_scan(spark, tmp_path):
    for name, text in {"a.rs": "fn a() {}\n", "b/c.py": "x = 1\ny = 2", "b/.gitignore": "skip*\n!skip_not.py\n# no\n", "b/skip_me.py": "z", "b/skip_not.py": "z", ".gitignore": "/out/\n*.gen.go\n", "out/x.rs": "x", "d/out/y.rs": "y", "d/e.gen.go": "package a", "n.txt": "n", ".hidden/h.py": "h", "b c/ü+1.py": "u = 1\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "big.py").write_text("x" * 100)
    files, skipped = scan(spark, str(tmp_path), max_bytes=50)
    assert sorted((r.path, r.language, r.line_count) for r in files.collect()) == [("a.rs", "rust", 1), ("b c/ü+1.py", "python", 1), ("b/c.py", "python", 2), ("b/skip_not.py", "python", 1), ("d/out/y.rs", "rust", 1)]
    assert {r.reason: r.files for r in skipped.collect()} == {"ignored": 3, "language": 1, "size": 1}
    assert ignore_pattern("  ") is None and ignore_pattern("# x") is None
    store = ContentStore(spark, str(tmp_path / "store"), 4)
    assert store.problem() == "missing"
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.read(lambda: files).count() == 5 and store.problem() is None
    assert store.one("b/c.py").first()["content"] == "x = 1\ny = 2" and store.one("nope").count() == 0
