from __future__ import annotations

import datetime as dt

import pytest

from quarrylight import reference_queries as q
from quarrylight.operators.symbols import doc_comment

CASES = [
    ("python", 'def f():\n    """One line."""\n', 1, "One line."),
    ("python", 'def f(\n    a):\n    """First.\n\n    Last.\n    """\n', 1, None),
    ("python", "class K:\n\n    \x27\x27\x27First.\n\n    Last.\x27\x27\x27\n", 1, "First.\n\nLast."),
    ("python", '# above\ndef f():\n    return """no"""\n', 2, None),
    ("rust", "//! Head\n/// First\n/// last\n#[inline]\n#[must_use]\nfn f() {}\n", 6, "Head\nFirst\nlast"),
    ("rust", "/// far\n\nfn f() {}\n", 3, None),
    ("rust", "// plain\nfn f() {}\n", 2, None),
    ("java", "/**\n * First.\n *\n * Last.\n */\n@Override\npublic void f() {\n", 7, "First.\nLast."),
    ("typescript", "// a\n// b\nfunction f() {}\n", 3, "a\nb"),
    ("c", "/* one */\nint f(void) {\n", 2, "one"),
    ("c", "int x; /* behind code */\nint f(void) {\n", 2, None),
    ("ruby", "#!/bin/ruby\n# a\n# b\ndef f\n", 4, "a\nb"),
    ("go", "// F does.\r\n// It.\r\nfunc F() {\r\n", 3, "F does.\nIt."),
    ("go", "func F() {\n", 1, None),
]


@pytest.mark.parametrize("language, text, line, want", CASES)
def test_doc_comment(language, text, line, want):
    assert doc_comment(text.split("\n"), line, language) == want


def test_query_reads_docstrings_and_blocks(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    texts = {1: ("a/x.py", CASES[0][1]), 2: ("a/y.java", CASES[7][1])}
    files = [(i, p, None, t, f"h{i}", 1, "main", at) for i, (p, t) in texts.items()]
    schemas = {"files": "file_id long, path string, language string, content string, hash string, line_count int, branch string, last_indexed timestamp", "symbols": "file_id long, file_hash string, name string, kind string, start_line int, end_line int, preview string, run_id long", "indexing_status": "run_id long, state string, updated_at timestamp"}
    rows = {"files": files, "symbols": [(1, "h1", "f", "Function", 1, 2, "", 1), (2, "h2", "f", "Method", 7, 7, "", 1)], "indexing_status": [(1, "completed", at)]}
    for name, schema in schemas.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in q.q_doc_comments(spark, str(tmp_path)).select("path", "symbol", "start_line", "comment").collect()}
    assert got == {("a/x.py", "f", 1, "One line."), ("a/y.java", "f", 7, "First.\nLast.")}
