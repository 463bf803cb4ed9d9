from __future__ import annotations

import pytest

from quarrylight.llm.grammars import FOREIGN, PARSERS
from quarrylight.llm.parsing import CORRUPT, VALID, failure_rates, judge, ranked, verdicts

GOOD = {
    "py": ["", "# only\n", "def f(a, b=1):\n    return [x for x in a if x]\n", "x = {'a': 1, **b}\nasync def g():\n    await h()\n", 'S = """\n<<<<<<< HEAD\n"""\n'],
    "rs": [
        "", "// only\n", "use crate::a::{b, c as d};\nuse std::io;\n", "pub struct P { pub x: i64, y: Vec<u8> }\nimpl P {\n    pub fn f(&self, a: &mut Q) -> Option<i64> {\n        let mut z = a.b(1)? + 2;\n        if z > 3 { return None; } else { z -= 1; }\n        for i in 0..z { g!(\"{}\", i); }\n        Some(z)\n    }\n}\n",
        "enum E { A, B(i64), C { x: u8 } }\nfn m(e: E) -> i64 { match e { E::A => 1, E::B(n) if n > 2 => n, _ => { 0 } } }\n", "const A: [i64; 2] = [1, 2];\n#[derive(Debug)]\nstruct U;\ntrait T { fn f(&self); }\n", 'fn f() { let s = "} // {"; let c = \'"\'; }\n',
    ],
    "go": ["package a\n", "// c\npackage a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S struct {\n\ta, b int\n}\n\nfunc (s *S) f(a int, b ...string) (int, error) {\n\tif x := g(a); x > 1 {\n\t\treturn x, nil\n\t} else if a == 2 {\n\t\ta++\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\ts.m[i] = S{a: 1}\n\t}\n\tfor k, v := range b {\n\t\tfmt.Println(k, v)\n\t}\n\treturn 0, nil\n}\n", "package a\n\nvar T = []int{1, 2,\n\t3,\n}\n\nconst (\n\tA = 1\n\tB\n)\n"],
    "js": ["", "var a = 1\nvar b = 2", "const x = require('x');\nexport default function f({a, b}, ...r) { return a ? b : r[0] }\nclass A extends B { constructor() { super(); } get x() { return 1; } static y = 2; }\n", "!function(a,b){a&&b[1]?a:0}(this,0);for(var i=0;i<9;i++)x.push(y[i]||0);if(a&&!b){c=1}else d=e;", "const f = async (a) => { await g(a); };\nlet o = {a, b: 1, c() {}, 'd': [1, 2,], ...e};\ntry { f() } catch (e) { throw new Error(`x ${e}`) } finally { g() }\n"],
    "ts": ["interface A { a: number; b?: string; f(x: number): void }\nexport function f(a: number, b?: A[]): Map<string, number> { const x: number = a as any; return x!; }\n", "type T = 'a' | { x: number };\nenum E { A = 1, B }\nimport type { Q } from './q';\nclass C<T> implements A { private x: number = 1; constructor(readonly y: string) {} }\n", "const plain = require('js');\n"],
    "java": ["package a.b;\nimport a.c.*;\npublic final class A<T> extends B implements C {\n    static final long[] X = {1, 2};\n    private int y;\n    A(int y) { this.y = y; }\n    @Override public List<T> f(final int a, String... b) throws E {\n        for (int i = 0; i < a; i++) { y += b[i].length(); }\n        for (String s : b) if (s == null) continue; else break;\n        try { g((long) a); } catch (E | F e) { throw new E(\"x\"); }\n        return a > 1 ? new X<>() : null;\n    }\n}\n", "enum E { A, B(1); int x; }\ninterface I { void f(); }\n"],
    "c": ["#include <a.h>\n#define X 1\nstatic const long A[] = {1, 0x2, 3};\nstruct s { int a; char *b; };\nlong f(struct s *p, int n) {\n    for (int i = 0; i < n; i++) { p->a += i * 2; }\n    if (n > 1) return (long) n; else n--;\n    while (n) { n = n / 2; }\n    return p->b[0] ? f(p, n) : sizeof(int);\n}\n", "typedef struct { int x; } T;\nenum e { A = 1, B };\nint g(void);\n"],
    "rb": ["", "require_relative 'a'\n# c\nclass A < B\n  X = [1, 2]\n  def f(a, b = 1)\n    return 3 if a > b\n    10.times do |i|\n      log(\"x\", i)\n    end\n    if a\n      1\n    elsif b\n      2\n    else\n      3\n    end\n  end\nend\n", "x = y.map { |a| a + 1 }\nputs x unless y\n"],
}
BAD = {
    "py": ["def f(:\n", "x = (1,\n", "if a:\nb\n", "<<<<<<< HEAD\n", 's = "abc\n', "package a\n"],
    "rs": ["fn f() {", "use crate::a", "fn f() { let x = \"abc; }\n", "fn f() }\n", "fn f() {\n<<<<<<< HEAD\n}\n", "def f():\n    pass\n", "# comment\n", "fn f() { a b; }\n"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nx := 1 2\n", "package a\n=======\n", "package a;\nint x = 3;\n"],
    "js": ["function f(a: number) {}\n", "function f() {", "var a = ;\n", "import { a } fr", "def f(a):\n  pass\n", "interface A { a: number; }\n", "long x = 1;\n", "# c\n", "const a = \"x\n"],
    "ts": ["function f(a: number {}\n", "const x: = 1;\n", "end end\n", "use crate::x;\n", "<!DOCTYPE html>\n<html>\n"],
    "java": ["package a.b\n", "class A { void f() { int x = ; } }\n", "class A {\n", "func f() {}\n", "static long f(long a) { return a; }\n", "class A { void f() { g() } }\n"],
    "c": ["int f( { }\n", "long f(long a) { return a }\n", "package a.b;\n", "# units are fine\n", "int f() { a b c; }\n", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+int x;\n"],
    "rb": ["def f\n", "end\n", "def f(a)\n  if a\n  1\nend\n", "log(\"abc)\nx = 1\n", "fn f(a: i64) -> i64 {\n  let x = 1;\n}\n", "x -= \n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid(language):
    for text in GOOD[language]:
        assert PARSERS[language](text), text


@pytest.mark.parametrize("language", BAD)
def test_invalid(language):
    for text in BAD[language]:
        assert not PARSERS[language](text), text


def test_truncation_of_valid_files_is_found():
    """Cut inside a bracket or a string, a file is never valid."""
    text = GOOD["go"][1]
    inside = text.index("return x")
    for n in range(inside - 8, inside):
        assert not PARSERS["go"](text[:n])


def test_judge():
    rust = GOOD["rs"][3]
    assert judge(rust, "rs") == (VALID, ["rs"])
    assert judge(rust, "py") == ("rs", ["rs"]) and ranked(rust)[0] == "rs"
    assert judge("<html>", "c") == (CORRUPT, [])
    assert judge(None, "py") == (VALID, []) and judge("", "c") == (VALID, []) and judge("x", "txt") == (None, [])
    assert judge("\ufeffx = 1\r\n", "py")[0] == VALID
    assert judge("x = [\n" + "1, " * 200_000 + "]\n", "py")[0] == VALID
    assert judge("(" * 50_000, "js") == (CORRUPT, [])
    assert judge("-" * 20_000 + "1\n", "py")[0] is None  # beyond what the parser of Python holds: nothing is known
    # a text that several grammars accept: its own decides, and the ranking puts them in order
    assert judge("x = 1\n", "rb") == (VALID, ["py", "js", "ts", "rb"])


def test_verdicts_take_the_current_row(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    schema = "file_id long, path string, content string, hash string, last_indexed timestamp, verdict string"
    rows = [
        (1, "./r/a.py", "x = (", "h", t, ""), (1, "r/a.py", "x = 1", "i", t + dt.timedelta(1), ""), (2, "r/b.py", "fn f() {}", "h", t, ""), (2, "r/b.py", "fn f() {}", "h", t, ""),
        (3, "r\\c.go", None, None, None, None), (4, "r/d.py", "x = (", "h", None, ""), (5, None, "x", "h", t, ""), (None, "r/e.py", "(", "h", t, ""),
    ]
    out = verdicts(spark.createDataFrame(rows, schema))
    got = {r.file_id: (r.path, r.verdict) for r in out.collect()}
    assert got == {1: ("r/a.py", VALID), 2: ("r/b.py", "rs"), 3: ("r/c.go", VALID), 4: ("r/d.py", CORRUPT), 5: (None, None)}
    rates = {r.language: (r.files, r.unjudged, r.failed, r.wrong_extension, r.corrupt, r.failure_rate and round(r.failure_rate, 3)) for r in failure_rates(out).collect()}
    assert rates == {"py": (3, 0, 2, 1, 1, 0.667), "go": (1, 0, 0, 0, 0, 0.0), None: (1, 1, 0, 0, 0, None)}
    assert verdicts(spark.createDataFrame([], schema)).count() == 0
