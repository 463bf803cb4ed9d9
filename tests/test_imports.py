from __future__ import annotations

from quarrylight.operators.imports import classified, exports, exports_resolved, imports, projects, resolved

PATHS = [
    "r/src/lib.rs", "r/src/a.rs", "r/src/a/b.rs", "r/src/a/c/mod.rs", "r/src/d/mod.rs", "r/src/d/e.rs", "r/py/pkg/__init__.py", "r/py/pkg/m.py", "r/py/pkg/sub/n.py", "r/py/o.py", "r/web/app.ts", "r/web/util/index.ts", "r/web/util/x.tsx", "r/web/y.js",
    "r/src/main/java/work/span/Tool.java", "r/src/main/java/work/Main.java", "r/pkg/store/z.go", "r/pkg/store/a_test.go", "r/cmd/main.go", "r/c/inc/h.h", "r/c/f.c", "r/lib/gem.rb", "r/lib/gem/part.rb", "r/Model/User.cs", "r/src/Http/Base.php", "r/z/a.zig",
]


def files(spark, contents=()):
    from pyspark.sql import functions as F

    from quarrylight.functions.paths import language_of

    rows = [(p, dict(contents).get(p, "")) for p in dict.fromkeys([*PATHS, *dict(contents)])]
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", language_of(F.col("path")))


def test_every_language_resolves_by_its_own_rules(spark):
    cases = {
        "r/src/d/e.rs": [("use crate::a::b::Thing;", "r/src/a/b.rs"), ("use crate::a::c;", "r/src/a/c/mod.rs"), ("use crate::a::Thing;", "r/src/a.rs"), ("use super::Thing;", None), ("use super::super::a::X;", "r/src/a.rs"), ("use std::io;", None), ("use crate::none::X;", None)],
        "r/src/lib.rs": [("mod a;", "r/src/a.rs"), ("pub mod d;", "r/src/d/mod.rs"), ("use self::a::b;", "r/src/a/b.rs")],
        "r/py/pkg/sub/n.py": [("from ..m import f", "r/py/pkg/m.py"), ("from ... import o", None), ("from .. import m", "r/py/pkg/__init__.py"), ("from ...o import g", "r/py/o.py"), ("import json", None)],
        "r/py/pkg/m.py": [("from .sub.n import h", "r/py/pkg/sub/n.py"), ("from . import sub", "r/py/pkg/__init__.py")],
        "r/web/util/x.tsx": [("import { a } from '../app';", "r/web/app.ts"), ("import '../y.js';", "r/web/y.js"), ("import b from '..//util';", "r/web/util/index.ts"), ("const c = require('./missing');", None), ("import fs from 'fs';", None)],
        "r/src/main/java/work/Main.java": [("import work.span.Tool;", "r/src/main/java/work/span/Tool.java"), ("import java.util.List;", None)],
        "r/cmd/main.go": [('import "example.com/none"', None), ('\t"example.com/pkg/store"', "r/pkg/store/z.go")],
        "r/c/f.c": [('#include "inc/h.h"', "r/c/inc/h.h"), ("#include <stdio.h>", None), ('#include "../c/inc/h.h"', "r/c/inc/h.h")],
        "r/lib/gem/part.rb": [('require_relative "../gem"', "r/lib/gem.rb"), ('require "json"', None)],
        "r/Model/Other.cs": [("using Model.User;", "r/Model/User.cs"), ("using System.Linq;", None)],
        "r/src/Http/Other.php": [("require_once 'Base.php';", "r/src/Http/Base.php")],
        "r/z/b.zig": [('const a = @import("./a.zig");', "r/z/a.zig"), ('const s = @import("std");', None)],
    }
    contents = {p: "\n".join(line for line, _ in rows) + "\n" for p, rows in cases.items()}
    contents["r/pom.xml"] = "<project><groupId>work</groupId></project>"
    contents["r/go.mod"] = "module example.com\n\ngo 1.22\n"
    corpus = files(spark, contents)
    known = projects(corpus)
    assert sorted((r.language, r.prefix) for r in known.collect()) == [("go", "example.com"), ("java", "work")]
    rows = resolved(classified(imports(corpus), known), corpus)
    got = {(r.path, r.line_no): (r.imported, r.resolved) for r in rows.collect()}
    for path, lines in cases.items():
        for n, (line, want) in enumerate(lines, 1):
            if want is not None or "java.util" in line or "std::io" in line:
                assert (path, n) in got, (path, line)
            assert got.get((path, n), (None, None))[1] == want, (path, line, got.get((path, n)))


def test_import_types(spark):
    contents = {
        "q/a.rs": "use std::io;\nuse serde::X;\nmod y;\nextern crate z;\nuse core;\n", "q/a.py": "import os.path\nimport numpy\nfrom .x import y\nimport statistics\n", "q/a.ts": "import a from 'node:fs';\nimport b from 'left';\nimport c from '@/x';\n",
        "q/a.go": '\t"fmt"\n\t"github.com/x/y"\n\t"a/b/c"\n\t"net/http"\n', "q/a.java": "import java.util.List;\nimport com.x.Y;\n", "q/a.c": "#include <stdio.h>\n#include <sys/x.h>\n#include \"y.h\"\n", "q/a.cpp": "#include <vector>\n#include <boost/x.hpp>\n", "q/a.rb": "require 'net/http'\nrequire 'rails'\nrequire './x'\n",
        "q/a.kt": "import kotlin.io.path\nimport com.x.Y as Z\nimport a.b.*\n", "q/a.cs": "using System.IO;\nusing My.Thing;\n", "q/a.php": "use Psr\\Log\\X;\nuse App\\Y;\nrequire 'z.php';\n", "q/a.zig": "const s = @import(\"std\");\n",
    }
    rows = classified(imports(files(spark, contents))).collect()
    got = {p: [r.import_type for r in sorted(rows, key=lambda r: r.line_no) if r.path == p] for p in contents}
    assert got == {
        "q/a.rs": ["stdlib", "external", "mod_decl", "external", "stdlib"], "q/a.py": ["stdlib", "external", "internal", "stdlib"], "q/a.ts": ["stdlib", "external", "external"], "q/a.go": ["stdlib", "external", "external", "stdlib"], "q/a.java": ["stdlib", "external"],
        "q/a.c": ["stdlib", "external", "internal"], "q/a.cpp": ["stdlib", "external"], "q/a.rb": ["stdlib", "external", "internal"], "q/a.kt": ["stdlib", "external", "external"], "q/a.cs": ["stdlib", "internal"], "q/a.php": ["stdlib", "external", "internal"], "q/a.zig": ["stdlib"],
    }


def test_exports(spark):
    text = "import x from './y';\nexport { a, b as c,\n  type d } from './util';\nexport * from './y'\nexport * as n from 'pkg';\nexport const e = 1;\n  export type { F } from \"./missing\";\n"
    corpus = files(spark, {"r/web/index.ts": text, "r/web/none.ts": ""})
    assert sorted((r.line_no, r.symbol or "", r.source) for r in exports(corpus).where("path = 'r/web/index.ts'").collect()) == [(2, "a", "./util"), (2, "b", "./util"), (2, "d", "./util"), (4, "", "./y"), (5, "", "pkg"), (7, "F", "./missing")]
    assert sorted((r.line_no, r.symbol or "", r.resolved) for r in exports_resolved(corpus).collect()) == [(2, "a", "r/web/util/index.ts"), (2, "b", "r/web/util/index.ts"), (2, "d", "r/web/util/index.ts"), (4, "", "r/web/y.js"), (5, "", None), (7, "F", None)]
    assert exports(files(spark).where("false")).count() == 0
