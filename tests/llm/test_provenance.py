from __future__ import annotations

import datetime as dt

from quarrylight.llm.provenance import leaf, origin, origins

HAND = "\n".join(f"def f_{x}(a):\n    # note {x}\n    return a.{x}('{x}') * 2\n" for x in ("alpha", "beta", "gamma", "delta", "eps", "zeta"))
MINIFIED = "var a=function(e){return e?1:e.x};" * 20


def test_generated():
    for head in ("Code generated by gen v1. DO NOT EDIT.", "@generated by x", "AUTO-GENERATED FILE - do not edit", "This file was automatically generated from a.schema", "<auto-generated> produced by x </auto-generated>", "Diese Datei wurde automatisch erzeugt (x v1)"):
        assert origin("r/src/a.py", f"# {head}\n{HAND}") == "generated"
        assert origin("r/src/a.go", f"// Copyright x\n// Licensed\n\n/*\n * {head}\n */\npackage a\n") == "generated"
    assert origin("r/src/generated/a.py", HAND) == "generated"
    assert origin("r/src/a.pb.go", "package a\n") == "generated"
    numbered = "\n".join(f"def get_{n}{i}(row):\n    return row.at({i})\n" for i, n in enumerate(("a", "b", "c", "d", "e", "f", "g", "h")))
    assert origin("r/src/a.py", numbered) == "generated"


def test_hand_written_code_about_generated_code():
    assert origin("r/src/a.py", HAND) is None
    assert origin("r/src/generators/a.py", HAND) is None
    assert origin("r/src/a.py", f'# auto-generated rows are skipped here\n{HAND}') is None
    assert origin("r/src/a.py", f'{HAND}\nHEADER = "# Code generated by x. DO NOT EDIT."\n') is None
    assert origin("r/src/a.py", f'import x\n\nNOTE = """\nCode generated by the old tool looked like this.\n"""\n{HAND}') is None
    assert origin("r/src/a.py", f"# do not edit the field order without a migration\n{HAND}") is None
    assert origin("r/src/a.js", 'const HELP = "' + "some words to read " * 60 + '";\nfunction f(a) {\n  return a;\n}\n') is None
    assert origin("r/src/a.py", None) is None and origin("r/src/a.py", "") is None


def test_minified_and_data():
    assert origin("r/src/a.js", MINIFIED) == "minified"
    assert origin("r/src/a.js", "/*! lib 1.0 */\n" + MINIFIED) == "minified"
    assert origin("r/src/a.rs", "pub static A: [u8; 99] = [\n" + "0x10, 7, 255, 18,\n" * 30 + "];\n") == "data"
    assert origin("r/src/a.py", 'DATA = "' + "aGVsbG8gd29y//bGQ+" * 20 + '"\n') == "data"
    assert origin("r/src/a.ts", "export default [" + ",\n".join('{"id": 1, "k": "x", "v": [1, 2]}' for _ in range(20)) + "];\n") == "data"
    assert origin("r/src/a.py", "TABLE = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]\n" + HAND) is None


def test_leaf_ignores_cosmetic_edits():
    a = "// Copyright\nint f(int a) {\n    return a; // note\n}\n"
    b = "int f(int a)\r\n{\treturn a;}\n/* end */"
    assert leaf(a) == leaf(b) != leaf(a.replace("a;", "b;"))
    assert leaf('x = "a // b"')[1] == len('x="a//b"')
    assert leaf(None) == leaf("") == leaf("# only\n")


SCHEMA = "file_id long, path string, content string, hash string, last_indexed timestamp, origin string"
CATALOG = "item_id long, package_name string, file_name string, language string, content string"


def test_origins(spark):
    t = dt.datetime(2025, 1, 1)
    big = HAND.replace("alpha", "omega")
    small = "x = 1\n"
    tree = [("m.py", HAND.replace("beta", "iota")), ("__init__.py", small)]
    rows = [
        (1, "r1/src/a.py", HAND, "h", t, ""), (1, "r1/src/a.py", HAND, "h", t, ""),
        (2, "./r1/lib/util.py", "# mine now\n" + big.replace("    ", "  "), "h", t, ""),  # the catalog's, reformatted
        (3, "r1/third_party/x/b.py", "y = 2\n", "h", t, ""), (4, "r1/vendor_portal/b.py", HAND + "z = 1\n", "h", t, ""),
        (5, "r1/src/old.py", "# @generated\n", "a", t, ""), (5, "r1/src/old.py", HAND + "q = 1\n", "b", t + dt.timedelta(1), ""),
        (6, None, None, None, None, None), (7, "r1/src/empty.py", "", "h", t, ""),
    ]
    i = 100
    for repo in ("r1", "r2", "r3"):  # one tree in three repositories, its small file too
        for name, text in tree:
            rows.append((i, f"{repo}/x/lib{repo}/{name}", text, "h", t, ""))
            i += 1
    rows += [(200, "r2/src/s.py", small, "h", t, ""), (201, "r2/src/twice.py", HAND + "w = 1\n", "h", t, ""), (202, "r3/src/twice.py", HAND + "w = 1\n", "h", t, "")]
    files = spark.createDataFrame(rows, SCHEMA)
    catalog = spark.createDataFrame([(1, "pkg", "util.py", "python", "# Copyright\n" + big)], CATALOG)
    got = {r.file_id: r.origin for r in origins(files, catalog).collect()}
    assert {k for k, v in got.items() if v == "vendored"} == {2, 3, 100, 101, 102, 103, 104, 105}
    assert {k for k, v in got.items() if v is None} == {1, 4, 5, 6, 7, 200, 201, 202}
    assert origins(files.limit(0), catalog).count() == 0
    assert origins(files, catalog.limit(0)).where("origin = 'vendored'").count() == 7


def test_a_header_below_any_licence_counts_and_short_files_are_judged():
    from quarrylight.llm.provenance import header_lines, origin

    licence = "// licence line\n" * 700
    assert origin("r/a.go", licence + "// Code generated by protoc. DO NOT EDIT.\n\npackage a\n") == "generated"
    assert len(header_lines(licence + "package a\n// Code generated\n")) == 700
    assert origin("r/a.js", "// @generated\nx\n") == "generated"
    assert origin("r/a.js", "") is None and origin("r/a.js", None) is None and origin("r/a.js", "x=1") is None
    assert origin("r/a.js", "a=b+c;" * 40) == "minified"


def test_names_are_read_by_their_words():
    from quarrylight.llm.provenance import origin

    for path in ("r/a_pb2.py", "r/a.pb.go", "r/x_generated.rs", "r/x_generated_q1.rs", "r/FooGrpc.java", "r/gen/a.py", "r/a.designer.cs"):
        assert origin(path, "x = 1\n") == "generated", path
    for path in ("r/a_pb.rb", "r/a_g.c", "r/generator.py", "r/regenerated/x.py", "r/degen.py", "r/grpc_client/x.go"):
        assert origin(path, "x = 1\n") is None, path
