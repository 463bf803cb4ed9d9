"""Imports and re-exports of source files: extraction by line patterns, classification, and resolution to files.

An import becomes an ordered array of candidate paths, worked out from the importing file's path by the rules of its
language; the candidates meet the files in one equi-join and the first that exists wins. All of it is expressions, so a
corpus of any size is one scan, one explode and one join on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.corpus import lines
from quarrylight.functions.paths import path_variants

_SCRIPT = [r"^\s*(?:import|export)\b.*?\bfrom ['\"]([^'\"]+)['\"]", r"^\s*import ['\"]([^'\"]+)['\"]", r"\brequire\(['\"]([^'\"]+)['\"]\)"]
_INCLUDE = [r"^\s*#\s*include\s*([\"<][^\">]+[\">])"]
#: Per language, patterns with one group, tried in order; the pattern and its RE2 form are the same text.
PATTERNS = {
    "rust": [r"^\s*(?:pub(?:\([a-z]+\))? )?use (?:::)?([A-Za-z_][\w:]*\w)", r"^\s*(?:pub(?:\([a-z]+\))? )?(mod \w+);", r"^\s*extern crate (\w+)"],
    "python": [r"^\s*from (\.*[\w.]*) import ", r"^\s*import ([A-Za-z_][\w.]*)\s*(?:,|#|$)"],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "vue": _SCRIPT,
    "svelte": _SCRIPT,
    "go": [r"^import (?:[\w.]+ )?\"([^\"]+)\"", r"^\t(?:[\w.]+ )?\"([^\"\s]+)\"$"],
    "java": [r"^\s*import (?:static )?([\w.]*\w)(?:\.\*)?;"],
    "kotlin": [r"^\s*import ([\w.]*\w)"],
    "c": _INCLUDE,
    "cpp": _INCLUDE,
    "csharp": [r"^\s*(?:global )?using (?:static )?([A-Za-z_][\w.]*)\s*;"],
    "php": [r"^\s*use (?:function |const )?\\?([A-Za-z_][\w\\]*)", r"^\s*((?:require|include)(?:_once)?\s*\(?\s*['\"][^'\"]+)['\"]"],
    "ruby": [r"^\s*((?:require|require_relative|load)[ (]['\"][^'\"]+)['\"]"],
    "zig": [r"@import\(\"([^\"]+)\"\)"],
}


def _matched(line: Column) -> Column:
    """The first group that matched; the pattern is looked up by language, so one expression serves all of them."""
    # "(?!)" never matches: it pads each pattern to as many groups as the longest has
    most = max(map(len, PATTERNS.values()))
    joined = {language: "|".join(p + ["(?!)()"] * (most - len(p))) for language, p in PATTERNS.items()}
    pattern = F.create_map(*[F.lit(x) for pair in joined.items() for x in pair])[F.col("language")]
    return F.coalesce(*[F.nullif(F.call_function("regexp_extract", line, pattern, F.lit(i + 1)), F.lit("")) for i in range(most)])


def matched_sql(line: str) -> str:
    arms = []
    for language, patterns in PATTERNS.items():
        values = ", ".join("nullif(regexp_extract({0}, '{1}', 1), '')".format(line, p.replace("'", "''")) for p in patterns)
        arms.append(f"WHEN '{language}' THEN coalesce({values})")
    return "CASE language " + " ".join(arms) + " END"


def imports(files: DataFrame) -> DataFrame:
    """(path, language, line_no, imported) of all imports.

    A C path keeps its quotes, a Ruby or PHP one its verb, and a Rust module declaration reads ``mod name``.
    """
    wanted = files.where(F.col("language").isin(*PATTERNS)).select("path", "language", "content")
    return lines(wanted).withColumn("imported", _matched(F.col("line"))).where("imported IS NOT NULL").select("path", "language", "line_no", "imported")


# ---- classification: fixed values, what belongs to a language itself ---------------------------------------------------
RUST_STDLIB = ("std", "core", "alloc")
PYTHON_STDLIB = (
    "os", "sys", "io", "re", "json", "csv", "xml", "html", "http", "urllib", "collections", "itertools", "functools", "operator", "pathlib", "glob", "tempfile", "shutil", "pickle", "shelve", "sqlite3", "zlib", "gzip", "time", "datetime", "calendar",
    "logging", "argparse", "configparser", "typing", "dataclasses", "enum", "abc", "contextlib", "weakref", "threading", "multiprocessing", "subprocess", "queue", "asyncio", "socket", "email", "base64", "hashlib", "hmac", "secrets", "uuid", "math", "random", "statistics", "decimal", "fractions", "unittest", "doctest", "pdb", "trace", "timeit",
)
NODE_STDLIB = (
    "fs", "path", "os", "crypto", "util", "events", "stream", "buffer", "http", "https", "net", "tls", "url", "querystring", "dns", "child_process", "cluster", "worker_threads", "readline", "zlib", "assert", "console", "module", "process", "timers", "vm", "string_decoder", "dgram", "v8", "perf_hooks",
    "node:fs", "node:path", "node:os", "node:crypto", "node:util", "node:events", "node:stream", "node:buffer", "node:http", "node:https", "node:net",
)
GO_STDLIB = (
    "fmt", "io", "os", "path", "strings", "bytes", "bufio", "errors", "context", "sync", "time", "encoding/json", "encoding/xml", "encoding/csv", "net/http", "net/url", "net", "crypto", "crypto/tls", "crypto/sha256", "database/sql", "log", "math", "regexp", "strconv", "sort", "reflect", "runtime", "testing", "flag", "filepath", "unicode", "html", "text/template",
)
JAVA_STDLIB = ("java.lang", "java.util", "java.io", "java.nio", "java.net", "java.text", "java.math", "java.time", "java.sql", "java.security", "java.awt", "java.swing", "javax.swing", "javax.sql", "javax.crypto", "javax.net", "javax.xml", "javax.annotation", "javax.servlet", "org.w3c.dom", "org.xml.sax")
KOTLIN_STDLIB = ("java.", "javax.", "kotlin.", "android.", "androidx.")
C_STDLIB = ("stdio.h", "stdlib.h", "string.h", "math.h", "time.h", "ctype.h", "assert.h", "errno.h", "limits.h", "float.h", "stddef.h", "stdint.h", "stdbool.h", "stdarg.h", "setjmp.h", "signal.h", "locale.h", "wchar.h", "wctype.h", "complex.h", "fenv.h", "inttypes.h", "iso646.h", "tgmath.h", "threads.h")
CSHARP_STDLIB = ("System", "Microsoft.AspNetCore", "Microsoft.EntityFrameworkCore", "Microsoft.Extensions", "Microsoft.Win32")
RUBY_STDLIB = (
    "json", "csv", "yaml", "uri", "net/", "open-uri", "openssl", "digest", "base64", "securerandom", "time", "date", "set", "fileutils", "pathname", "tempfile", "logger", "benchmark", "ostruct", "forwardable", "singleton", "observer", "delegate", "abbrev", "cgi", "erb", "optparse", "shellwords", "stringio", "strscan", "socket", "thread", "mutex_m", "monitor", "sync", "timeout", "weakref", "English", "fiddle", "rbconfig",
)
PHP_STDLIB = r"^(?:Psr\\|(?:Exception|Error|DateTime(?:Immutable|Interface)?|DateInterval|DatePeriod|PDO|PDOStatement|Closure|Generator|ArrayIterator|IteratorAggregate|Traversable|Iterator|Countable|Serializable|JsonSerializable|Spl\w+)$)"
ZIG_STDLIB = ("std", "builtin", "root")


def _any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.rstrip("/").replace(".", "[.]") for w in words) + ")"


#: (languages, ((pattern, import type), ...), import type else): the first pattern that an import matches decides. The
#: patterns are in the syntax that Java and RE2 share, so the same table makes the expression and its SQL.
RULES = (
    (("rust",), ((r"^mod \w", "mod_decl"), (r"^(?:crate|super|self)(?:::|$)", "internal"), (f"^{_any_of(RUST_STDLIB)}(?:::|$)", "stdlib")), "external"),
    (("python",), ((r"^[.]", "internal"), (f"^{_any_of(PYTHON_STDLIB)}(?:[.]|$)", "stdlib")), "external"),
    (("javascript", "typescript", "vue", "svelte"), ((r"^[.]{1,2}/|^/", "internal"), (f"^{_any_of(NODE_STDLIB)}$", "stdlib")), "external"),
    (("go",), ((r"^[.]{1,2}/", "internal"), (f"^{_any_of(GO_STDLIB)}$", "stdlib"), (r"^[^/]*[.][^/]*/", "external"), (r"^[^/]*(?:/[^/]*)?$", "stdlib")), "external"),
    (("java",), ((f"^{_any_of(JAVA_STDLIB)}", "stdlib"),), "external"),
    (("kotlin",), ((f"^{_any_of(KOTLIN_STDLIB)}", "stdlib"),), "external"),
    (("c", "cpp"), ((r'^"', "internal"), (f"^<{_any_of(C_STDLIB)}>$", "stdlib")), "external"),
    (("csharp",), ((f"^{_any_of(CSHARP_STDLIB)}(?:[.]|$)", "stdlib"),), "internal"),
    (("php",), ((r"^(?:require|include)", "internal"), (PHP_STDLIB, "stdlib")), "external"),
    (("ruby",), ((r"^require_relative|[ (]['\"][.]{1,2}/", "internal"), (f"^\\w+[ (]['\"]{_any_of(RUBY_STDLIB)}(?:/|$)", "stdlib")), "external"),
    (("zig",), ((f"^{_any_of(ZIG_STDLIB)}$", "stdlib"), (r"^[.]{1,2}/", "internal")), "external"),
)
#: Headers of C++ have no ending.
_CPP_HEADER = r"^<[a-z_]+>$"


def classified(rows: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """With import_type: internal, external, stdlib or mod_decl.

    projects  (repository, language, prefix) from ``projects``: what begins with its own repository's prefix is internal
    """
    i = F.col("imported")
    rule = None
    for languages, tests, otherwise in RULES:
        arm = None
        for pattern, kind in tests:
            arm = F.when(i.rlike(pattern), kind) if arm is None else arm.when(i.rlike(pattern), kind)
        is_ = F.col("language").isin(*languages)
        rule = F.when(is_, arm.otherwise(otherwise)) if rule is None else rule.when(is_, arm.otherwise(otherwise))
    rule = F.when((F.col("language") == "cpp") & i.rlike(_CPP_HEADER), "stdlib").otherwise(rule)
    if projects is None:
        return rows.withColumn("import_type", rule)
    own = projects.groupBy("repository", "language").agg(F.collect_set("prefix").alias("_prefixes"))
    known = rows.withColumn("repository", F.substring_index("path", "/", 1)).join(own, ["repository", "language"], "left")
    mine = F.coalesce(F.exists("_prefixes", lambda p: i.startswith(p)), F.lit(False))
    return known.withColumn("import_type", F.when(mine, "internal").otherwise(rule)).drop("repository", "_prefixes")


def _classify_sql() -> str:
    arms = [f"WHEN language = 'cpp' AND regexp_matches(imported, '{_CPP_HEADER}') THEN 'stdlib'"]
    for languages, tests, otherwise in RULES:
        inner = " ".join("WHEN regexp_matches(imported, '{}') THEN '{}'".format(p.replace("'", "''"), kind) for p, kind in tests)
        arms.append(f"WHEN language IN ({', '.join(map(repr, languages))}) THEN CASE {inner} ELSE '{otherwise}' END")
    return "CASE " + " ".join(arms) + " END"


CLASSIFY_SQL = _classify_sql()

#: (name of a manifest, language it speaks for, pattern of the prefix that the project's own imports have)
MANIFESTS = (
    ("go.mod", "go", r"(?m)^module\s+(\S+)"),
    ("pom.xml", "java", r"<groupId>\s*([^<\s]+)"),
    ("build.gradle", "java", r"(?m)^\s*group\s*=?\s*['\"]([^'\"]+)"),
    ("build.gradle.kts", "kotlin", r"(?m)^\s*group\s*=\s*\"([^\"]+)"),
    ("pyproject.toml", "python", r"(?m)^name\s*=\s*\"([^\"]+)"),
    ("Cargo.toml", "rust", r"(?m)^name\s*=\s*\"([^\"]+)"),
    ("composer.json", "php", r"\"([A-Z]\w*)\\\\\\\\\"\s*:"),
)


def projects(files: DataFrame) -> DataFrame:
    """(repository, language, prefix, root): what the manifests of a repository call it, and the folder they are in."""
    name = F.element_at(F.split("path", "/"), -1)
    out = None
    for manifest, language, pattern in MANIFESTS:
        found = files.where(name == manifest).select(F.substring_index("path", "/", 1).alias("repository"), F.lit(language).alias("language"), F.regexp_extract("content", pattern, 1).alias("prefix"), F.regexp_replace("path", r"/?[^/]*$", "").alias("root"))
        out = found if out is None else out.unionByName(found)
    hyphens = F.when(F.col("language").isin("rust", "python"), F.replace("prefix", F.lit("-"), F.lit("_"))).otherwise(F.col("prefix"))
    return out.withColumn("prefix", hyphens).where("prefix <> ''").distinct()


# ---- resolution -------------------------------------------------------------------------------------------------------


def folded(path: Column) -> Column:
    """A path without ``.`` and ``..``; climbing above the top stays at the top."""
    none = F.array().cast("array<string>")
    return F.array_join(
        F.aggregate(
            F.split(path, "/"), none,
            lambda kept, part: F.when((part == "") | (part == "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part))),
        ),
        "/",
    )


def _each(bases: Column, endings: tuple[str, ...]) -> Column:
    """Every base with every ending, the bases in order and for each the endings in order."""
    return F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in endings])))


#: Endings tried for a script without one, in order; fixed values.
SCRIPT_ENDINGS = (".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs", "/index.tsx", "/index.ts", "/index.jsx", "/index.js")
_STEMS = ("mod.rs", "lib.rs", "main.rs")


def candidates(path: Column, language: Column, imported: Column) -> Column:
    """The files an import can mean, in the order in which they are tried.

    rust     crate:: from the last ``src`` folder above the file, else from the repository; super:: and self:: from the
             file's module; of ``a::b::C`` the longest module path that is a file, as ``x.rs`` or ``x/mod.rs``
    python   a dot is the file's package, each further one a folder up; ``x.py`` or ``x/__init__.py``; absolute names
             from the repository and its ``src``
    script   relative to the file, as it stands if it has an ending, else with SCRIPT_ENDINGS
    go       the folder named by the longest tail of the path (what is before it names the module); ``resolved`` takes its first file
    java, kotlin, csharp, php   names to folders, below the usual source roots of the repository
    c, cpp, zig   relative to the file; ruby  relative to the file, or below ``lib``
    """
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    repository = F.substring_index(path, "/", 1)
    name = F.element_at(F.split(path, "/"), -1)
    here = F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    none = F.array().cast("array<string>")

    def below(bases: list[Column], tail: Column) -> Column:
        return F.array(*[F.concat(b, F.lit("/"), tail) for b in bases])

    # Rust
    module = F.when(name.isin(*_STEMS), folder).otherwise(F.regexp_replace(path, r"\.rs$", ""))
    crate = F.when(path.rlike(r"(^|/)src/"), F.regexp_extract(path, r"^(.*?(?:^|/)src)/(?!.*/src/)", 1)).otherwise(repository)
    supers = F.regexp_count(imported, F.lit(r"(?:^|::)super(?=::|$)"))
    climbed = F.array_join(F.slice(F.split(module, "/"), F.lit(1), F.greatest(F.size(F.split(module, "/")) - supers, F.lit(1))), "/")
    base = F.when(imported.startswith("crate"), crate).when(imported.startswith("super"), climbed).otherwise(module)
    tail = F.filter(F.split(F.regexp_replace(imported, r"^(?:crate|self|super)(?:::super)*(?:::|$)|^mod ", ""), "::"), lambda x: x != "")
    longest_first = F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(tail), F.lit(1)))), lambda n: F.concat(base, F.lit("/"), F.array_join(F.slice(tail, F.lit(1), n), "/")))
    rust = F.when(imported.rlike(r"^(?:crate|super|self)(?:::|$)|^mod ") & (F.size(tail) > 0), _each(longest_first, (".rs", "/mod.rs"))).otherwise(none)
    # Python
    dots = F.length(F.regexp_extract(imported, r"^(\.*)", 1))
    package = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    dotted = F.replace(F.regexp_replace(imported, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.when(dotted == "", F.array(F.concat(package, F.lit("/__init__.py")))).otherwise(_each(below([package], dotted), (".py", "/__init__.py")))
    python = F.when(dots > 0, relative).otherwise(_each(below([repository, F.concat(repository, F.lit("/src"))], dotted), (".py", "/__init__.py")))
    # scripts
    asked = F.when(imported.startswith("/"), F.concat(repository, imported)).otherwise(folded(F.concat(here, imported)))
    script = F.when(~imported.rlike(r"^[.]{1,2}/|^/"), none).when(imported.rlike(r"\.(?:tsx?|jsx?|mjs|cjs|vue|svelte)$"), F.array(asked)).otherwise(_each(F.array(asked), SCRIPT_ENDINGS))
    # names that are folders
    as_folders = F.replace(F.replace(imported, F.lit("."), F.lit("/")), F.lit("\\"), F.lit("/"))
    java = _each(below([F.concat(repository, F.lit(r)) for r in ("/src/main/java", "/src/test/java", "/src", "")], as_folders), (".java",))
    kotlin = _each(below([F.concat(repository, F.lit(r)) for r in ("/src/main/kotlin", "/src/main/java", "/src/test/kotlin", "/src", "")], as_folders), (".kt", ".java"))
    csharp = _each(below([repository, F.concat(repository, F.lit("/src"))], as_folders), (".cs",))
    required = F.regexp_extract(imported, r"['\"](.*)$", 1)
    without_top = F.regexp_replace(as_folders, r"^[^/]*/", "")
    php = F.when(required != "", F.array(folded(F.concat(here, required)))).otherwise(F.concat(_each(below([F.concat(repository, F.lit(r)) for r in ("/src", "/app", "/lib")], without_top), (".php",)), _each(below([repository], as_folders), (".php",))))
    ruby_file = F.when(required.endswith(".rb"), required).otherwise(F.concat(required, F.lit(".rb")))
    ruby = F.when(imported.startswith("require_relative") | required.rlike(r"^[.]{1,2}/"), F.array(folded(F.concat(here, ruby_file)))).otherwise(below([F.concat(repository, F.lit("/lib")), repository], ruby_file))
    quoted = F.array(folded(F.concat(here, F.regexp_replace(imported, '["<>]', ""))))
    go_parts = F.split(imported, "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(go_parts), F.lit(2))), lambda n: F.array_join(F.slice(go_parts, n, F.size(go_parts)), "/"))
    under = F.flatten(F.transform(suffixes, lambda x: F.array(*[F.concat(repository, F.lit(r + "/"), x, F.lit("/")) for r in ("", "/src", "/pkg", "/internal")])))
    go = F.when(F.size(go_parts) > 1, under).otherwise(none)
    go = F.concat(F.when(imported.rlike(r"^[.]{1,2}/"), F.array(F.concat(folded(F.concat(here, imported)), F.lit("/")))).otherwise(none), go)
    return (
        F.when(language == "rust", rust).when(language == "python", python).when(language.isin("javascript", "typescript", "vue", "svelte"), script).when(language == "go", go)
        .when(language == "java", java).when(language == "kotlin", kotlin).when(language == "csharp", csharp).when(language == "php", php).when(language == "ruby", ruby).when(language.isin("c", "cpp", "zig"), quoted).otherwise(none)
    )


def resolved(rows: DataFrame, files: DataFrame) -> DataFrame:
    """With resolved, the path of the file that an internal import or module declaration means: the first candidate that exists.

    Of a Go package, a folder, it is the first of its files that are no tests.
    """
    internal = rows.where("import_type IN ('internal', 'mod_decl')").select("path", "language", "imported").distinct()
    tried = internal.select("path", "language", "imported", F.posexplode(candidates(F.col("path"), F.col("language"), F.col("imported"))).alias("rank", "candidate"))
    there = files.select(F.col("path").alias("candidate"), F.col("path").alias("_found")).distinct()
    packages = there.where(F.col("_found").endswith(".go") & ~F.col("_found").endswith("_test.go")).groupBy(F.regexp_replace("_found", r"[^/]*$", "").alias("candidate")).agg(F.min("_found").alias("_found"))
    hit = tried.join(there.unionByName(packages), "candidate").groupBy("path", "language", "imported").agg(F.min_by("_found", "rank").alias("resolved"))
    return rows.join(hit, ["path", "language", "imported"], "left")


def exports(files: DataFrame) -> DataFrame:
    """(path, line_no, symbol, source) of the re-exports of scripts, one row per name; NULL is all names.

    A text is cut where a line begins with ``export``, so a list of names over several lines is one piece.
    """
    wanted = files.where(F.col("language").isin("javascript", "typescript", "vue") & F.contains("content", F.lit("export"))).select("path", "content")
    pieces = F.split("content", r"(?m)^(?=[ \t]*export\b)")
    breaks = F.transform(pieces, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    numbered = F.aggregate(
        F.arrays_zip(pieces.alias("text"), breaks.alias("n")),
        F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,text:string>>").alias("out")),
        lambda acc, x: F.struct((acc["line"] + x["n"]).alias("line"), F.concat(acc["out"], F.array(F.struct(acc["line"].alias("line"), x["text"].alias("text")))).alias("out")),
    )["out"]
    form = r"(?s)^[ \t]*export\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]"
    found = wanted.select("path", F.explode(numbered).alias("_e")).select("path", F.col("_e.line").alias("line_no"), F.regexp_extract("_e.text", form, 1).alias("names"), F.regexp_extract("_e.text", form, 2).alias("source")).where("source <> ''")
    listed = F.filter(F.transform(F.split(F.regexp_replace("names", r"[{}]", ""), ","), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^(?:type )?([\w$]+)", 1)), lambda x: x != "")
    return found.select("path", "line_no", F.explode_outer(F.when(F.col("names").startswith("{"), listed)).alias("symbol"), "source")


def exports_resolved(files: DataFrame) -> DataFrame:
    """(path, line_no, symbol, source, resolved) of the re-exports of ``exports``."""
    rows = exports(files).withColumn("language", F.lit("typescript")).withColumn("import_type", F.when(F.col("source").rlike(r"^[.]{1,2}/|^/"), "internal").otherwise("external")).withColumnRenamed("source", "imported")
    return resolved(rows, files).select("path", "line_no", "symbol", F.col("imported").alias("source"), "resolved")


#: The relative imports of the languages of the given tables, resolved in SQL; climbing stands at the front of a path only.
RESOLVE_SQL = """
    parts AS (SELECT DISTINCT path, language, imported, string_split(path, '/')[:-2] AS dirs, split_part(path, '/', 1) AS repo, regexp_replace(path, '[.]rs$', '') AS module FROM {rows} WHERE import_type IN ('internal', 'mod_decl')),
    rel AS (SELECT *, CASE WHEN language = 'ruby' THEN regexp_extract(imported, '[''"](.*)$', 1) || '.rb' WHEN language = 'c' THEN regexp_replace(imported, '["<>]', '', 'g') ELSE imported END AS asked FROM parts WHERE language IN ('javascript', 'typescript', 'ruby', 'c')),
    rel2 AS (SELECT *, regexp_extract(asked, '^((?:[.]{{1,2}}/)*)', 1) AS climb FROM rel),
    rel3 AS (SELECT path, language, imported, array_to_string(dirs[:len(dirs) - (len(climb) - len(replace(climb, '..', ''))) // 2], '/') || '/' || asked[len(climb) + 1:] AS target FROM rel2),
    py AS (SELECT *, len(regexp_extract(imported, '^([.]*)', 1)) AS dots, replace(regexp_replace(imported, '^[.]+', ''), '.', '/') AS rest FROM parts WHERE language = 'python'),
    py2 AS (SELECT path, language, imported, array_to_string(dirs[:len(dirs) - greatest(dots - 1, 0)], '/') || CASE WHEN rest = '' THEN '' ELSE '/' || rest END AS target FROM py WHERE dots > 0),
    ru AS (SELECT *, string_split(regexp_replace(imported, '^(?:crate|self|super)(?:::super)*(?:::|$)|^mod ', ''), '::') AS tail,
        CASE WHEN starts_with(imported, 'crate') THEN CASE WHEN regexp_matches(path, '(^|/)src/') THEN regexp_extract(path, '^(.*(?:^|/)src)/', 1) ELSE repo END
            WHEN starts_with(imported, 'super') THEN array_to_string(string_split(module, '/')[:-2], '/') ELSE module END AS base FROM parts WHERE language = 'rust'),
    ru2 AS (SELECT path, language, imported, len(tail) - n AS far, base || '/' || array_to_string(tail[:n], '/') AS target FROM ru, unnest(range(1, len(tail) + 1)) AS t(n)),
    tries AS (
        SELECT path, language, imported, e.rank, target || e.ending AS candidate FROM rel3, (VALUES (0, '.tsx'), (1, '.ts'), (2, '.jsx'), (3, '.js'), (4, '.mjs'), (5, '.cjs'), (6, '/index.tsx'), (7, '/index.ts'), (8, '/index.jsx'), (9, '/index.js')) e(rank, ending) WHERE language IN ('javascript', 'typescript') AND NOT regexp_matches(target, '[.](tsx?|jsx?|mjs|cjs|vue|svelte)$')
        UNION ALL SELECT path, language, imported, 0, target FROM rel3 WHERE language IN ('ruby', 'c') OR regexp_matches(target, '[.](tsx?|jsx?|mjs|cjs|vue|svelte)$')
        UNION ALL SELECT path, language, imported, e.rank, target || e.ending FROM py2, (VALUES (0, '.py'), (1, '/__init__.py')) e(rank, ending)
        UNION ALL SELECT path, language, imported, far * 2 + e.rank, target || e.ending FROM ru2, (VALUES (0, '.rs'), (1, '/mod.rs')) e(rank, ending)),
    hits AS (SELECT t.path, t.language, t.imported, arg_min(c.path, t.rank) AS resolved FROM tries t JOIN (SELECT DISTINCT path FROM cur) c ON c.path = t.candidate GROUP BY ALL)
"""


def suffix_lookup(wanted: DataFrame, files: DataFrame, column: str = "wanted") -> DataFrame:
    """(column, matches, path): how many files end in what is asked for, and the file if it is just one.

    Files offer all their suffixes at folder borders, so the match is an equi-join.
    """
    parts = F.split("path", "/")
    offered = files.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias(column))
    found = wanted.select(column).distinct().join(offered, column, "left").groupBy(column).agg(F.count("path").alias("matches"), F.min("path").alias("path"))
    return found.select(column, "matches", F.when(F.col("matches") == 1, F.col("path")).alias("path"))


def variant_lookup(wanted: DataFrame, files: DataFrame, column: str = "imported") -> DataFrame:
    """(column, path): the first variant of an imported path that means exactly one file."""
    tried = wanted.select(column).distinct().select(column, F.posexplode(path_variants(F.col(column))).alias("rank", "wanted"))
    unique = suffix_lookup(tried, files).where("matches = 1")
    return tried.join(unique, "wanted").groupBy(column).agg(F.min_by("path", "rank").alias("path"))
