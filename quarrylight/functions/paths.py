"""Paths, languages and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language, and other spellings of languages.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "java": "java", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "zig": "zig", "vue": "vue", "svelte": "svelte",
}
ALIASES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c++": "cpp", "cs": "csharp", "c#": "csharp", "rb": "ruby", "kt": "kotlin",
}


def clean_path(path: Column) -> Column:
    """The path with slashes only, without ``.`` segments and repeated or leading slashes."""
    slashes = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(slashes, r"(^|/)(?:\./)+", "$1"), "^/", "")


def clean_path_sql(path: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({path}, '[\\/]+', '/', 'g'), '(^|/)(?:\./)+', '\1', 'g'), '^/', '')"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """Language of a path's extension, NULL for others."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(pairs, extension(path))


def language_named(name: str) -> str:
    name = name.strip().lower()
    return ALIASES.get(name, name)


def _case_sql() -> str:
    return "CASE lower(regexp_extract({0}, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in LANGUAGES.items()) + " END"


def language_sql(path: str) -> str:
    return _case_sql().replace("{0}", path)


def glob_regex(glob: str) -> str:
    """A pattern for whole paths: ``*`` and ``?`` cross slashes, ``**/`` stands for any folders, braces for choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unbalanced braces in glob {glob!r}")
    return f"^{out}$"


def first_segment(path: Column) -> Column:
    """The top folder of a path, ``.`` for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def prefixes(path: Column) -> Column:
    """All folders that contain the path, the top one first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def normalized_lookup(path: Column) -> Column:
    """A path as asked for: without leading ./ and ../; an absolute one from its first project folder, else its name."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(?:\./)+", ""), r"^(?:\.\./)+", "")
    # Fixed values, in order of priority.
    markers = ("services", "src", "app", "lib", "packages", "modules")
    at = None
    for marker in markers:
        here = F.when(F.instr(bare, marker) > 0, bare.substr(F.instr(bare, marker), F.length(bare)))
        at = here if at is None else F.coalesce(at, here)
    return F.when(bare.rlike(r"^[/\\]"), F.coalesce(at, F.regexp_extract(bare, r"([^/\\]*)$", 1))).otherwise(bare)


def path_variants(imported: Column) -> Column:
    """Suffixes of an imported path, the longest first, each with the extensions to try."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.replace(imported, F.lit("\\"), F.lit("/")), F.lit("::"), F.lit("/")), "^\"+|\"+$", ""), "^'+|'+$", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    extensions = F.array(*[F.lit(e) for e in (".rs", ".ts", ".js", ".py")])

    def of(n: Column) -> Column:
        suffix = F.array_join(F.slice(parts, n, F.size(parts)), "/")
        first = F.array(F.when(suffix.endswith(".php"), suffix).otherwise(F.concat(suffix, F.lit(".php"))))
        more = F.when(F.contains(suffix, F.lit(".")), F.array().cast("array<string>")).otherwise(F.transform(extensions, lambda e: F.concat(suffix, e)))
        return F.concat(first, more)

    return F.when(F.size(parts) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), of))).otherwise(F.array().cast("array<string>"))
