"""Definitions in source files by line patterns, and structural patterns over them.

A definition begins at the line that names it and ends where its block ends: at the closing brace for languages with
braces, at the dedent for Python, at the matching end for Ruby. Comments and strings are blanked before braces are
counted, so what they hold does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.plans.spec import QueryError

PREVIEW_LINES = 7

_BLANK = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)\'|`[^`]*`|//[^\n]*|/\*.*?\*/', re.S)
_BLANK_HASH = re.compile(r'"""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*|^=begin\b.*?^=end\b', re.S | re.M)

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|readonly|virtual|override|async|partial|unsafe|extern|new|synchronized|native|default|volatile|transient|open|data|inner|inline|suspend|operator|lateinit|const|companion|annotation|enum|value|tailrec|external|infix|export|declare) )*"
_NOT_HEAD = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|when|using|lock|foreach|case|elseif|match|function)\b)"
_SCRIPT = [
    ("Function", r"\s*(?:export )?(?:default )?(?:async )?function\*?\s+(\w+)"), ("Class", r"\s*(?:export )?(?:default )?(?:abstract )?class (\w+)"),
    ("Function", r"\s*(?:export )?(?:const|let|var) (\w+)(?:\s*:[^=]+)? = (?:async )?(?:function\b|(?:<[^>]*>)?\([^)]*\)(?:\s*:\s*[\w<>\[\], |]+)?\s*=>|\w+\s*=>)"),
    ("Constant", r"\s*(?:export )?const (\w+)\b"), ("Variable", r"\s*(?:export )?(?:let|var) (\w+)\b"),
]
_TYPED = [("Interface", r"\s*(?:export )?(?:default )?(?:declare )?interface (\w+)"), ("Type", r"\s*(?:export )?(?:declare )?type (\w+)\b[^=]*="), ("Enum", r"\s*(?:export )?(?:declare )?(?:const )?enum (\w+)")]
_SCRIPT_METHOD = [("Method", rf"\s+(?:(?:public|private|protected|static|async|readonly|override|get|set) )*\*?{_NOT_HEAD}(#?\w+)(?:<[^>]*>)?\([^)]*\)(?:\s*:\s*[\w<>\[\], |.]+)? \{{")]
_ANNOTATION = ("Attribute", r"\s*@(?!interface\b)([A-Z][\w.]*)")
_TYPE = r"[\w<>\[\],.?]+(?:<[^;=(]*>)?(?:\[\])*"

#: Per language, (kind, pattern whose group is the name), tried in order on each line; the first that matches counts.
DEFINITIONS = {
    "rust": [
        ("Function", r"\s*(?:pub(?:\([a-z]+\))? )?(?:default )?(?:const |async |unsafe |extern (?:\"[^\"]*\" )?)*fn (\w+)"), ("Struct", r"\s*(?:pub(?:\([a-z]+\))? )?(?:struct|union) (\w+)"), ("Enum", r"\s*(?:pub(?:\([a-z]+\))? )?enum (\w+)"), ("Trait", r"\s*(?:pub(?:\([a-z]+\))? )?(?:unsafe )?trait (\w+)"),
        ("Constant", r"\s*(?:pub(?:\([a-z]+\))? )?const (\w+)\s*:"), ("Variable", r"\s*(?:pub(?:\([a-z]+\))? )?static (?:mut )?(\w+)\s*:"), ("Type", r"\s*(?:pub(?:\([a-z]+\))? )?type (\w+)"), ("Module", r"\s*(?:pub(?:\([a-z]+\))? )?mod (\w+)"), ("Macro", r"\s*macro_rules!\s*(\w+)"), ("Variable", r"\s*let (?:mut )?(\w+)\b(?!\s*[({:]{2})"), ("Attribute", r"\s*#!?\[([\w:]+)"),
    ],
    "go": [("Method", r"func \([^)]*\) (\w+)"), ("Function", r"func (\w+)"), ("Struct", r"type (\w+)(?:\[[^\]]*\])? struct\b"), ("Interface", r"type (\w+)(?:\[[^\]]*\])? interface\b"), ("Type", r"type (\w+) "), ("Constant", r"\s*const (\w+)\b"), ("Variable", r"\s*var (\w+)\b"), ("Variable", r"\s*(?:if |for |switch )?(\w+)(?:, ?\w+)* := ")],
    "javascript": [*_SCRIPT, *_SCRIPT_METHOD],
    "typescript": [*_TYPED, *_SCRIPT, *_SCRIPT_METHOD],
    "java": [
        ("Attribute", rf"\s*{_MODS}@interface (\w+)"), _ANNOTATION, ("Class", rf"\s*{_MODS}(?:class|record) (\w+)"), ("Interface", rf"\s*{_MODS}interface (\w+)"), ("Enum", rf"\s*{_MODS}enum (\w+)"),
        ("Method", rf"\s*{_MODS}(?:<[^>]*> )?(?:{_TYPE} )?{_NOT_HEAD}(\w+)\([^;]*?\)\s*(?:throws [\w., ]+)?\{{"), ("Method", rf"\s*{_MODS}(?:<[^>]*> )?(?!return\b|throw\b|new\b){_TYPE} (\w+)\([\w<>\[\], .@]*\)\s*(?:throws [\w., ]+)?;"), ("Constant", rf"\s*(?:(?:public|private|protected) )?static final {_TYPE} (\w+)\s*="), ("Variable", rf"\s*{_MODS}(?!return\b|throw\b|new\b|package\b|import\b|else\b|goto\b){_TYPE} (\w+)\s*(?:=|;)"),
    ],
    "kotlin": [("Attribute", rf"\s*{_MODS}annotation class (\w+)"), _ANNOTATION, ("Interface", rf"\s*{_MODS}(?:fun )?interface (\w+)"), ("Class", rf"\s*{_MODS}(?:class|object) (\w+)"), ("Function", rf"\s*{_MODS}fun (?:<[^>]*> )?(?:[\w<>?]+\.)?(\w+)"), ("Constant", rf"\s*{_MODS}(?<=const )val (\w+)"), ("Constant", r"\s+val (\w+)\b(?=.*=)"), ("Variable", rf"\s*{_MODS}va[lr] (?:[\w<>?]+\.)?(\w+)")],
    "c": [("Macro", r"\s*#\s*define (\w+)"), ("Type", r"typedef\b.*?(\w+)\s*;"), ("Struct", r"\s*(?:typedef )?struct (\w+)\s*\{"), ("Type", r"\s*(?:typedef )?union (\w+)\s*\{"), ("Enum", r"\s*(?:typedef )?enum (\w+)"), ("Function", rf"(?:(?:static|inline|extern|const|unsigned|signed|struct) )*{_NOT_HEAD}[A-Za-z_]\w*[ *]+(\w+)\([^;]*\)\s*\{{?\s*$"), ("Variable", rf"\s*(?:(?:static|extern|const|unsigned|signed|volatile|register) )*{_NOT_HEAD}(?!typedef\b|goto\b|break\b|continue\b)(?:struct )?[A-Za-z_]\w*[ *]+(\w+)(?:\[[^\]]*\])*\s*(?:=|;)")],
    "cpp": [
        ("Macro", r"\s*#\s*define (\w+)"), ("Namespace", r"\s*(?:inline )?namespace (\w+)"), ("Class", r"\s*(?:template\s*<[^>]*>\s*)?class (\w+)(?!.*;\s*$)"), ("Struct", r"\s*(?:template\s*<[^>]*>\s*)?struct (\w+)(?!.*;\s*$)"), ("Enum", r"\s*enum (?:class |struct )?(\w+)"), ("Type", r"\s*using (\w+)\s*="), ("Type", r"\s*typedef\b.*?(\w+)\s*;"),
        ("Method", rf"(?:[\w:<>,*&~ ]+[ *&])?\w+(?:<[^>]*>)?::(~?\w+)\([^;]*\)[^;]*\{{?\s*$"), ("Function", rf"\s*(?:template\s*<[^>]*>\s*)?(?:(?:static|inline|virtual|constexpr|explicit|extern|const|unsigned|friend) )*{_NOT_HEAD}[A-Za-z_][\w:<>,]*[ *&]+(\w+)\([^;]*\)\s*(?:const|noexcept|override|final|->\s*[\w:<>]+|\s)*\{{?\s*$"), ("Variable", rf"\s*(?:(?:static|constexpr|const|mutable|extern|unsigned|inline) )*{_NOT_HEAD}(?!typedef\b|goto\b|break\b|continue\b|using\b|delete\b|public\b|private\b)[A-Za-z_][\w:<>,]*[ *&]+(\w+)(?:\[[^\]]*\])*\s*(?:=|;|\{{[^{{}}]*\}};)"),
    ],
    "csharp": [
        ("Attribute", r"\s*\[([A-Z]\w*)[\](,]"), ("Namespace", r"\s*namespace ([\w.]+)"), ("Attribute", rf"\s*{_MODS}class (\w+Attribute)\b"), ("Class", rf"\s*{_MODS}class (\w+)"), ("Interface", rf"\s*{_MODS}interface (\w+)"), ("Type", rf"\s*{_MODS}record (?:struct |class )?(\w+)"), ("Struct", rf"\s*{_MODS}(?:ref )?struct (\w+)"), ("Enum", rf"\s*{_MODS}enum (\w+)"), ("Type", rf"\s*{_MODS}delegate {_TYPE} (\w+)"), ("Event", rf"\s*{_MODS}event {_TYPE} (\w+)"),
        ("Property", rf"\s*{_MODS}{_TYPE} (this)\["), ("Method", rf"\s*{_MODS}(?:{_TYPE} )?{_NOT_HEAD}(\w+)(?:<[^>]*>)?\([^;]*\)\s*(?:where .*|:.*)?(?:\{{|=>)?\s*$"), ("Variable", rf"\s*{_MODS}(?!return\b|throw\b|using\b|namespace\b|else\b|await\b){_TYPE} (\w+)\s*(?:=[^=>]|;|\{{|=>)"),
    ],
    "php": [
        ("Attribute", r"\s*#\[(\w+)"), ("Namespace", r"\s*namespace ([\w\\]+)"), ("Class", rf"\s*{_MODS}class (\w+)"), ("Interface", r"\s*interface (\w+)"), ("Trait", r"\s*trait (\w+)"), ("Enum", r"\s*enum (\w+)"), ("Function", rf"\s*{_MODS}function &?(\w+)"), ("Constant", rf"\s*{_MODS}const (?:\w+ )?(\w+)\s*="), ("Constant", r"\s*define\(['\"](\w+)"), ("Variable", r"\s*(?:(?:public|private|protected|static|var|readonly) )+(?:\??[\w\\|]+ )?\$(\w+)"), ("Variable", r"\s*\$(\w+)\s*=(?!=)"),
    ],
    "python": [("Class", r"\s*class (\w+)"), ("Function", r"\s*(?:async )?def (\w+)"), ("Function", r"\s*(\w+)\s*=\s*lambda\b"), ("Constant", r"([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)"), ("Variable", r"\s*([A-Za-z_]\w*)\s*(?::[^=()]+)?=(?!=)")],
    "ruby": [("Class", r"\s*class (?!<<)(?:\w+::)*(\w+)"), ("Module", r"\s*module (?:\w+::)*(\w+)"), ("Method", r"\s*(?:private |public |protected )?def (?:self\.)?(\w+[?!=]?)"), ("Property", r"\s*attr_(?:reader|writer|accessor) :(\w+)"), ("Constant", r"\s*([A-Z][A-Z0-9_]*)\s*=(?!=)"), ("Variable", r"\s*(@@?\w+)\s*(?:\|\|)?=(?!=)"), ("Variable", r"\s*([a-z_]\w*)\s*=(?![=~>])")],
    "zig": [("Function", r"\s*(?:pub |export |inline |extern )*fn (\w+)"), ("Struct", r"\s*(?:pub )?const (\w+)\s*=\s*(?:packed |extern )?(?:struct|union)\b"), ("Enum", r"\s*(?:pub )?const (\w+)\s*=\s*enum\b"), ("Constant", r"\s*(?:pub )?const (\w+)\b"), ("Variable", r"\s*(?:pub |threadlocal )?var (\w+)\b"), ("Function", r"\s*test \"([^\"]+)\"")],
}
#: Languages whose code stands in script blocks of a page.
EMBEDDED = {"vue": "typescript", "svelte": "typescript"}
_BLOCKS = re.compile(r"<script\b[^>]*>(.*?)(?:</script>|\Z)", re.S | re.I)
_REACTIVE = re.compile(r"\s*\$:\s*(?:\{|(\w+)\s*=)?")
#: Kinds that hold methods.
_OWNERS = {"Class", "Trait", "Module", "Interface", "Struct", "Enum"}
_COMPILED = {language: [(kind, re.compile(p)) for kind, p in rows] for language, rows in DEFINITIONS.items()}
_RUBY_OPEN = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def _blanked(text: str, language: str) -> list[str]:
    pattern = _BLANK_HASH if language in ("python", "ruby") else _BLANK
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")


def _end(code: list[str], start: int, language: str) -> int:
    """Index of the last line of the definition that begins at a line."""
    if language == "python":
        indent = len(code[start]) - len(code[start].lstrip())
        last = start
        depth = 0
        for i in range(start, len(code)):
            line = code[i]
            if not line.strip():
                continue
            if i > start and depth <= 0 and len(line) - len(line.lstrip()) <= indent:
                break
            depth += sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
            last = i
        return last
    if language == "ruby":
        depth = 0
        for i in range(start, len(code)):
            depth += bool(_RUBY_OPEN.search(code[i])) - len(re.findall(r"^\s*end\b", code[i]))
            if depth <= 0:
                return i
        return len(code) - 1
    depth, opened = 0, False
    for i in range(start, len(code)):
        opens = sum(map(code[i].count, "{[("))
        depth += opens - sum(map(code[i].count, "}])"))
        opened |= opens > 0
        if depth <= 0 and (opened or code[i].rstrip().endswith((";", ",")) or language in ("go", "javascript", "typescript", "kotlin")):
            below = next((line.strip() for line in code[i + 1 :] if line.strip()), "")
            if below.startswith("{") and not code[i].rstrip().endswith((";", "}")):
                continue  # the block begins on the next line
            return i
    return len(code) - 1


def symbols_of(text: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, start_line, end_line, preview) of the definitions of a text."""
    if language in EMBEDDED and text:
        return _embedded(text.replace("\r\n", "\n"), language)
    if language not in _COMPILED or not text:
        return []
    text = text.replace("\r\n", "\n")
    raw, code = text.split("\n"), _blanked(text, language)
    out, owners = [], []
    for i, line in enumerate(code):
        for kind, pattern in _COMPILED[language]:
            m = pattern.match(raw[i] if language == "zig" and "test" in line else line)
            if not m:
                continue
            end = i if kind == "Attribute" and "class" not in line and "interface" not in line else _end(code, i, language)
            if kind == "Function" and any(a < i <= b for a, b in owners) and language in ("python", "rust", "kotlin", "php", "cpp"):
                kind = "Method"
            if kind == "Method" and language == "ruby" and not any(a < i <= b for a, b in owners):
                kind = "Function"
            if kind == "Method" and language in ("javascript", "typescript") and not any(a < i <= b for a, b in owners):
                break
            if kind in _OWNERS and end > i:
                owners.append((i, end))
            out.append((m[1], kind, i + 1, end + 1, "\n".join(raw[i : i + PREVIEW_LINES])))
            break
        else:
            if language == "rust" and line.startswith("impl"):
                owners.append((i, _end(code, i, language)))
    return out


def _embedded(text: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """The definitions in the script blocks of a page, at their lines in the page."""
    out, rows = [], text.split("\n")
    for block in _BLOCKS.finditer(text):
        above = text.count("\n", 0, block.start(1))
        out += [(name, kind, start + above, end + above, preview) for name, kind, start, end, preview in symbols_of(block[1], EMBEDDED[language])]
        if language == "svelte":
            for i, line in enumerate(block[1].split("\n")):
                if (m := _REACTIVE.match(line)) and m[1]:
                    out.append((m[1], "Variable", i + above + 1, i + above + 1, "\n".join(rows[i + above : i + above + PREVIEW_LINES])))
    return out


def extract(files: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, name, kind, start_line, end_line, preview) of the definitions in files (*keys, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *row) for i, (t, x) in enumerate(zip(batch["content"], batch["language"])) for row in symbols_of(t, x)]
            rows = pd.DataFrame(found, columns=["_i", "name", "kind", "start_line", "end_line", "preview"])
            kept = batch[keys].iloc[rows["_i"].astype(int)].reset_index(drop=True)
            yield pd.concat([kept, rows.drop(columns="_i")], axis=1)

    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.where("language IS NOT NULL AND content IS NOT NULL").select(*keys, *[c for c in ("language", "content") if c not in keys]).mapInPandas(run, f"{kinds}, name string, kind string, start_line int, end_line int, preview string")


_ATTRIBUTE = re.compile(r"#!?\[|@[^\W\d_]")


def doc_comment(rows: list[str], start_line: int, language: str | None) -> str | None:
    """The documentation of the definition at a line (from 1), without comment marks; None if there is none.

    Python has it in a docstring up to 3 lines below, the others in the comment above, attributes and decorators skipped.
    """
    if not 1 <= start_line <= len(rows):
        return None
    if language == "python":
        return _docstring(rows, start_line)
    i = start_line - 2
    while i >= 0 and _ATTRIBUTE.match(rows[i].strip()):
        i -= 1
    if i < 0:
        return None
    if language not in ("ruby", "go") and rows[i].strip().endswith("*/"):
        return _block_comment(rows, i)
    mark = {"ruby": r"#(?!!)", "go": "//", "rust": r"///+|//!"}.get(language, "//+")
    out = []
    while i >= 0 and (m := re.match(mark, rows[i].strip())):
        out.append(rows[i].strip()[m.end() :].strip())
        i -= 1
    return "\n".join(reversed(out)).strip() or None


def _docstring(rows: list[str], start_line: int) -> str | None:
    for i in range(start_line, min(len(rows), start_line + 3)):
        text = rows[i].strip()
        if not text:
            continue
        quote = text[:3]
        if quote not in ('"""', "'''"):
            return None
        if len(text) > 6 and text.endswith(quote) and text[3:-3].strip():
            return text[3:-3].strip()
        out = [text[3:].strip()]
        for row in rows[i + 1 :]:
            if quote in row:
                out.append(row.strip().removesuffix(quote).strip())
                break
            out.append(row.strip())
        return "\n".join(out).strip() or None
    return None


def _block_comment(rows: list[str], end: int) -> str | None:
    """The block comment whose last line is given; None if the line ends a comment behind code."""
    out = []
    for i in range(end, -1, -1):
        text = rows[i].strip()
        if i < end and "*/" in text:
            return None
        text = text.removesuffix("*/")
        if text.startswith("/*"):
            out.append(text[2:].lstrip("*").rstrip("*").strip())
            return "\n".join(x for x in reversed(out) if x).strip() or None
        if "/*" in text:
            return None
        out.append(text.strip().strip("*").strip() if i == end else text.lstrip("*").strip())
    return None


def doc_comments(files: DataFrame) -> DataFrame:
    """(path, symbol, start_line, comment) of the documented ones of defs (start_line, symbol) in files (path, language, content, defs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, language, content, defs in zip(batch["path"], batch["language"], batch["content"], batch["defs"]):
                rows = content.split("\n")
                found += [(path, d["symbol"], d["start_line"], c) for d in defs if (c := doc_comment(rows, d["start_line"], language))]
            yield pd.DataFrame(found, columns=["path", "symbol", "start_line", "comment"])

    return files.where("content IS NOT NULL").select("path", "language", "content", "defs").mapInPandas(run, "path string, symbol string, start_line int, comment string")


def structure_search(files: DataFrame, pattern: str, language: str, keys: list[str], text_filter: str | None = None) -> DataFrame:
    """(*keys, name, kind, start_line, end_line, preview) of what a structural pattern captures in the texts of a language.

    The language is required. With ``text_filter``, only texts that contain it are parsed: the test reaches the scan.
    The preview of a captured node is its whole text.
    """
    if not language:
        raise QueryError("structure", "a structural pattern needs a language")
    wanted = files.where(F.col("language") == language)
    if text_filter:
        wanted = wanted.where(F.contains("content", F.lit(text_filter)))
    return structure_filter(extract(wanted, keys), pattern)


#: Node kinds of structural patterns and the symbol kinds that they stand for; fixed values.
NODE_KINDS = {
    "function_item": ("Function", "Method"), "function_definition": ("Function", "Method"), "function_declaration": ("Function",), "method_declaration": ("Method",), "method_definition": ("Method",), "method": ("Method",),
    "struct_item": ("Struct",), "struct_specifier": ("Struct",), "enum_item": ("Enum",), "enum_declaration": ("Enum",), "enum_specifier": ("Enum",), "trait_item": ("Trait",),
    "namespace_definition": ("Namespace",), "namespace_declaration": ("Namespace",), "struct_declaration": ("Struct",), "record_declaration": ("Type",), "trait_declaration": ("Trait",), "union_specifier": ("Type",), "type_alias_declaration": ("Type",), "static_item": ("Variable",), "let_declaration": ("Variable",), "attribute_item": ("Attribute",), "property_declaration": ("Variable",), "module": ("Module",),
    "class_definition": ("Class",), "class_declaration": ("Class",), "class": ("Class",), "interface_declaration": ("Interface",), "const_item": ("Constant",), "type_item": ("Type",), "mod_item": ("Module",), "macro_definition": ("Macro",),
}
_PATTERN = re.compile(r'\s*\(\s*(\w+)\s*(?:name:\s*\(\s*(?:identifier|type_identifier|property_identifier|constant)\s*\)\s*(?:@\w+)?)?\s*\)\s*(@\w+)?\s*(?:\(#(eq|match)\?\s+@\w+\s+"([^"]*)"\)\s*)?')


def structure_filter(df: DataFrame, pattern: str) -> DataFrame:
    """Symbols (name, kind, ...) that a pattern such as ``(function_item name: (identifier) @name) @f`` captures.

    Supported: one node kind, optionally its name, and a comparison #eq? or #match? of the name. Others are refused.
    """
    m = _PATTERN.fullmatch(pattern)
    if not m or "@" not in pattern:
        raise QueryError("structure", f"unsupported pattern: {pattern}")
    if m[1] not in NODE_KINDS:
        raise QueryError("structure", f"unknown node kind {m[1]}")
    out = df.where(F.col("kind").isin(*NODE_KINDS[m[1]]))
    if m[3] == "eq":
        out = out.where(F.col("name") == m[4])
    elif m[3] == "match":
        out = out.where(F.col("name").rlike(m[4]))
    return out
