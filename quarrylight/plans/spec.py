"""What a search asks for, its checks, and the command string that spells it."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field, replace

from quarrylight.functions.paths import language_named

# Words that, as a pattern of a symbol search, list all symbols, and the kind each stands for.
KEYWORDS = (
    "fn", "function", "def", "func", "class", "struct", "enum", "interface", "trait", "type", "record", "mod", "module", "namespace", "const", "static", "let", "var",
    "impl", "async", "object", "annotation", "protocol", "union", "typedef", "delegate", "template", "@interface",
)
KEYWORD_KINDS = {
    "class": "Class", "struct": "Struct", "enum": "Enum", "interface": "Interface", "trait": "Trait", "type": "Type", "record": "Struct",
    "function": "Function", "fn": "Function", "def": "Function", "func": "Function", "const": "Constant", "static": "Constant", "var": "Variable", "let": "Variable",
    "mod": "Module", "module": "Module", "namespace": "Module",
}
SHORT_PATTERN, LARGE_INDEX, SHORT_IN_LARGE = 3, 20_000, 4
BROAD_CANDIDATES, BROAD_KEYWORD, BROAD_AST_GLOB, BROAD_AST = 50_000, 20_000, 10_000, 100


class QueryError(ValueError):
    """A search that is refused; ``code`` tells why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class QuerySpec:
    pattern: str = ""
    language: str | None = None
    kind: str | None = None
    use_regex: bool = False
    use_contains: bool = False
    use_ast: bool = False
    symbols: bool = False
    exact: bool = False
    limit: int | None = 100
    offset: int = 0
    expand: bool = False
    file: str | None = None
    globs: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    paths_only: bool = False
    force: bool = False
    timeout: int = 30
    dependencies: bool = False
    context_before: int = 0
    context_after: int = 0
    count: bool = False
    all: bool = False
    unknown: tuple[str, ...] = field(default=(), compare=False)

    @property
    def keyword(self) -> bool:
        return (self.symbols or self.kind is not None) and (self.pattern in KEYWORDS or not self.pattern)

    def resolved(self) -> QuerySpec:
        """With what follows from other fields: kinds search symbols, keywords stand for kinds, paths and counts have no limit."""
        out = self
        if out.kind is not None and not out.symbols:
            out = replace(out, symbols=True)
        if out.keyword and out.kind is None and out.pattern in KEYWORD_KINDS:
            out = replace(out, kind=KEYWORD_KINDS[out.pattern])
        if out.all or out.count or out.paths_only and out.limit == 100:
            out = replace(out, limit=None)
        return out


def check(spec: QuerySpec, files: int | None = None, candidates: int | None = None) -> None:
    """Raise QueryError for a search that can't be answered or would be too broad; ``force`` lets the broad ones pass."""
    if spec.use_regex and spec.use_contains:
        raise QueryError("conflict", "regex and contains exclude each other")
    if spec.exact and spec.use_contains:
        raise QueryError("conflict", "exact and contains exclude each other")
    if spec.limit == 0:
        raise QueryError("limit", "a limit must be at least 1")
    if spec.use_ast and not spec.language:
        raise QueryError("language", "a structure search needs a language")
    if spec.force:
        return
    free = spec.use_regex or spec.keyword
    if files is not None and files > LARGE_INDEX and len(spec.pattern) < SHORT_IN_LARGE and not free:
        raise QueryError("broad", f"a pattern of {len(spec.pattern)} characters is too short for {files} files")
    if len(spec.pattern) < SHORT_PATTERN and not free and not spec.use_ast:
        raise QueryError("short", f"a pattern needs at least {SHORT_PATTERN} characters")
    if candidates is None:
        return
    if spec.use_ast:
        most = BROAD_AST_GLOB if spec.globs else BROAD_AST
    elif spec.symbols or spec.kind:
        most = BROAD_KEYWORD if spec.keyword else BROAD_CANDIDATES
    else:
        return
    if candidates > most or spec.use_ast and not spec.globs and candidates >= most:
        raise QueryError("broad", f"{candidates} candidates; at most {most} are searched")


def parse_command(text: str) -> QuerySpec:
    """The search that ``query "pattern" --flag value`` spells; unknown flags are kept aside, no limit unless given."""
    words = shlex.split(text)
    if words[:1] == ["query"]:
        words = words[1:]
    if not words or words[0].startswith("--"):
        raise QueryError("command", "a command begins with its pattern")
    values: dict = {"pattern": words[0], "limit": None}
    globs, excludes, unknown = [], [], []
    flags = {"--symbols": "symbols", "-s": "symbols", "--regex": "use_regex", "-r": "use_regex", "--contains": "use_contains", "--exact": "exact", "--expand": "expand", "--paths": "paths_only", "-p": "paths_only", "--force": "force", "-f": "force", "--dependencies": "dependencies", "--ast": "use_ast", "--count": "count", "-c": "count", "--all": "all", "-a": "all"}
    i = 1
    while i < len(words):
        word, value = words[i], words[i + 1] if i + 1 < len(words) else None
        i += 1
        if word in flags:
            values[flags[word]] = True
            continue
        if word in ("--lang", "-l", "--kind", "-k", "--limit", "-n", "--offset", "-o", "--file", "--glob", "-g", "--exclude", "-x", "--timeout"):
            if value is None:
                raise QueryError("command", f"{word} needs a value")
            i += 1
            if word in ("--lang", "-l"):
                values["language"] = language_named(value)
            elif word in ("--kind", "-k"):
                values["kind"] = value[:1].upper() + value[1:].lower()
            elif word in ("--glob", "-g"):
                globs.append(value)
            elif word in ("--exclude", "-x"):
                excludes.append(value)
            elif word == "--file":
                values["file"] = value
            else:
                try:
                    values[{"--limit": "limit", "-n": "limit", "--offset": "offset", "-o": "offset", "--timeout": "timeout"}[word]] = int(value)
                except ValueError as e:
                    raise QueryError("command", f"{word} needs a number") from e
            continue
        unknown.append(word)
    return QuerySpec(**values, globs=tuple(globs), excludes=tuple(excludes), unknown=tuple(unknown))


def instruction(results: int, total: int, has_more: bool, spec: QuerySpec) -> str | None:
    """What a reader of a page should do next; the first rule that holds counts."""
    rules = (
        (results == 0, "no_results"),
        (total >= 500, "too_broad"),
        (has_more, "paginated"),
        (results == 1 and spec.symbols, "single_symbol"),
        (2 <= results <= 10 and spec.symbols, "few_symbols"),
        (101 <= total < 500, "many"),
        (results >= 100 and not spec.symbols, "full_page_of_text"),
        (spec.paths_only, "paths"),
        (spec.use_ast, "structure"),
        (spec.use_regex and results >= 100, "regex_broad"),
        (spec.language is not None and results <= 5, "language_narrow"),
        (bool(spec.globs) and results <= 10, "glob_narrow"),
        (spec.exact and results <= 5, "exact_narrow"),
    )
    return next((name for holds, name in rules if holds), None)


def evaluation_score(total: int, queries: int, most: int, least: int, gathered: bool = False, confidence: float = 0.0, strictness: float = 0.5) -> tuple[float, bool]:
    """Score of a result set between 0 and 1, and whether it is good enough."""
    score = 1.0
    if total == 0 and queries == 0:
        score -= 0.0 if confidence >= 0.9 else 0.2
    elif total == 0:
        score -= 0.6 if gathered else 0.8
    elif total > most:
        score -= min(total / most - 1, 0.8)
    elif total < least:
        score -= 0.3
    score = min(max(score, 0.0), 1.0)
    return score, score >= 0.4 + strictness * 0.2
