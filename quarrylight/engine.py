"""The searching interface: a corpus and its symbols, asked by a QuerySpec, answered by a page with all that goes with it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import required_literals
from quarrylight.operators import search, symbols
from quarrylight.operators.incremental import run_states
from quarrylight.plans.spec import QueryError, QuerySpec, instruction, parse_command

MANY_CANDIDATES = 1_000  # fixed value: candidates beyond which a symbol search is said to be slow


@dataclass
class Status:
    """Whether the symbols are as new as the files: fresh, stale, or missing without a completed run."""

    state: str
    detail: str = ""

    @property
    def trusted(self) -> bool:
        return self.state == "fresh"


@dataclass
class Response:
    page: search.Page
    status: Status
    instruction: str | None = None
    warnings: list[str] = field(default_factory=list)


class Engine:
    """Searches over files (path, language, content, ...) and symbols (path, language, start_line, end_line, kind, symbol, preview).

    runs     rows of the indexing log (run_id, state, updated_at); without them nothing is known of freshness
    branch   the branch that is looked at; ``branches`` (branch, commit) says which were indexed and as of which commit
    """

    def __init__(self, spark: SparkSession, files: DataFrame, symbol_rows: DataFrame | None = None, runs: DataFrame | None = None, branches: DataFrame | None = None, branch: str | None = None, commit: str | None = None) -> None:
        missing = {"path", "language", "content"} - set(files.columns)
        if missing:
            raise QueryError("index", f"the corpus lacks {', '.join(sorted(missing))}; build it again")
        self.spark, self.files, self.symbols, self.runs = spark, files, symbol_rows, runs
        self.branches, self.branch, self.commit = branches, branch, commit
        self._indexed: int | None = None

    def indexed(self) -> int:
        if self._indexed is None:
            self._indexed = self.files.select("path").count()
        return self._indexed

    def status(self) -> Status:
        """The first that holds: no completed run, another branch, another commit, files newer than the last completed run."""
        if self.branch is not None and self.branches is not None:
            known = self.branches.where(F.col("branch") == self.branch).select("commit").head()
            if known is None:
                return Status("stale", f"branch {self.branch} is not indexed")
            if self.commit is not None and known[0] != self.commit:
                return Status("stale", f"indexed at {known[0]}, now at {self.commit}")
        if self.runs is None:
            return Status("fresh")
        done = self.runs.join(run_states(self.runs).where("state = 'completed'"), "run_id", "left_semi").agg(F.max("updated_at")).first()[0]
        if done is None:
            return Status("missing", "no run has completed")
        if "last_indexed" in self.files.columns:
            newest = self.files.agg(F.max("last_indexed")).first()[0]
            if newest is not None and newest > done:
                return Status("stale", f"files changed at {newest}, the last run completed at {done}")
        return Status("fresh")

    def within(self, seconds: int, work: Callable[[], object]) -> object:
        """What work returns; its jobs are cancelled and QueryError raised when the time is over. 0 is no limit."""
        if seconds <= 0:
            return work()
        context, tag, over = self.spark.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()

        def end() -> None:
            over.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, end)
        context.addJobTag(tag)
        timer.start()
        try:
            out = work()
        except Exception as e:  # what the cancelled job surfaces as depends on where it was
            if over.is_set():
                raise QueryError("timeout", f"no answer within {seconds} s") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        if over.is_set():
            raise QueryError("timeout", f"no answer within {seconds} s")
        return out

    def hits(self, spec: QuerySpec) -> DataFrame:
        """All rows a spec asks for, refused if it is too broad."""
        spec = spec.resolved()
        if spec.use_ast:
            wanted = search.file_filter(self.files, spec)
            search.check(spec, candidates=wanted.count())
            found = symbols.structure_search(wanted, spec.pattern, spec.language, ["path", "language"])
            return found.select("path", "language", "start_line", "end_line", "kind", F.col("name").alias("symbol"), "preview")
        if spec.symbols or spec.kind:
            if self.symbols is None:
                raise QueryError("index", "there are no symbols; extract them first")
            out = search.symbol_hits(self.symbols, spec, self.files if not spec.keyword else None, self.candidates(spec))
        else:
            out = search.text_hits(self.files, spec, self.indexed())
        if spec.expand:
            out = search.expanded(out, self.files)
        return search.paths_only(out) if spec.paths_only else out

    def candidates(self, spec: QuerySpec) -> int:
        """Files that can have hits."""
        wanted = search.file_filter(self.files, spec)
        literals = [] if spec.keyword else required_literals(spec.pattern) if spec.use_regex else [spec.pattern]
        for literal in literals:
            wanted = wanted.where(F.contains("content", F.lit(literal)))
        return wanted.select("path").count()

    def search(self, spec: QuerySpec) -> DataFrame:
        """A page of hits in total order."""
        return self.search_with_metadata(spec).page.rows

    def search_with_metadata(self, spec: QuerySpec) -> Response:
        """A page with its totals, the state of the index, warnings and what to do next."""
        asked = spec.resolved()
        status = self.status()
        warnings = [f"the index is {status.state}: {status.detail}"] if not status.trusted else []
        if asked.use_regex and not required_literals(asked.pattern):
            warnings.append("no literal of the pattern narrows the search: every file is read")
        if (asked.symbols or asked.kind) and not asked.keyword and (n := self.candidates(asked)) > MANY_CANDIDATES:
            warnings.append(f"{n} files may have hits")
        page = self.within(asked.timeout, lambda: search.paged(self.hits(asked), asked))
        if asked.context_before or asked.context_after:
            page = replace(page, rows=search.ordered(search.with_context(page.rows, self.files, asked.context_before, asked.context_after)))
        return Response(page, status, instruction(page.count, page.total, page.has_more, asked), warnings)

    def find_symbol(self, name: str) -> DataFrame:
        return self.search(QuerySpec(pattern=name, symbols=True, exact=True))

    def list_by_kind(self, kind: str) -> DataFrame:
        """All symbols of a kind, without a limit."""
        return search.ordered(search.symbol_hits(self.symbols, QuerySpec(kind=kind, limit=None)))

    def search_ast(self, pattern: str, language: str, globs: tuple[str, ...] = (), text_filter: str | None = None) -> DataFrame:
        """What a structural pattern captures in the files of a language, those that contain ``text_filter`` only."""
        spec = QuerySpec(pattern=pattern, language=language, use_ast=True, globs=globs, limit=None, timeout=60)
        if text_filter is None:
            return self.search(spec)
        narrowed = Engine(self.spark, self.files.where(F.contains("content", F.lit(text_filter))), self.symbols, self.runs)
        return narrowed.search(replace(spec, force=True))

    def command(self, text: str) -> Response:
        return self.search_with_metadata(parse_command(text))
