"""Queries of the search, graph, snapshot and activity operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.corpus import CORPUS_SQL, LINES_CTE, corpus, lines
from quarrylight.functions.paths import first_segment, path_variants, prefixes
from quarrylight.functions.text import line_array, required_literals, truncated, word_pattern_re2
from quarrylight.operators import activity, detection, graph, imports, search, snapshots, symbols, trigram
from quarrylight.operators.incremental import run_states
from quarrylight.plans.registry import Registry
from quarrylight.plans.spec import QuerySpec, evaluation_score, instruction, parse_command
from quarrylight.sources.shared import shared_dir
from quarrylight.sources.tables import table
from quarrylight.streaming.watch import classify, debounced

REGISTRY = Registry()
add = REGISTRY.add

WORD, LITERAL, REGEX, QUESTION = "ledger", "stale", r"fn [a-z]+_trigram\(", "Where does the search for markers skip the ledger?"

_CUR, _LIN = CORPUS_SQL, LINES_CTE
_RUNS = "runs AS (SELECT run_id, arg_max(state, updated_at) AS state FROM indexing_status GROUP BY run_id)"
_SYM = f"""{_CUR}, {_RUNS}, sym AS (SELECT DISTINCT c.path, c.language, s.start_line, s.end_line, s.kind, s.name AS symbol, s.preview
    FROM symbols s JOIN cur c ON s.file_id = c.file_id AND s.file_hash = c.hash JOIN runs r ON r.run_id = s.run_id AND r.state = 'completed' WHERE s.name IS NOT NULL)"""
_E = "e AS (SELECT DISTINCT source_file_id AS src, target_file_id AS dst, import_type FROM dependency_edges WHERE snapshot_id = (SELECT max(snapshot_id) FROM dependency_edges))"
_N = "n AS (SELECT DISTINCT id, path, language, line_count FROM snap_files WHERE snapshot_id = (SELECT max(snapshot_id) FROM snap_files) UNION SELECT file_id, path, language, line_count FROM core_files)"
_EN = f"{_E}, {_N}"


def _cycles_sql(edges: str, name: str = "scc") -> str:
    """(id, component) of the nodes on directed cycles of an edge table, parent declarations apart, by its whole closure."""
    return f"""{name}_c AS (SELECT DISTINCT src, dst FROM {edges} WHERE src IS NOT NULL AND dst IS NOT NULL AND import_type IS DISTINCT FROM 'mod_decl'),
    {name}_r AS (SELECT src, dst FROM {name}_c UNION SELECT r.src, c.dst FROM {name}_r r JOIN {name}_c c ON r.dst = c.src),
    {name} AS (SELECT a.src AS id, max(a.dst) AS component FROM {name}_r a JOIN {name}_r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


def _islands_sql(edges: str, nodes: str, name: str = "isl") -> str:
    """(id, component) of the undirected components, the least id of each being its name."""
    return f"""{name}_u AS (SELECT src AS a, dst AS b FROM {edges} WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM {edges} WHERE src IS NOT NULL AND dst IS NOT NULL),
    {name}(id, component) USING KEY (id) AS (SELECT id, id FROM (SELECT id FROM {nodes} UNION SELECT a FROM {name}_u)
        UNION (SELECT u.a, min(cc.component) FROM {name} cc JOIN {name}_u u ON u.b = cc.id JOIN recurring.{name} r ON r.id = u.a WHERE cc.component < r.component GROUP BY u.a))"""


def _at_sql(which: str, tag: str) -> str:
    """Edges e<tag> and nodes n<tag> of one of the last two snapshots."""
    return f"""e{tag} AS (SELECT DISTINCT source_file_id AS src, target_file_id AS dst, import_type FROM dependency_edges WHERE snapshot_id = (SELECT {which} FROM ids)),
    n{tag} AS (SELECT DISTINCT id, path FROM snap_files WHERE snapshot_id = (SELECT {which} FROM ids) UNION SELECT file_id, path FROM core_files)"""
_MOD = "CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) ELSE '.' END"
_SNAPS = "s2 AS (SELECT DISTINCT snapshot_id AS s FROM snap_files ORDER BY 1 DESC LIMIT 2), ids AS (SELECT max(s) AS new, min(s) AS old FROM s2)"
_FILES2 = f"{_SNAPS}, fo AS (SELECT DISTINCT path, language, line_count FROM snap_files WHERE snapshot_id = (SELECT old FROM ids)), fn AS (SELECT DISTINCT path, language, line_count FROM snap_files WHERE snapshot_id = (SELECT new FROM ids))"


def files_of(spark: SparkSession, d: str, content: bool = True) -> DataFrame:
    return corpus(table(spark, d, "files"), content)


def symbols_of(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    """(path, language, start_line, end_line, kind, symbol, preview, *keys) of the current versions, from completed runs."""
    completed = run_states(table(spark, d, "indexing_status")).where("state = 'completed'").select("run_id")
    cached = table(spark, d, "symbols").where("name IS NOT NULL").join(completed, "run_id", "left_semi")
    current = files_of(spark, d, False).select("file_id", F.col("hash").alias("file_hash"), F.col("path").alias("p"), "language")
    return cached.join(current, ["file_id", "file_hash"]).select(F.col("p").alias("path"), "language", "start_line", "end_line", "kind", F.col("name").alias("symbol"), "preview", *keys).distinct()


def _snapshot_ids(spark: SparkSession, d: str, name: str = "snap_files") -> list[str]:
    return sorted(r[0] for r in table(spark, d, name).select("snapshot_id").distinct().collect())  # one row per snapshot


def edges_of(spark: SparkSession, d: str, snapshot: str | None = None) -> DataFrame:
    """(src, dst, import_type) of a snapshot, the last by default, each edge once."""
    edges = table(spark, d, "dependency_edges")
    snapshot = snapshot or edges.agg(F.max("snapshot_id")).first()[0]
    return edges.where(F.col("snapshot_id") == snapshot).select(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst"), "import_type").distinct()


def nodes_of(spark: SparkSession, d: str, snapshot: str | None = None) -> DataFrame:
    """(id, path, language, line_count) of a snapshot and of the shared core."""
    files = table(spark, d, "snap_files")
    snapshot = snapshot or files.agg(F.max("snapshot_id")).first()[0]
    core = table(spark, d, "core_files").select(F.col("file_id").alias("id"), "path", "language", "line_count")
    return files.where(F.col("snapshot_id") == snapshot).select("id", "path", "language", "line_count").union(core).distinct()


def snapshot_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(path, language, line_count) of the last snapshot but one and of the last."""
    old, new = _snapshot_ids(spark, d)[-2:]
    files = table(spark, d, "snap_files")
    return tuple(files.where(F.col("snapshot_id") == s).select("path", "language", "line_count").distinct() for s in (old, new))


# ---- scans and file metrics -------------------------------------------------------------------------------------------


@add("q_scan_corpus", f"WITH {_CUR} SELECT path, language, octet_length(encode(content)) AS bytes FROM cur WHERE language IS NOT NULL AND octet_length(encode(content)) <= 10485760")
def q_scan_corpus(spark, d):
    return files_of(spark, d).where("language IS NOT NULL").select("path", "language", F.octet_length("content").alias("bytes")).where("bytes <= 10485760")


@add("q_language_detect", f"WITH {_CUR} SELECT language, count(*) AS files FROM cur GROUP BY language")
def q_language_detect(spark, d):
    return files_of(spark, d, False).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@add("q_file_metrics", f"WITH {_LIN}, c AS (SELECT file_id, count(*) AS lines FROM lin GROUP BY file_id) SELECT path, sha256(content) AS digest, coalesce(c.lines, 0) AS lines FROM cur LEFT JOIN c USING (file_id)")
def q_file_metrics(spark, d):
    return files_of(spark, d).select("path", F.sha2("content", 256).alias("digest"), F.size(line_array(F.col("content"))).cast("long").alias("lines"))


@add("q_list_language_files", f"WITH {_CUR} SELECT path, language, 1 AS start_line, 1 AS end_line FROM cur WHERE language = 'rust' AND regexp_matches(path, '^(?:.*/)?src/.*$') AND NOT regexp_matches(path, '^(?:.*/)?tests/.*$')")
def q_list_language_files(spark, d):
    spec = QuerySpec(language="rust", globs=("**/src/*",), excludes=("**/tests/*",))
    return search.file_filter(files_of(spark, d, False), spec).select("path", "language", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))


@add("q_list_files", f"WITH {_CUR} SELECT path, language, last_indexed FROM cur WHERE starts_with(language, 'java')")
def q_list_files(spark, d):
    return files_of(spark, d, False).where(F.col("language").startswith("java")).select("path", "language", "last_indexed")


@add("q_upsert_files", """WITH fresh AS (SELECT DISTINCT path, language, line_count FROM snap_files WHERE snapshot_id = (SELECT max(snapshot_id) FROM snap_files)),
    old AS (SELECT DISTINCT path, language, line_count FROM snap_files WHERE snapshot_id = (SELECT min(snapshot_id) FROM snap_files))
    SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.path = old.path)""")
def q_upsert_files(spark, d):
    ids = _snapshot_ids(spark, d)
    files = table(spark, d, "snap_files")
    old, new = (files.where(F.col("snapshot_id") == s).select("path", "language", "line_count").distinct() for s in (ids[0], ids[-1]))
    return new.unionByName(old.join(new, "path", "left_anti"))


@add("q_compact", f"""WITH {_CUR}, last AS (SELECT DISTINCT path FROM snap_files WHERE snapshot_id = (SELECT max(snapshot_id) FROM snap_files))
    SELECT DISTINCT s.file_id, s.file_hash FROM symbols s JOIN cur c ON c.file_id = s.file_id WHERE EXISTS (SELECT 1 FROM last WHERE last.path = c.path)""")
def q_compact(spark, d):
    """Cached symbol sets that stay after those of files that the last snapshot doesn't list have gone."""
    last = table(spark, d, "snap_files").where(F.col("snapshot_id") == _snapshot_ids(spark, d)[-1]).select("path").distinct()
    kept = files_of(spark, d, False).join(last, "path", "left_semi").select("file_id")
    return table(spark, d, "symbols").select("file_id", "file_hash").join(kept, "file_id", "left_semi").distinct()


# ---- lines and shapes -------------------------------------------------------------------------------------------------


@add("q_lines", f"WITH {_LIN} SELECT path, line_no, line FROM lin")
def q_lines(spark, d):
    return lines(files_of(spark, d).select("path", "content"))


_ARR = "arr AS (SELECT path, list(line ORDER BY line_no) AS l FROM lin GROUP BY path)"
_SYML = f"{_SYM}, {_LIN.split(_CUR, 1)[1].lstrip(', ')}, {_ARR}"


@add("q_symbol_preview", f"WITH {_SYML} SELECT path, symbol, start_line, array_to_string(l[start_line:start_line + 6], chr(10)) AS preview7 FROM sym JOIN arr USING (path) GROUP BY ALL")
def q_symbol_preview(spark, d):
    """The first seven lines of each symbol, from the present text."""
    texts = files_of(spark, d).where("content <> ''").select("path", line_array(F.col("content")).alias("l"))
    out = symbols_of(spark, d).select("path", "symbol", "start_line").distinct().join(texts, "path")
    return out.select("path", "symbol", "start_line", F.array_join(F.slice("l", F.col("start_line"), 7), "\n").alias("preview7"))


@add("q_expand", f"WITH {_SYML} SELECT path, symbol, kind, start_line, end_line, CASE WHEN start_line < end_line AND l IS NOT NULL THEN array_to_string(l[start_line:end_line], chr(10)) ELSE preview END AS preview FROM sym LEFT JOIN arr USING (path) WHERE kind = 'Class' GROUP BY ALL")
def q_expand(spark, d):
    hits = symbols_of(spark, d).where("kind = 'Class'").select("path", "symbol", "kind", "start_line", "end_line", "preview")
    return search.expanded(hits, files_of(spark, d).where("content <> ''")).distinct()


def _word_sql(word: str) -> str:
    return f"contains(line, '{word}') AND regexp_matches(line, '{word_pattern_re2(word)}')"


_HITS = f"{_LIN}, hit AS (SELECT path, language, line_no, line FROM lin WHERE {_word_sql(WORD)})"


@add("q_result_json", f"""WITH {_HITS} SELECT path, to_json({{'path': path, 'language': min(language), 'matches': list({{'start_line': line_no, 'end_line': line_no, 'preview': line}} ORDER BY line_no)}})::VARCHAR AS json FROM hit GROUP BY path""")
def q_result_json(spark, d):
    hits = search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD))
    return search.grouped(hits).select("path", F.to_json(F.struct("path", "language", "matches")).alias("json"))


@add("q_context_lines", f"WITH {_HITS}, {_ARR} SELECT path, line_no AS start_line, array_to_string(l[greatest(line_no - 2, 1):line_no - 1], chr(10)) AS before, array_to_string(l[line_no + 1:line_no + 2], chr(10)) AS after FROM hit JOIN arr USING (path)")
def q_context_lines(spark, d):
    files = files_of(spark, d)
    out = search.with_context(search.text_hits(files, QuerySpec(pattern=WORD)), files, 2, 2)
    return out.select("path", "start_line", F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after"))


@add("q_context_by_offset", f"WITH {_CUR}, m AS (SELECT path, content, instr(content, '{LITERAL}') AS pos FROM cur WHERE contains(content, '{LITERAL}')) SELECT path, octet_length(encode(content[1:(pos - 1)])) AS byte_offset, 1 + len(content[1:(pos - 1)]) - len(replace(content[1:(pos - 1)], chr(10), '')) AS line_no FROM m")
def q_context_by_offset(spark, d):
    """Byte offset of the first occurrence of a literal in each file and the line it is on."""
    head = F.col("content").substr(F.lit(1), F.instr("content", LITERAL) - 1)
    found = files_of(spark, d).where(F.contains("content", F.lit(LITERAL)))
    return found.select("path", F.octet_length(head).cast("long").alias("byte_offset"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_no"))


@add("q_content_slice", f"WITH {_CUR} SELECT path, hex(encode(content)[17:80]) AS slice FROM cur WHERE octet_length(encode(content)) >= 80")
def q_content_slice(spark, d):
    return files_of(spark, d).where(F.octet_length("content") >= 80).select("path", F.hex(F.substring(F.col("content").cast("binary"), 17, 64)).alias("slice"))


@add("q_truncate_preview", f"WITH {_LIN}, t AS (SELECT path, line_no, line, line[:100] AS head, regexp_extract(line[:100], '^(.*)\\s', 1, 's') AS cut FROM lin WHERE octet_length(encode(line)) > 60) SELECT path, line_no, CASE WHEN octet_length(encode(line)) <= 100 THEN line ELSE CASE WHEN cut <> '' THEN cut ELSE head END || '…' END AS preview FROM t")
def q_truncate_preview(spark, d):
    return lines(files_of(spark, d).select("path", "content")).where(F.octet_length("line") > 60).select("path", "line_no", truncated(F.col("line"), 100).alias("preview"))


@add("q_text_word", f"WITH {_HITS} SELECT path, line_no AS start_line, line AS preview FROM hit")
def q_text_word(spark, d):
    return search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD)).select("path", "start_line", "preview")


@add("q_text_contains", f"WITH {_LIN} SELECT path, line_no AS start_line, line AS preview FROM lin WHERE contains(line, '{LITERAL}')")
def q_text_contains(spark, d):
    return search.text_hits(files_of(spark, d), QuerySpec(pattern=LITERAL, use_contains=True)).select("path", "start_line", "preview")


@add("q_text_regex", f"WITH {_LIN} SELECT path, line_no AS start_line, line AS preview FROM lin WHERE regexp_matches(line, '{REGEX}')")
def q_text_regex(spark, d):
    return search.text_hits(files_of(spark, d), QuerySpec(pattern=REGEX, use_regex=True)).select("path", "start_line", "preview")


@add("q_documents_word", f"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents) WHERE {_word_sql('größer')} GROUP BY doc_id")
def q_documents_word(spark, d):
    """The same search over another corpus: words with letters beyond ASCII."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))
    return search.text_hits(docs, QuerySpec(pattern="größer")).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("lines"))


@add("q_text_short_forced", f"WITH {_LIN} SELECT path, line_no AS start_line FROM lin WHERE {_word_sql('if')}")
def q_text_short_forced(spark, d):
    return search.text_hits(files_of(spark, d), QuerySpec(pattern="if", force=True)).select("path", "start_line")


@add("q_text_filtered", f"WITH {_HITS} SELECT path, line_no AS start_line FROM hit WHERE language = 'go' AND regexp_matches(path, '^(?:.*/)?src/.*$') AND contains(path, 'index')")
def q_text_filtered(spark, d):
    return search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD, language="go", globs=("**/src/*",), file="index")).select("path", "start_line")


@add("q_paths_only", f"WITH {_HITS} SELECT path, min(line_no) AS start_line FROM hit GROUP BY path")
def q_paths_only(spark, d):
    return search.paths_only(search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD))).select("path", "start_line")


@add("q_list_locations", f"WITH {_HITS} SELECT path, min(line_no) AS line FROM hit GROUP BY path")
def q_list_locations(spark, d):
    return search.paths_only(search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD, paths_only=True))).select("path", F.col("start_line").alias("line"))


@add("q_page", f"WITH {_HITS} SELECT path, line_no AS start_line, count(*) OVER () AS total FROM hit ORDER BY path, line_no LIMIT 25 OFFSET 50")
def q_page(spark, d):
    """The third page of 25 hits, with the number of all of them: a page is what is asked for."""
    hits = search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD))
    got = search.paged(hits, QuerySpec(pattern=WORD, limit=25, offset=50))
    return got.rows.select("path", "start_line", F.lit(got.total).cast("long").alias("total"))


@add("q_group_by_file", f"WITH {_HITS} SELECT path, min(language) AS language, count(*) AS matches, array_to_string(list(line_no ORDER BY line_no), ',') AS line_numbers FROM hit GROUP BY path")
def q_group_by_file(spark, d):
    groups = search.grouped(search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD)))
    return groups.select("path", "language", F.size("matches").cast("long").alias("matches"), F.array_join(F.col("matches.start_line").cast("array<string>"), ",").alias("line_numbers"))


_DEPS = f"dep AS (SELECT a.path, array_to_string(list(DISTINCT b.path ORDER BY b.path), ',') AS dependencies FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY a.path)"


@add("q_search_with_deps", f"WITH {_HITS}, {_EN}, {_DEPS} SELECT h.path, count(*) AS matches, any_value(dep.dependencies) AS dependencies FROM hit h LEFT JOIN dep ON dep.path = h.path GROUP BY h.path")
def q_search_with_deps(spark, d):
    nodes = nodes_of(spark, d).select("id", "path")
    e = edges_of(spark, d).select("src", "dst").join(nodes.withColumnsRenamed({"id": "src"}), "src").join(nodes.select(F.col("id").alias("dst"), F.col("path").alias("to")), "dst")
    dep = e.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("to")), ",").alias("dependencies"))
    hits = search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD)).groupBy("path").agg(F.count(F.lit(1)).alias("matches"))
    return hits.join(dep, "path", "left")


@add("q_count_occurrences", f"WITH {_HITS} SELECT count(*) AS total, count(DISTINCT path) AS files FROM hit")
def q_count_occurrences(spark, d):
    return search.text_hits(files_of(spark, d), QuerySpec(pattern=WORD)).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("path").alias("files"))


_NAME = "lookup_batch"


@add("q_find_references", f"WITH {_SYM}, {_LIN.split(_CUR, 1)[1].lstrip(', ')} SELECT 'reference' AS role, path, line_no AS start_line FROM lin WHERE {_word_sql(_NAME)} UNION ALL SELECT * FROM (SELECT 'definition', path, start_line FROM sym WHERE symbol = '{_NAME}' ORDER BY path, start_line LIMIT 1)")
def q_find_references(spark, d):
    """The first definition of a name and all lines that use it."""
    files = files_of(spark, d)
    uses = search.text_hits(files, QuerySpec(pattern=_NAME)).select(F.lit("reference").alias("role"), "path", "start_line")
    definition = search.page(search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern=_NAME, symbols=True)), 0, 1)
    return uses.unionByName(definition.select(F.lit("definition").alias("role"), "path", "start_line"))


@add("q_multi_query_merge", f"WITH {_LIN}, u AS (SELECT 0 AS search, path, line_no FROM lin WHERE {_word_sql(WORD)} UNION ALL SELECT 1, path, line_no FROM lin WHERE contains(line, '{LITERAL}')) SELECT path, line_no AS start_line, min(search) AS search FROM u GROUP BY path, line_no")
def q_multi_query_merge(spark, d):
    files = files_of(spark, d)
    parts = [(0, search.text_hits(files, QuerySpec(pattern=WORD))), (1, search.text_hits(files, QuerySpec(pattern=LITERAL, use_contains=True)))]
    return search.merged(parts).select("path", "start_line", "search")


_WORDS = search.question_words(QUESTION)


@add("q_doc_search", "WITH l AS (SELECT doc_id, unnest(range(1, 1 + len(a))) AS k, unnest(a) AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS a FROM documents WHERE kind = 'readme' AND text <> '')), s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS section, (" + " + ".join(f"contains(lower(line), '{w}')::INT" for w in _WORDS) + ") * CASE WHEN starts_with(line, '#') THEN 10 ELSE 1 END AS p FROM l), g AS (SELECT doc_id, section, max(CASE WHEN starts_with(line, '#') THEN line END) AS title, sum(p) AS score, count(*) AS n FROM s GROUP BY doc_id, section), h AS (SELECT *, max((n > 150)::INT) OVER (PARTITION BY doc_id ORDER BY section) AS far FROM g) SELECT doc_id, section, title, score FROM h WHERE far = 0 AND score >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY section) <= 3")
def q_doc_search(spark, d):
    readmes = table(spark, d, "documents").where("kind = 'readme'").select("doc_id", F.col("text").alias("content"))
    return search.section_scores(readmes, QUESTION, "doc_id")


# ---- trigram index ----------------------------------------------------------------------------------------------------

_GRAMS = trigram.grams_of(WORD)
_POST = f"{_LIN}, g AS (SELECT DISTINCT path, line_no, unnest(list_transform(range(1, octet_length(encode(line)) - 1), lambda i: hex(encode(line)[i:i + 2]))) AS gram FROM lin WHERE octet_length(encode(line)) >= 3)"


@add("q_trigrams", f"WITH {_POST} SELECT gram, count(*) AS lines FROM g GROUP BY gram")
def q_trigrams(spark, d):
    return trigram.postings(lines(files_of(spark, d).select("path", "content"))).groupBy("gram").agg(F.count(F.lit(1)).alias("lines"))


@add("q_posting_lists", f"WITH {_POST} SELECT gram, count(*) AS postings, count(DISTINCT path) AS files, min(path) AS first_path FROM g WHERE gram IN ({', '.join(repr(x) for x in _GRAMS)}) GROUP BY gram")
def q_posting_lists(spark, d):
    rows = trigram.lookup(trigram.postings(lines(files_of(spark, d).select("path", "content"))), _GRAMS)
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("path").alias("files"), F.min("path").alias("first_path"))


@add("q_trigram_lookup", f"WITH {_POST} SELECT path, line_no FROM g WHERE gram = '{_GRAMS[0]}'")
def q_trigram_lookup(spark, d):
    """A gram looked up in an index on disk: only the gram's folder is read."""
    path = shared_dir(spark, "trigrams")
    trigram.write_index(lines(files_of(spark, d).select("path", "content")), path)
    return trigram.lookup(spark.read.parquet(path), [_GRAMS[0]], 64).select("path", "line_no")


@add("q_trigram_intersect", f"WITH {_POST} SELECT path, line_no FROM g WHERE gram IN ({', '.join(repr(x) for x in _GRAMS)}) GROUP BY path, line_no HAVING count(*) = {len(_GRAMS)}")
def q_trigram_intersect(spark, d):
    return trigram.intersect(trigram.postings(lines(files_of(spark, d).select("path", "content"))), _GRAMS)


@add("q_trigram_verified", f"WITH {_LIN} SELECT path, line_no FROM lin WHERE contains(line, '{WORD}')")
def q_trigram_verified(spark, d):
    """Candidates of the index, checked against their lines: the same as a scan."""
    rows = lines(files_of(spark, d).select("path", "content"))
    return rows.join(trigram.intersect(trigram.postings(rows), _GRAMS), ["path", "line_no"], "left_semi").where(F.contains("line", F.lit(WORD))).select("path", "line_no")


@add("q_posting_delta", f"WITH {_POST} SELECT gram, path, line_no, line_no - coalesce(lag(line_no) OVER (PARTITION BY gram, path ORDER BY line_no), 0) AS delta FROM g WHERE gram = '{_GRAMS[0]}'")
def q_posting_delta(spark, d):
    rows = trigram.lookup(trigram.postings(lines(files_of(spark, d).select("path", "content"))), [_GRAMS[0]])
    return rows.withColumn("delta", F.col("line_no") - F.coalesce(F.lag("line_no").over(Window.partitionBy("gram", "path").orderBy("line_no")), F.lit(0)))


@add("q_regex_literals", "SELECT * FROM (VALUES ('foo|ab', ''), ('[abc]x', ''), ('(foo)?ba', ''), ('(?i)test', ''), ('a.*b', ''), ('class.*Controller', 'class,Controller'), ('fn [a-z]+_trigram\\(', 'fn ,_trigram(')) t(pattern, literals)")
def q_regex_literals(spark, d):
    patterns = ["foo|ab", "[abc]x", "(foo)?ba", "(?i)test", "a.*b", "class.*Controller", REGEX]
    return spark.createDataFrame([(p, ",".join(required_literals(p))) for p in patterns], "pattern string, literals string")


@add("q_regex_candidates", f"WITH {_CUR} SELECT path FROM cur WHERE contains(content, 'fn ') AND contains(content, '_trigram(')")
def q_regex_candidates(spark, d):
    out = files_of(spark, d)
    for literal in required_literals(REGEX):
        out = out.where(F.contains("content", F.lit(literal)))
    return out.select("path")


# ---- symbols ----------------------------------------------------------------------------------------------------------


@add("q_symbols", f"WITH {_SYM} SELECT path, start_line, symbol, min(kind) AS kind FROM sym GROUP BY path, start_line, symbol HAVING min(kind) = 'Method' OR min(kind) = 'Function'")
def q_symbols(spark, d):
    """All functions, and methods as well, by keyword."""
    return search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern="function", symbols=True, kind="Function")).select("path", "start_line", "symbol", "kind")


@add("q_symbols_keyword", f"WITH {_SYM} SELECT path, start_line, symbol FROM sym GROUP BY path, start_line, symbol HAVING min(kind) = 'Class'")
def q_symbols_keyword(spark, d):
    return search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern="class", symbols=True)).select("path", "start_line", "symbol")


@add("q_symbols_exact", f"WITH {_SYM} SELECT DISTINCT path, start_line, symbol FROM sym WHERE symbol = '{_NAME}'")
def q_symbols_exact(spark, d):
    return search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern=_NAME, symbols=True, exact=True)).select("path", "start_line", "symbol")


@add("q_symbols_contains", f"WITH {_SYM} SELECT DISTINCT path, start_line, symbol FROM sym WHERE contains(symbol, '{WORD}')")
def q_symbols_contains(spark, d):
    return search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern=WORD, symbols=True, use_contains=True)).select("path", "start_line", "symbol")


@add("q_symbols_in_code", f"WITH {_SYM}, {_LIN.split(_CUR, 1)[1].lstrip(', ')}, c AS (SELECT DISTINCT path FROM lin WHERE contains(line, '{_NAME}') AND contains({search.code_of_sql('line', 'language')}, '{_NAME}')) SELECT DISTINCT path, start_line, symbol FROM sym WHERE symbol = '{_NAME}' AND path IN (SELECT path FROM c)")
def q_symbols_in_code(spark, d):
    """A name looked up in the files that have it outside of comments and strings."""
    return search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern=_NAME, symbols=True, exact=True), files_of(spark, d)).select("path", "start_line", "symbol")


@add("q_symbols_regex", f"WITH {_SYM}, {_LIN.split(_CUR, 1)[1].lstrip(', ')}, m AS (SELECT path, line_no FROM lin WHERE regexp_matches(line, '{REGEX}')) SELECT DISTINCT s.path, s.start_line, s.symbol FROM sym s JOIN m ON m.path = s.path AND m.line_no BETWEEN s.start_line AND s.end_line")
def q_symbols_regex(spark, d):
    return search.symbol_hits(symbols_of(spark, d), QuerySpec(pattern=REGEX, symbols=True, use_regex=True), files_of(spark, d)).select("path", "start_line", "symbol")


@add("q_symbols_extracted")
def q_symbols_extracted(spark, d):
    """Definitions read from the present texts."""
    return symbols.extract(files_of(spark, d), ["path"]).select("path", "name", "kind", "start_line", "end_line")


@add("q_ast_functions", f"WITH {_SYM} SELECT DISTINCT path, symbol AS name, start_line FROM sym WHERE language = 'rust' AND kind IN ('Function', 'Method') AND regexp_matches(symbol, '^scan_')")
def q_ast_functions(spark, d):
    rows = symbols_of(spark, d).where("language = 'rust'").withColumnRenamed("symbol", "name")
    return symbols.structure_filter(rows, '(function_item name: (identifier) @name) (#match? @name "^scan_")').select("path", "name", "start_line").distinct()


@add("q_ast_all_files")
def q_ast_all_files(spark, d):
    """A structural pattern over the texts of all files of a language, those with a word only."""
    return symbols.structure_search(files_of(spark, d), '(function_item name: (identifier) @name) (#match? @name "^scan_")', "rust", ["path"], "scan_").select("path", "name", "start_line", "end_line")


@add("q_symbol_cache_cleanup", f"WITH {_CUR} SELECT DISTINCT file_id, file_hash FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.file_id = s.file_id AND c.hash = s.file_hash)")
def q_symbol_cache_cleanup(spark, d):
    """Cached symbol sets that no present file needs."""
    now = files_of(spark, d, False).select("file_id", F.col("hash").alias("file_hash"))
    return table(spark, d, "symbols").select("file_id", "file_hash").distinct().join(now, ["file_id", "file_hash"], "left_anti")


@add("q_symbol_stats", "SELECT count(DISTINCT (file_id, file_hash)) FILTER (WHERE file_id IS NOT NULL AND file_hash IS NOT NULL) AS cached_files, count(*) AS rows, sum(len(preview)) AS preview_chars FROM symbols")
def q_symbol_stats(spark, d):
    return table(spark, d, "symbols").agg(F.count_distinct("file_id", "file_hash").alias("cached_files"), F.count(F.lit(1)).alias("rows"), F.sum(F.length("preview")).alias("preview_chars"))


@add("q_dedup_first", f"WITH {_SYM} SELECT path, start_line, symbol, min(kind) AS kind FROM sym GROUP BY path, start_line, symbol")
def q_dedup_first(spark, d):
    w = Window.partitionBy("path", "start_line", "symbol").orderBy("kind")
    return symbols_of(spark, d).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "start_line", "symbol", "kind")


@add("q_anchor_symbols", f"WITH {_SYM}, r AS (SELECT {_MOD.format('path')} AS module, symbol, count(DISTINCT path) AS files FROM sym GROUP BY ALL) SELECT module, symbol, files FROM r QUALIFY row_number() OVER (PARTITION BY module ORDER BY files DESC, symbol) <= 5")
def q_anchor_symbols(spark, d):
    rows = symbols_of(spark, d).groupBy(first_segment(F.col("path")).alias("module"), "symbol").agg(F.count_distinct("path").alias("files"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("files"), "symbol"))).where("_n <= 5").drop("_n")


@add("q_key_symbols", f"WITH {_SYM}, big AS (SELECT path FROM cur QUALIFY row_number() OVER (PARTITION BY {_MOD.format('path')} ORDER BY coalesce(line_count, 0) DESC, path) <= 20) SELECT {_MOD.format('path')} AS module, kind, count(*) AS symbols, max(end_line - start_line + 1) AS largest FROM sym WHERE path IN (SELECT path FROM big) AND kind NOT IN ('Import', 'Export', 'Variable', 'Unknown') GROUP BY ALL")
def q_key_symbols(spark, d):
    """Symbols by kind in the twenty largest files of each module."""
    module = first_segment(F.col("path"))
    w = Window.partitionBy(module).orderBy(F.desc(F.coalesce("line_count", F.lit(0))), "path")
    big = files_of(spark, d, False).withColumn("_n", F.row_number().over(w)).where("_n <= 20").select("path")
    kept = symbols_of(spark, d).join(big, "path", "left_semi").where(~F.col("kind").isin("Import", "Export", "Variable", "Unknown"))
    return kept.groupBy(module.alias("module"), "kind").agg(F.count(F.lit(1)).alias("symbols"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("largest"))


@add("q_doc_comments")
def q_doc_comments(spark, d):
    """The whole documentation of each definition; a walk over lines that SQL has no words for, so tests check constructed files."""
    keys = ("file_id", "file_hash")
    defs = symbols_of(spark, d, *keys).where("start_line IS NOT NULL").groupBy(*keys).agg(F.collect_set(F.struct("start_line", "symbol")).alias("defs"))
    files = files_of(spark, d).select("file_id", F.col("hash").alias("file_hash"), "path", "language", "content")
    return symbols.doc_comments(files.join(defs, list(keys))).distinct()


# ---- roll-ups ---------------------------------------------------------------------------------------------------------


@add("q_stats_files_by_language", f"WITH {_CUR} SELECT coalesce(branch, '') AS branch, language, count(DISTINCT path) AS files FROM cur GROUP BY ALL")
def q_stats_files_by_language(spark, d):
    return files_of(spark, d, False).groupBy(F.coalesce("branch", F.lit("")).alias("branch"), "language").agg(F.count_distinct("path").alias("files"))


@add("q_stats_lines_by_language", f"WITH {_CUR} SELECT language, sum(line_count) AS lines FROM cur GROUP BY language")
def q_stats_lines_by_language(spark, d):
    return files_of(spark, d, False).groupBy("language").agg(F.sum("line_count").alias("lines"))


@add("q_stats_total_files", f"WITH {_CUR} SELECT branch, count(DISTINCT path) AS files FROM cur GROUP BY branch")
def q_stats_total_files(spark, d):
    return files_of(spark, d, False).groupBy("branch").agg(F.count_distinct("path").alias("files"))


@add("q_language_distribution", f"WITH {_CUR}, c AS (SELECT language, count(*) AS files FROM cur GROUP BY language) SELECT language, files, round(100.0 * files / sum(files) OVER (), 6) AS percent, files > 0.6 * sum(files) OVER () AS dominant FROM c")
def q_language_distribution(spark, d):
    counts = files_of(spark, d, False).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    total = F.sum("files").over(Window.partitionBy())  # one row per language
    return counts.select("language", "files", F.round(100.0 * F.col("files") / total, 6).alias("percent"), (F.col("files") > 0.6 * total).alias("dominant"))


@add("q_project_stats", f"WITH {_CUR}, c AS (SELECT language, count(*) AS files, sum(line_count) AS lines FROM cur GROUP BY language) SELECT * FROM c ORDER BY files DESC, language LIMIT 10")
def q_project_stats(spark, d):
    return files_of(spark, d, False).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines")).orderBy(F.desc("files"), "language").limit(10)


@add("q_top_dirs", f"WITH {_CUR}, c AS (SELECT split_part(path, '/', 1) || '/' AS dir, count(*) AS files FROM cur WHERE NOT starts_with(path, '.') GROUP BY 1) SELECT * FROM c ORDER BY files DESC, dir LIMIT 10")
def q_top_dirs(spark, d):
    return files_of(spark, d, False).where(~F.col("path").startswith(".")).groupBy(F.concat(F.substring_index("path", "/", 1), F.lit("/")).alias("dir")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "dir").limit(10)


@add("q_common_paths", f"WITH {_CUR}, p AS (SELECT unnest(list_filter([CASE WHEN len(s) > 2 THEN array_to_string(s[1:3], '/') END, CASE WHEN len(s) > 3 THEN array_to_string(s[1:4], '/') END], lambda x: x IS NOT NULL)) AS p FROM (SELECT string_split(path, '/') AS s FROM cur)), c AS (SELECT p || '/' AS common, count(*) AS files FROM p WHERE NOT regexp_matches(p, '/\\.|/node_modules|/vendor|/target') GROUP BY 1 HAVING count(*) >= 3) SELECT * FROM c ORDER BY files DESC, common LIMIT 10")
def q_common_paths(spark, d):
    parts = F.split("path", "/")
    partial = F.explode(F.filter(F.array(*[F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n + 1), "/")) for n in (2, 3)]), lambda x: x.isNotNull()))
    rows = files_of(spark, d, False).select(partial.alias("p")).where(~F.col("p").rlike(r"/\.|/node_modules|/vendor|/target"))
    return rows.groupBy(F.concat("p", F.lit("/")).alias("common")).agg(F.count(F.lit(1)).alias("files")).where("files >= 3").orderBy(F.desc("files"), "common").limit(10)


_MANIFESTS = ("package.json", "cargo.toml", "go.mod", "composer.json", "pom.xml", "build.gradle", "gemfile")


@add("q_monorepo", f"WITH {_CUR}, p AS (SELECT count(*) AS c FROM cur WHERE regexp_matches(lower(path), '({'|'.join(m.replace('.', '[.]') for m in _MANIFESTS)})$') AND len(string_split(path, '/')) > 2) SELECT c >= 2 AS monorepo, CASE WHEN c >= 2 THEN c END AS projects FROM p")
def q_monorepo(spark, d):
    manifest = F.lower("path").rlike("(" + "|".join(m.replace(".", "[.]") for m in _MANIFESTS) + ")$")
    n = files_of(spark, d, False).where(manifest & (F.size(F.split("path", "/")) > 2)).agg(F.count(F.lit(1)).alias("c"))
    return n.select((F.col("c") >= 2).alias("monorepo"), F.when(F.col("c") >= 2, F.col("c")).alias("projects"))


@add("q_treemap", f"WITH {_CUR}, p AS (SELECT unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) AS folder, line_count FROM (SELECT string_split(path, '/') AS s, line_count FROM cur)) SELECT folder, count(*) AS files, coalesce(sum(line_count), 0) AS lines FROM p GROUP BY folder")
def q_treemap(spark, d):
    """Files and lines of every folder, with all below it."""
    return files_of(spark, d, False).select(F.explode(prefixes(F.col("path"))).alias("folder"), "line_count").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))


@add("q_treemap_collapsed", f"""WITH {_CUR}, p AS (SELECT path, line_count, list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/')) AS folders FROM (SELECT *, string_split(path, '/') AS s FROM cur)),
    f AS (SELECT unnest(folders) AS folder, line_count, path FROM p), sums AS (SELECT folder, count(*) AS files, coalesce(sum(line_count), 0) AS lines FROM f GROUP BY folder),
    own AS (SELECT folders[-1] AS folder, count(*) AS n FROM p WHERE len(folders) > 0 GROUP BY 1), kids AS (SELECT regexp_replace(folder, '/[^/]*$', '') AS folder, count(*) AS n FROM sums WHERE contains(folder, '/') GROUP BY 1)
    SELECT sums.* FROM sums LEFT JOIN own USING (folder) LEFT JOIN kids USING (folder) WHERE NOT (own.n IS NULL AND kids.n = 1)""")
def q_treemap_collapsed(spark, d):
    """The folders of a treemap in which one that holds a single folder and nothing else is shown as that folder."""
    sums = q_treemap(spark, d)
    own = files_of(spark, d, False).where(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct().withColumn("_own", F.lit(True))
    kids = sums.where(F.contains("folder", F.lit("/"))).groupBy(F.regexp_replace("folder", r"/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("_kids"))
    return sums.join(own, "folder", "left").join(kids, "folder", "left").where(F.col("_own").isNotNull() | F.coalesce(F.col("_kids") != 1, F.lit(True))).select("folder", "files", "lines")


# Folders that a tree doesn't show.
_HIDDEN = r"(^|/)(target|node_modules|dist|build|__pycache__|vendor|coverage|\.[^/]+)/"


@add("q_tree", f"WITH {_CUR}, p AS (SELECT DISTINCT unnest(list_transform(range(1, least(len(s), 4)), lambda n: array_to_string(s[1:n], '/'))) AS folder FROM (SELECT string_split(path, '/') AS s FROM cur WHERE NOT regexp_matches(path, '{_HIDDEN}'))) SELECT folder, len(string_split(folder, '/')) AS depth FROM p")
def q_tree(spark, d):
    shown = files_of(spark, d, False).where(~F.col("path").rlike(_HIDDEN))
    return shown.select(F.explode(F.slice(prefixes(F.col("path")), 1, 3)).alias("folder")).distinct().select("folder", F.size(F.split("folder", "/")).cast("long").alias("depth"))


@add("q_module_metrics", f"SELECT snapshot_id, {_MOD.format('path')} AS module, count(*) AS files, coalesce(sum(line_count), 0) AS lines FROM (SELECT DISTINCT snapshot_id, id, path, language, line_count FROM snap_files) GROUP BY ALL")
def q_module_metrics(spark, d):
    files = table(spark, d, "snap_files").select("snapshot_id", "id", "path", "language", "line_count").distinct()
    return snapshots.module_metrics(files, ["snapshot_id"], first_segment(F.col("path")))


@add("q_sub_modules", f"WITH {_N} SELECT array_to_string(string_split(path, '/')[1:2], '/') AS module, count(*) AS files FROM n WHERE len(string_split(path, '/')) > 2 GROUP BY 1 HAVING count(*) >= 3")
def q_sub_modules(spark, d):
    parts = F.split("path", "/")
    return nodes_of(spark, d).where(F.size(parts) > 2).groupBy(F.array_join(F.slice(parts, 1, 2), "/").alias("module")).agg(F.count(F.lit(1)).alias("files")).where("files >= 3")


@add("q_module_defs", f"WITH {_N} SELECT {_MOD.format('path')} AS module, count(*) AS files, sum(line_count) AS lines, array_to_string(list(DISTINCT language ORDER BY language) FILTER (WHERE language IS NOT NULL), ',') AS languages FROM n GROUP BY 1")
def q_module_defs(spark, d):
    return nodes_of(spark, d).groupBy(first_segment(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def _module_pairs(spark, d):
    """(src_module, dst_module, src, dst) of the edges between files of the last snapshot."""
    nodes = nodes_of(spark, d).select("id", first_segment(F.col("path")).alias("m"))
    e = edges_of(spark, d).select("src", "dst")
    return e.join(nodes.select(F.col("id").alias("src"), F.col("m").alias("src_module")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("m").alias("dst_module")), "dst")


_PAIRS = f"{_EN}, pr AS (SELECT {_MOD.format('a.path')} AS src_module, {_MOD.format('b.path')} AS dst_module, e.src, e.dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst)"


@add("q_module_edges", f"WITH {_PAIRS} SELECT src_module, dst_module, count(*) AS weight FROM pr WHERE src_module <> dst_module GROUP BY ALL")
def q_module_edges(spark, d):
    return _module_pairs(spark, d).where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("weight"))


@add("q_module_coupling", f"""WITH {_PAIRS}, s AS (SELECT {_MOD.format('path')} AS module, count(*) AS files, sum(line_count) AS lines FROM n GROUP BY 1), o AS (SELECT src_module AS module, count(DISTINCT dst) AS outgoing FROM pr WHERE src_module <> dst_module GROUP BY 1), i AS (SELECT dst_module AS module, count(DISTINCT src) AS incoming FROM pr WHERE src_module <> dst_module GROUP BY 1)
    SELECT module, files, lines // files AS average_lines, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM s LEFT JOIN o USING (module) LEFT JOIN i USING (module)""")
def q_module_coupling(spark, d):
    cross = _module_pairs(spark, d).where("src_module <> dst_module")
    size = nodes_of(spark, d).groupBy(first_segment(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"))
    out = cross.groupBy(F.col("src_module").alias("module")).agg(F.count_distinct("dst").alias("outgoing"))
    into = cross.groupBy(F.col("dst_module").alias("module")).agg(F.count_distinct("src").alias("incoming"))
    return size.join(out, "module", "left").join(into, "module", "left").select("module", "files", F.expr("lines div files").alias("average_lines"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


@add("q_module_map", f"WITH {_EN}, h AS (SELECT dst, count(*) AS imports FROM e WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 5 ORDER BY imports DESC, dst LIMIT 10) SELECT {_MOD.format('path')} AS module, count(*) AS hotspots, sum(imports) AS imports FROM h JOIN n ON n.id = h.dst GROUP BY 1")
def q_module_map(spark, d):
    """Modules that own the ten hottest files."""
    hot = graph.hotspots(edges_of(spark, d), 5).orderBy(F.desc("imports"), "dst").limit(10)
    return hot.join(nodes_of(spark, d).select(F.col("id").alias("dst"), "path"), "dst").groupBy(first_segment(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("hotspots"), F.sum("imports").alias("imports"))


@add("q_fingerprint", f"""WITH {_CUR}, rows AS (SELECT snapshot_id, path, coalesce(language, '') || ':' || coalesce(line_count::VARCHAR, '') AS state FROM (SELECT DISTINCT snapshot_id, id, path, language, line_count FROM snap_files)
        UNION ALL SELECT 'index', path, hash FROM cur),
    leaves AS (SELECT snapshot_id, sha256(coalesce(path, '') || ':' || coalesce(state, '') || chr(10)) AS leaf FROM rows),
    buckets AS (SELECT snapshot_id, leaf[:3] AS bucket, count(*) AS n, sha256(string_agg(leaf, '' ORDER BY leaf)) AS digest FROM leaves GROUP BY ALL)
    SELECT snapshot_id, sum(n)::BIGINT AS files, sha256(string_agg(digest, '' ORDER BY bucket)) AS fingerprint FROM buckets GROUP BY snapshot_id""")
def q_fingerprint(spark, d):
    """Files and fingerprint of the index (snapshot_id 'index', over path and content hash) and of each snapshot.

    Snapshots keep no content hash, so theirs is over path, language and line count.
    """
    index = snapshots.fingerprints(files_of(spark, d, False).withColumn("snapshot_id", F.lit("index")), ["snapshot_id"], F.col("path"), F.col("hash"))
    files = table(spark, d, "snap_files").select("snapshot_id", "id", "path", "language", "line_count").distinct()
    state = F.concat(F.coalesce("language", F.lit("")), F.lit(":"), F.coalesce(F.col("line_count").cast("string"), F.lit("")))
    return snapshots.fingerprints(files, ["snapshot_id"], F.col("path"), state).unionByName(index)


@add("q_evaluation_score", "SELECT * FROM (VALUES (0, 0, 0.8::DOUBLE, true), (0, 2, 0.2, false), (5, 1, 1.0, true), (1, 1, 0.7, true), (150, 1, 0.5, true), (900, 1, 0.2, false)) t(total, queries, score, good)")
def q_evaluation_score(spark, d):
    cases = [(0, 0), (0, 2), (5, 1), (1, 1), (150, 1), (900, 1)]
    rows = [(t, q, *evaluation_score(t, q, 100, 2)) for t, q in cases]
    return spark.createDataFrame([(t, q, round(s, 6), g) for t, q, s, g in rows], "total int, queries int, score double, good boolean")


# ---- graph ------------------------------------------------------------------------------------------------------------


@add("q_direct_deps", f"WITH {_EN} SELECT a.path AS path, b.path AS target, e.import_type FROM e JOIN n a ON a.id = e.src LEFT JOIN n b ON b.id = e.dst")
def q_direct_deps(spark, d):
    nodes = nodes_of(spark, d)
    return edges_of(spark, d).join(nodes.select(F.col("id").alias("src"), "path"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("path").alias("target")), "dst", "left").select("path", "target", "import_type")


@add("q_deps_info", f"WITH {_EN} SELECT e.src, coalesce(b.path, e.dst::VARCHAR, 'unresolved') AS target, count(*) AS rows FROM e LEFT JOIN n b ON b.id = e.dst GROUP BY ALL")
def q_deps_info(spark, d):
    nodes = nodes_of(spark, d).select(F.col("id").alias("dst"), "path")
    return edges_of(spark, d).join(nodes, "dst", "left").groupBy("src", F.coalesce("path", F.col("dst").cast("string"), F.lit("unresolved")).alias("target")).agg(F.count(F.lit(1)).alias("rows"))


@add("q_dependents", f"WITH {_E} SELECT DISTINCT dst, src FROM e WHERE dst IS NOT NULL")
def q_dependents(spark, d):
    return graph.dependents(edges_of(spark, d))


@add("q_transitive_deps", f"""WITH RECURSIVE {_E}, s AS (SELECT DISTINCT dst AS id FROM e WHERE dst % 100 = 0 UNION SELECT src FROM e WHERE src % 100 = 0),
    r AS (SELECT id AS seed, id, 0 AS depth FROM s UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3 AND e.dst IS NOT NULL)
    SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id""")
def q_transitive_deps(spark, d):
    """What the files asked for, those whose id is divisible by 100, depend on within three steps."""
    e = edges_of(spark, d)
    asked = e.select(F.col("dst").alias("id")).union(e.select("src")).where("id % 100 = 0").distinct()
    return graph.reach(e, asked.withColumn("seed", F.col("id")), 3, ("seed",))


@add("q_circular", f"WITH RECURSIVE {_E}, {_cycles_sql('e')} SELECT id, component FROM scc")
def q_circular(spark, d):
    """Files on import cycles, parent declarations apart."""
    e = edges_of(spark, d).where("import_type <> 'mod_decl' OR import_type IS NULL")
    return graph.strong_components(e)


@add("q_hotspots", f"WITH {_E} SELECT dst, count(*) AS imports FROM e WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 2")
def q_hotspots(spark, d):
    return graph.hotspots(edges_of(spark, d)).select("dst", "imports")


@add("q_hotspots_distinct", f"WITH {_E} SELECT dst, count(DISTINCT src) AS importers FROM e WHERE dst IS NOT NULL GROUP BY dst ORDER BY importers DESC, dst LIMIT 8")
def q_hotspots_distinct(spark, d):
    return graph.hotspots(edges_of(spark, d), 1).orderBy(F.desc("importers"), "dst").limit(8).select("dst", "importers")


@add("q_deps_by_type", "SELECT snapshot_id, import_type, count(*) AS edges FROM (SELECT DISTINCT snapshot_id, source_file_id, target_file_id, import_type FROM dependency_edges) GROUP BY ALL")
def q_deps_by_type(spark, d):
    return table(spark, d, "dependency_edges").select("snapshot_id", "source_file_id", "target_file_id", "import_type").distinct().groupBy("snapshot_id", "import_type").agg(F.count(F.lit(1)).alias("edges"))


@add("q_resolution_stats", f"WITH {_EN} SELECT language, count(*) AS imports, count(dst) AS resolved, round(count(dst) / count(*), 6) AS rate FROM e JOIN n ON n.id = e.src GROUP BY language")
def q_resolution_stats(spark, d):
    nodes = nodes_of(spark, d).select(F.col("id").alias("src"), "language")
    return edges_of(spark, d).join(nodes, "src").groupBy("language").agg(F.count(F.lit(1)).alias("imports"), F.count("dst").alias("resolved")).withColumn("rate", F.round(F.col("resolved") / F.col("imports"), 6))


_ENTRY = "(path IN ('src/lib.rs', 'src/main.rs', 'build.rs', 'lib.rs', 'main.rs') OR regexp_matches(path, '^(tests|benches|examples)/') OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '(_test|_spec)\\.rs$'))"
_BARREL = "alive AS (SELECT dst AS id FROM e WHERE dst IS NOT NULL UNION SELECT x.dst FROM alive JOIN e x ON x.src = alive.id AND x.import_type = 'mod_decl' WHERE x.dst IS NOT NULL)"


@add("q_unused_files", f"WITH RECURSIVE {_EN}, {_BARREL} SELECT id, path FROM n WHERE id NOT IN (SELECT id FROM alive) AND NOT {_ENTRY}")
def q_unused_files(spark, d):
    e = edges_of(spark, d)
    return graph.unused(nodes_of(spark, d), e, e.where("import_type = 'mod_decl'"))


@add("q_barrel_exports", f"WITH RECURSIVE {_E}, roots AS (SELECT DISTINCT src AS id FROM e WHERE import_type = 'mod_decl' AND src NOT IN (SELECT dst FROM e WHERE import_type = 'mod_decl' AND dst IS NOT NULL)), r AS (SELECT id AS barrel, id FROM roots UNION SELECT r.barrel, e.dst FROM r JOIN e ON e.src = r.id AND e.import_type = 'mod_decl' WHERE e.dst IS NOT NULL) SELECT barrel, count(DISTINCT id) AS reaches FROM r GROUP BY barrel")
def q_barrel_exports(spark, d):
    """Files that each root of declarations reaches through them, itself included."""
    e = edges_of(spark, d).where("import_type = 'mod_decl'").select("src", "dst")
    roots = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return graph.reach(e, roots.withColumn("barrel", F.col("id")), None, ("barrel",)).groupBy("barrel").agg(F.count(F.lit(1)).alias("reaches"))



@add("q_islands", f"WITH RECURSIVE {_EN}, {_islands_sql('e', 'n')} SELECT id, component FROM isl")
def q_islands(spark, d):
    """Connected components."""
    return graph.components(nodes_of(spark, d), edges_of(spark, d))


@add("q_islands_page", f"""WITH RECURSIVE {_EN}, {_islands_sql('e', 'n')}, sizes AS (SELECT component, count(*) AS files FROM isl GROUP BY component)
    SELECT component, files, row_number() OVER (ORDER BY files DESC, component) AS rank FROM sizes ORDER BY files DESC, component LIMIT 200""")
def q_islands_page(spark, d):
    """The first page of 200 islands of any size, the largest first, with their rank."""
    nodes = nodes_of(spark, d)
    return graph.islands_page(graph.components(nodes, edges_of(spark, d)), least=1, most=1 << 62)


@add("q_entry_points", f"WITH {_CUR}, f AS (SELECT path, split_part(path, '/', -1) AS name FROM cur) SELECT path, CASE WHEN regexp_matches(name, '^main\\.(rs|go|py|c|cpp|zig)$|^cli\\.(rs|ts|py|js)$') THEN 'cli' WHEN regexp_matches(name, '^(server|app)\\.(rs|ts|js|py|go)$|^routes\\.(rs|ts|js|py)$') THEN 'http' WHEN name IN ('lib.rs', 'index.ts', 'index.js', 'mod.rs', '__init__.py') AND len(string_split(path, '/')) <= 2 THEN 'library' WHEN regexp_matches(path, '(^|/)(scripts|bin)/') THEN 'script' WHEN regexp_matches(regexp_replace(name, '\\.[^.]*$', ''), '^(conftest|jest\\.config|vitest\\.config|test_main)$') THEN 'test_runner' END AS kind FROM f")
def q_entry_points(spark, d):
    return files_of(spark, d, False).select("path", graph.entry_kind(F.col("path")).alias("kind"))


@add("q_reading_order", f"WITH RECURSIVE {_EN}, t AS (SELECT DISTINCT e.src AS id FROM e WHERE e.src NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL)), r AS (SELECT id, 0 AS depth FROM t UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 5 AND e.dst IS NOT NULL) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def q_reading_order(spark, d):
    """Layers below the files that nothing imports, five at most."""
    e = edges_of(spark, d)
    tops = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return graph.reach(e, tops, 5)


@add("q_analysis_summary", f"""WITH RECURSIVE {_EN}, {_BARREL}, {_cycles_sql('e')}, {_islands_sql('e', 'n')}, sizes AS (SELECT component, count(*) AS n FROM isl GROUP BY component)
    SELECT (SELECT count(*) FROM (SELECT dst FROM e WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 2)) AS hotspots, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM alive) AND NOT {_ENTRY}) AS unused, (SELECT count(*) FROM n) AS files,
        (SELECT count(DISTINCT component) FROM scc) AS cycles, (SELECT count(*) FROM sizes) AS islands, (SELECT count(*) FROM sizes WHERE n >= 2) AS multi_file_islands, (SELECT count(*) FROM sizes WHERE n = 1) AS singleton_islands""")
def q_analysis_summary(spark, d):
    """One row of counts."""
    e, nodes = edges_of(spark, d), nodes_of(spark, d)
    one = F.lit(1)
    hot = graph.hotspots(e).agg(F.count(one).alias("hotspots"))
    idle = graph.unused(nodes, e, e.where("import_type = 'mod_decl'")).agg(F.count(one).alias("unused"))
    cycles = graph.strong_components(e.where("import_type <> 'mod_decl' OR import_type IS NULL")).agg(F.count_distinct("component").alias("cycles"))
    sizes = graph.components(nodes, e).groupBy("component").agg(F.count(one).alias("n"))
    islands = sizes.agg(F.count(one).alias("islands"), F.count_if(F.col("n") >= 2).alias("multi_file_islands"), F.count_if(F.col("n") == 1).alias("singleton_islands"))
    out = hot.join(F.broadcast(idle)).join(F.broadcast(nodes.agg(F.count(one).alias("files"))))  # one row each
    return out.join(F.broadcast(cycles)).join(F.broadcast(islands))


@add("q_path_lookup", f"WITH {_N}, w AS (SELECT DISTINCT split_part(path, '/', -1) AS wanted FROM n) SELECT w.wanted, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(n.path) END AS path FROM w JOIN (SELECT DISTINCT path FROM n) n ON n.path = w.wanted OR ends_with(n.path, '/' || w.wanted) GROUP BY w.wanted")
def q_path_lookup(spark, d):
    """Every file name looked up as a suffix: one match gives its path, several are ambiguous."""
    nodes = nodes_of(spark, d)
    return imports.suffix_lookup(nodes.select(F.element_at(F.split("path", "/"), -1).alias("wanted")), nodes)


@add("q_path_variants", "SELECT * FROM (VALUES ('App\\Http\\Base', 'App/Http/Base.php,App/Http/Base.rs,App/Http/Base.ts,App/Http/Base.js,App/Http/Base.py,Http/Base.php,Http/Base.rs,Http/Base.ts,Http/Base.js,Http/Base.py,Base.php,Base.rs,Base.ts,Base.js,Base.py'), ('a.b/c.php', 'a.b/c.php,c.php'), ('', '')) t(imported, variants)")
def q_path_variants(spark, d):
    rows = spark.createDataFrame([("App\\Http\\Base",), ("a.b/c.php",), ("",)], "imported string")
    return rows.select("imported", F.array_join(path_variants(F.col("imported")), ",").alias("variants"))


# ---- imports ----------------------------------------------------------------------------------------------------------

_IMP = f"{_LIN}, imp AS (SELECT path, language, line_no, {imports.matched_sql('line')} AS imported FROM lin WHERE language IN ({', '.join(repr(x) for x in imports.PATTERNS)}))"


@add("q_imports_extract", f"WITH {_IMP} SELECT path, line_no, imported FROM imp WHERE imported IS NOT NULL")
def q_imports_extract(spark, d):
    return imports.imports(files_of(spark, d)).select("path", "line_no", "imported")


@add("q_imports_classify", f"WITH {_IMP} SELECT language, {imports.CLASSIFY_SQL} AS import_type, count(*) AS rows FROM imp WHERE imported IS NOT NULL GROUP BY ALL")
def q_imports_classify(spark, d):
    files = files_of(spark, d)
    return imports.classified(imports.imports(files), imports.projects(files)).groupBy("language", "import_type").agg(F.count(F.lit(1)).alias("rows"))


_TYPED = f"{_IMP}, typed AS (SELECT path, language, line_no, imported, {imports.CLASSIFY_SQL} AS import_type FROM imp WHERE imported IS NOT NULL)"


@add("q_imports_resolve", f"WITH {_TYPED}, {imports.RESOLVE_SQL.format(rows='typed')} SELECT t.language, t.import_type, count(*) AS rows, count(h.resolved) AS resolved FROM typed t LEFT JOIN hits h ON h.path = t.path AND h.imported = t.imported GROUP BY ALL")
def q_imports_resolve(spark, d):
    """Imports by language and type, and how many lead to a file of the corpus."""
    files = files_of(spark, d)
    rows = imports.resolved(imports.classified(imports.imports(files), imports.projects(files)), files)
    return rows.groupBy("language", "import_type").agg(F.count(F.lit(1)).alias("rows"), F.count("resolved").alias("resolved"))


@add("q_exports_resolve", rf"""WITH {_LIN}, x AS (SELECT path, language, line_no, regexp_extract(line, '^[ \t]*export\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{{[^}}]*\}})\s*from\s*[''"]([^''"]+)[''"]', ['names', 'source']) AS m FROM lin WHERE language IN ('javascript', 'typescript', 'vue')),
    typed AS (SELECT path, 'typescript' AS language, line_no, m.names, m.source AS imported, CASE WHEN regexp_matches(m.source, '^[.]{{1,2}}/|^/') THEN 'internal' ELSE 'external' END AS import_type FROM x WHERE m.source <> ''), {imports.RESOLVE_SQL.format(rows='typed')}
    SELECT t.path, t.line_no, starts_with(t.names, '*') AS all_names, t.imported AS source, h.resolved FROM typed t LEFT JOIN hits h ON h.path = t.path AND h.imported = t.imported""")
def q_exports_resolve(spark, d):
    """Re-exports of scripts and the files they lead to."""
    rows = imports.exports_resolved(files_of(spark, d))
    return rows.groupBy("path", "line_no", "source").agg(F.bool_and(F.col("symbol").isNull()).alias("all_names"), F.max("resolved").alias("resolved")).select("path", "line_no", "all_names", "source", "resolved")


@add("q_internal_deps", f"WITH {_EN} SELECT a.path AS path, b.path AS target FROM e JOIN n a ON a.id = e.src LEFT JOIN n b ON b.id = e.dst WHERE e.import_type = 'internal'")
def q_internal_deps(spark, d):
    return q_direct_deps(spark, d).where("import_type = 'internal'").select("path", "target")


@add("q_resolve_import", f"WITH {_N}, w AS (SELECT DISTINCT regexp_replace(path, '\\.rs$', '') AS imported, path FROM n WHERE ends_with(path, '.rs')) SELECT imported, path FROM w WHERE NOT contains(split_part(imported, '/', -1), '.')")
def q_resolve_import(spark, d):
    """Each Rust file asked for by its path without extension; the longest variant that is unique is the file itself.

    A name with a dot counts as one with an extension, so no other is tried for it.
    """
    nodes = nodes_of(spark, d)
    rust = nodes.where(F.col("path").endswith(".rs")).select(F.regexp_replace("path", r"\.rs$", "").alias("imported"))
    return imports.variant_lookup(rust, nodes)


@add("q_alias_resolve", f"WITH {_N}, m AS (SELECT DISTINCT {_MOD.format('path')} AS module FROM n) SELECT '@' || module || '/x' AS imported, module || '/x' AS target FROM m")
def q_alias_resolve(spark, d):
    """Aliases resolved by their longest prefix: an import is split into its prefixes, which meet the aliases in an equi-join."""
    modules = nodes_of(spark, d).select(first_segment(F.col("path")).alias("module")).distinct()
    aliases = modules.select(F.concat(F.lit("@"), "module").alias("alias"), F.col("module").alias("folder"))
    asked = modules.select(F.concat(F.lit("@"), "module", F.lit("/x")).alias("imported"))
    offered = asked.select("imported", F.explode(prefixes(F.col("imported"))).alias("alias"))
    best = offered.join(aliases, "alias").groupBy("imported").agg(F.max_by(F.struct("alias", "folder"), F.length("alias")).alias("a"))
    return best.select("imported", F.concat("a.folder", F.col("imported").substr(F.length("a.alias") + 1, F.length("imported"))).alias("target"))


# ---- snapshots --------------------------------------------------------------------------------------------------------


@add("q_snapshot_list", "SELECT snapshot_id, count(DISTINCT path) AS files FROM snap_files GROUP BY snapshot_id")
def q_snapshot_list(spark, d):
    return table(spark, d, "snap_files").groupBy("snapshot_id").agg(F.count_distinct("path").alias("files"))


@add("q_snapshot_write", f"WITH {_N}, {_E} SELECT (SELECT count(*) FROM n) AS files, (SELECT count(*) FROM e) AS edges")
def q_snapshot_write(spark, d):
    """The last snapshot written to a store, listed and read back."""
    store = snapshots.SnapshotStore(spark, shared_dir(spark, "snapshots"))
    store.write(_snapshot_ids(spark, d)[-1], nodes_of(spark, d), edges_of(spark, d))
    (newest,) = store.list()
    files = store.read("files", newest).agg(F.count(F.lit(1)).alias("files"))
    return files.join(F.broadcast(store.read("edges", newest).agg(F.count(F.lit(1)).alias("edges"))))  # one row each


@add("q_snapshot_gc", """WITH s AS (SELECT DISTINCT snapshot_id, strptime(substr(snapshot_id, 1, 8), '%Y%m%d') AS day FROM snap_files), k AS (SELECT snapshot_id, substr(snapshot_id, 1, 4) || '-W' || lpad(weekofyear(day)::VARCHAR, 2, '0') AS week, substr(snapshot_id, 1, 6) AS month FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY snapshot_id DESC) AS d, row_number() OVER (PARTITION BY week ORDER BY snapshot_id DESC) = 1 AS w1, row_number() OVER (PARTITION BY month ORDER BY snapshot_id DESC) = 1 AS m1 FROM k),
    t AS (SELECT *, sum(w1::INT) OVER (ORDER BY snapshot_id DESC) AS wn, sum(m1::INT) OVER (ORDER BY snapshot_id DESC) AS mn FROM r)
    SELECT snapshot_id, d <= 7 OR w1 AND wn <= 4 OR m1 AND mn <= 12 AS kept FROM t""")
def q_snapshot_gc(spark, d):
    return snapshots.retained(table(spark, d, "snap_files").select("snapshot_id"))


@add("q_diff_added", f"WITH {_FILES2} SELECT path FROM fn WHERE path NOT IN (SELECT path FROM fo)")
def q_diff_added(spark, d):
    old, new = snapshot_files(spark, d)
    return new.join(old, "path", "left_anti").select("path")


@add("q_diff_removed", f"WITH {_FILES2} SELECT path FROM fo WHERE path NOT IN (SELECT path FROM fn)")
def q_diff_removed(spark, d):
    old, new = snapshot_files(spark, d)
    return old.join(new, "path", "left_anti").select("path")


@add("q_diff_modified", f"WITH {_FILES2} SELECT fo.path, fo.line_count AS old_lines, fn.line_count AS new_lines FROM fo JOIN fn USING (path) WHERE fo.line_count <> fn.line_count OR fo.language <> fn.language")
def q_diff_modified(spark, d):
    """Files whose size or language differ; as the reference has it, NULL differs from nothing here."""
    old, new = snapshot_files(spark, d)
    both = old.withColumnsRenamed({"language": "_l", "line_count": "old_lines"}).join(new.withColumnRenamed("line_count", "new_lines"), "path")
    return both.where("old_lines <> new_lines OR _l <> language").select("path", "old_lines", "new_lines")


@add("q_diff_summary", f"WITH {_FILES2} SELECT coalesce((SELECT sum(line_count) FROM fn), 0) - coalesce((SELECT sum(line_count) FROM fo), 0) AS net_lines, (SELECT count(*) FROM fn) - (SELECT count(*) FROM fo) AS net_files")
def q_diff_summary(spark, d):
    old, new = snapshot_files(spark, d)
    both = new.select(F.lit(1).alias("s"), "line_count").unionByName(old.select(F.lit(-1).alias("s"), "line_count"))
    return both.agg(F.coalesce(F.sum(F.col("s") * F.col("line_count")), F.lit(0)).alias("net_lines"), F.sum("s").alias("net_files"))


def _edge_paths(spark, d, snapshot):
    nodes = nodes_of(spark, d, snapshot).select("id", "path")
    e = edges_of(spark, d, snapshot).where("dst IS NOT NULL").select("src", "dst")
    return e.join(nodes.select(F.col("id").alias("src"), "path"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("path").alias("target")), "dst").select("path", "target").distinct()


def _edge_paths_sql(which: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT a.path, b.path AS target FROM dependency_edges x JOIN (SELECT id, path FROM snap_files WHERE snapshot_id = (SELECT {which} FROM ids) UNION SELECT file_id, path FROM core_files) a ON a.id = x.source_file_id JOIN (SELECT id, path FROM snap_files WHERE snapshot_id = (SELECT {which} FROM ids) UNION SELECT file_id, path FROM core_files) b ON b.id = x.target_file_id WHERE x.snapshot_id = (SELECT {which} FROM ids))"


_EDGES2 = f"{_SNAPS}, {_edge_paths_sql('old', 'eo')}, {_edge_paths_sql('new', 'en')}"


@add("q_diff_edges_added", f"WITH {_EDGES2} SELECT * FROM en EXCEPT SELECT * FROM eo")
def q_diff_edges_added(spark, d):
    old, new = _snapshot_ids(spark, d)[-2:]
    return _edge_paths(spark, d, new).join(_edge_paths(spark, d, old), ["path", "target"], "left_anti")


@add("q_diff_edges_removed", f"WITH {_EDGES2} SELECT * FROM eo EXCEPT SELECT * FROM en")
def q_diff_edges_removed(spark, d):
    old, new = _snapshot_ids(spark, d)[-2:]
    return _edge_paths(spark, d, old).join(_edge_paths(spark, d, new), ["path", "target"], "left_anti")


@add("q_diff_modules", f"WITH {_FILES2}, mo AS (SELECT {_MOD.format('path')} AS module, count(*) AS c FROM fo GROUP BY 1), mn AS (SELECT {_MOD.format('path')} AS module, count(*) AS c FROM fn GROUP BY 1) SELECT module, mo.c AS old_files, mn.c AS new_files FROM mo FULL JOIN mn USING (module)")
def q_diff_modules(spark, d):
    old, new = (snapshots.module_metrics(f, [], first_segment(F.col("path"))) for f in snapshot_files(spark, d))
    return old.select("module", F.col("files").alias("old_files")).join(new.select("module", F.col("files").alias("new_files")), "module", "full_outer")


_HOT2 = f"{_EDGES2}, ho AS (SELECT target AS path, count(*) AS c FROM eo GROUP BY 1), hn AS (SELECT target AS path, count(*) AS c FROM en GROUP BY 1)"


@add("q_diff_hotspots", f"WITH {_HOT2} SELECT path, coalesce(ho.c, 0) AS old_imports, hn.c AS new_imports, hn.c - coalesce(ho.c, 0) AS delta FROM hn LEFT JOIN ho USING (path) WHERE hn.c >= 2")
def q_diff_hotspots(spark, d):
    """Present hotspots with the change of their imports; what only was one is left out, as in the reference."""
    old, new = (_edge_paths(spark, d, s).groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("c")) for s in _snapshot_ids(spark, d)[-2:])
    both = new.where("c >= 2").withColumnRenamed("c", "new_imports").join(old.withColumnRenamed("c", "old_imports"), "path", "left").withColumn("old_imports", F.coalesce("old_imports", F.lit(0)))
    return both.withColumn("delta", F.col("new_imports") - F.col("old_imports"))


def _cycle_paths(spark, d, snapshot):
    e = edges_of(spark, d, snapshot).where("import_type <> 'mod_decl' OR import_type IS NULL")
    nodes = nodes_of(spark, d, snapshot).select("id", "path")
    return graph.strong_components(e).join(nodes, "id", "left").groupBy("component").agg(F.sort_array(F.collect_set(F.coalesce("path", F.col("id").cast("string")))).alias("members"))


def _cycle_sizes(spark: SparkSession, d: str, snapshot: str) -> DataFrame:
    """(subject, value): the least path on each import cycle of a snapshot and how many files the cycle has."""
    e = edges_of(spark, d, snapshot).where("import_type <> 'mod_decl' OR import_type IS NULL")
    nodes = nodes_of(spark, d, snapshot).groupBy("id").agg(F.min("path").alias("path"))
    named = graph.strong_components(e).join(nodes, "id", "left").groupBy("component")
    return named.agg(F.min(F.coalesce("path", F.col("id").cast("string"))).alias("subject"), F.count(F.lit(1)).alias("value")).select("subject", "value")


@add("q_diff_cycles", f"""WITH RECURSIVE {_SNAPS}, {_at_sql('old', 'o')}, {_at_sql('new', 'w')}, {_cycles_sql('eo', 'sco')}, {_cycles_sql('ew', 'scw')},
    mo AS (SELECT string_agg(p, ',' ORDER BY p) AS members FROM (SELECT DISTINCT component, coalesce(path, s.id::VARCHAR) AS p FROM sco s LEFT JOIN no x ON x.id = s.id) GROUP BY component),
    mw AS (SELECT string_agg(p, ',' ORDER BY p) AS members FROM (SELECT DISTINCT component, coalesce(path, s.id::VARCHAR) AS p FROM scw s LEFT JOIN nw x ON x.id = s.id) GROUP BY component)
    SELECT 'added' AS change, members FROM mw WHERE members NOT IN (SELECT members FROM mo) UNION ALL SELECT 'removed', members FROM mo WHERE members NOT IN (SELECT members FROM mw)""")
def q_diff_cycles(spark, d):
    """Import cycles, as sorted lists of paths, that came or went between the last two snapshots."""
    old, new = (_cycle_paths(spark, d, s).select("members") for s in _snapshot_ids(spark, d)[-2:])
    came = new.join(old, "members", "left_anti").withColumn("change", F.lit("added"))
    return came.unionByName(old.join(new, "members", "left_anti").withColumn("change", F.lit("removed"))).select("change", F.array_join("members", ",").alias("members"))


@add("q_diff_islands", f"""WITH RECURSIVE {_SNAPS}, {_at_sql('old', 'o')}, {_at_sql('new', 'w')}, {_islands_sql('eo', 'no', 'iso')}, {_islands_sql('ew', 'nw', 'isw')}
    SELECT (SELECT count(DISTINCT component) FROM iso) AS old_islands, (SELECT count(DISTINCT component) FROM isw) AS new_islands""")
def q_diff_islands(spark, d):
    """Number of islands in the last two snapshots."""
    old, new = _snapshot_ids(spark, d)[-2:]
    counts = [graph.components(nodes_of(spark, d, s), edges_of(spark, d, s)).agg(F.count_distinct("component").alias(n)) for s, n in ((old, "old_islands"), (new, "new_islands"))]
    return counts[0].join(F.broadcast(counts[1]))  # one row each


@add("q_threshold_alerts", f"""WITH RECURSIVE {_HOT2}, {_at_sql('new', 'w')}, {_cycles_sql('ew', 'scw')}, fo AS (SELECT DISTINCT path, line_count FROM snap_files WHERE snapshot_id = (SELECT old FROM ids)), fn AS (SELECT DISTINCT path, line_count FROM snap_files WHERE snapshot_id = (SELECT new FROM ids))
    SELECT CASE WHEN c >= 25 THEN 'critical' ELSE 'warning' END AS severity, 'fan_in' AS category, path AS subject, c::DOUBLE AS value FROM hn WHERE c >= 10
    UNION ALL SELECT 'warning', 'circular_dependency', min(coalesce(path, s.id::VARCHAR)), count(*)::DOUBLE FROM scw s LEFT JOIN (SELECT id, min(path) AS path FROM nw GROUP BY id) x ON x.id = s.id GROUP BY component HAVING count(*) >= 3
    UNION ALL SELECT 'warning', 'module_size', {_MOD.format('path')}, count(*)::DOUBLE FROM fn GROUP BY 3 HAVING count(*) >= 50
    UNION ALL SELECT 'warning', 'line_growth', path, fn.line_count::DOUBLE / fo.line_count FROM fo JOIN fn USING (path) WHERE fo.line_count > 0 AND fn.line_count::DOUBLE / fo.line_count >= 2""")
def q_threshold_alerts(spark, d):
    """Alerts of the last snapshot."""
    old, new = snapshot_files(spark, d)
    hot = _edge_paths(spark, d, _snapshot_ids(spark, d)[-1]).groupBy(F.col("target").alias("subject")).agg(F.count(F.lit(1)).alias("value"))
    modules = snapshots.module_metrics(new, [], first_segment(F.col("path"))).select(F.col("module").alias("subject"), F.col("files").alias("value"))
    grown = old.select(F.col("path").alias("subject"), F.col("line_count").alias("old")).join(new.select(F.col("path").alias("subject"), F.col("line_count").alias("new")), "subject")
    return snapshots.alerts(hot, _cycle_sizes(spark, d, _snapshot_ids(spark, d)[-1]), modules, grown)


@add("q_module_recent_changes", f"WITH {_FILES2}, c AS (SELECT path FROM fn WHERE path NOT IN (SELECT path FROM fo)) SELECT {_MOD.format('path')} AS module, path FROM c QUALIFY row_number() OVER (PARTITION BY {_MOD.format('path')} ORDER BY path) <= 10")
def q_module_recent_changes(spark, d):
    """Up to ten added files of each module."""
    added = q_diff_added(spark, d).withColumn("module", first_segment(F.col("path")))
    return added.withColumn("_n", F.row_number().over(Window.partitionBy("module").orderBy("path"))).where("_n <= 10").select("module", "path")


@add("q_index_status", f"WITH {_RUNS}, l AS (SELECT max(last_indexed) AS at FROM files), c AS (SELECT max(updated_at) AS at FROM indexing_status WHERE run_id IN (SELECT run_id FROM runs WHERE state = 'completed')) SELECT l.at > c.at AS stale, l.at AS last_indexed, c.at AS last_completed FROM l, c")
def q_index_status(spark, d):
    """Whether files have changed since the last completed run."""
    status = table(spark, d, "indexing_status")
    done = run_states(status).where("state = 'completed'")
    completed = status.join(done, "run_id", "left_semi").agg(F.max("updated_at").alias("last_completed"))
    files = table(spark, d, "files").agg(F.max("last_indexed").alias("last_indexed"))
    return files.join(F.broadcast(completed)).select((F.col("last_indexed") > F.col("last_completed")).alias("stale"), "last_indexed", "last_completed")


# ---- activity: orders stand for commits, their lines for changed files -------------------------------------------------


def changes_of(spark, d):
    """(commit, author, ts, file, module): each line of an order is a change of its part by the order's customer."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("module"))
    return items.join(orders, "commit").join(parts, "file")


_CH = "ch AS (SELECT o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts, l_partkey AS file, p_brand AS module FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


@add("q_contributors", "SELECT o_custkey AS author, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS email, count(DISTINCT o_orderkey) AS commits FROM orders GROUP BY 1")
def q_contributors(spark, d):
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("email"), F.col("o_orderdate").alias("ts"))
    return activity.contributors(commits)


@add("q_file_churn", f"WITH {_CH}, a AS (SELECT file, author, count(*) AS n FROM ch GROUP BY ALL) SELECT file, sum(n)::BIGINT AS changes, arg_max(author, (n, -author)) AS top_author FROM a GROUP BY file ORDER BY changes DESC, file LIMIT 50")
def q_file_churn(spark, d):
    return activity.churn(changes_of(spark, d), ["file"]).orderBy(F.desc("changes"), "file").limit(50)


@add("q_module_activity", f"WITH {_CH}, a AS (SELECT module, author, count(*) AS n FROM ch GROUP BY ALL), f AS (SELECT module, count(DISTINCT file) AS files FROM ch GROUP BY 1) SELECT module, sum(n)::BIGINT AS changes, arg_max(author, (n, -author)) AS top_author, any_value(files) AS files FROM a JOIN f USING (module) GROUP BY module")
def q_module_activity(spark, d):
    ch = changes_of(spark, d)
    return activity.churn(ch, ["module"]).join(ch.groupBy("module").agg(F.count_distinct("file").alias("files")), "module")


@add("q_weekly_summary", f"WITH {_CH} SELECT date_trunc('week', ts)::DATE AS week, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, count(DISTINCT file) AS files FROM ch GROUP BY 1")
def q_weekly_summary(spark, d):
    return activity.weekly(changes_of(spark, d))


@add("q_top3_modules_per_week", f"WITH {_CH}, c AS (SELECT date_trunc('week', ts)::DATE AS week, module, count(*) AS changes FROM ch GROUP BY ALL) SELECT week, module, changes, row_number() OVER (PARTITION BY week ORDER BY changes DESC, module) AS place FROM c QUALIFY place <= 3")
def q_top3_modules_per_week(spark, d):
    return activity.top_per_week(changes_of(spark, d), "module")


@add("q_commit_parse", "SELECT source, count(*) AS commits FROM documents WHERE kind = 'commit' AND text <> '' AND regexp_matches(split_part(replace(text, chr(13), ''), chr(10), 1), '^[a-z]+\\([a-z_]+\\): ') GROUP BY source")
def q_commit_parse(spark, d):
    """Commit messages whose first line has the form ``kind(scope): subject``, per source."""
    first = F.substring_index(F.replace("text", F.lit("\r"), F.lit("")), "\n", 1)
    return table(spark, d, "documents").where("kind = 'commit' AND text <> ''").where(first.rlike(r"^[a-z]+\([a-z_]+\): ")).groupBy("source").agg(F.count(F.lit(1)).alias("commits"))


@add("q_commit_log", "SELECT o_custkey::VARCHAR AS author, count(DISTINCT o_orderkey) AS commits, count(l_partkey) AS paths FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q_commit_log(spark, d):
    """A log as a versioning tool writes it, a record per commit, parsed back to commits and paths."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(F.col("l_partkey").cast("string")), "\n").alias("paths"))
    head = F.concat_ws("|", F.lower(F.lpad(F.hex("o_orderkey"), 8, "0")), F.col("o_custkey").cast("string"), F.lit("a@b"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"), "o_orderpriority")
    records = table(spark, d, "orders").join(items, "o_orderkey", "left").select(F.concat_ws("\n", head, "paths").alias("record"))
    return activity.parse_records(records, "record").groupBy("author").agg(F.count_distinct("hash").alias("commits"), F.count("path").alias("paths"))


@add("q_changelog", "SELECT regexp_extract(l, '^([a-z]+)\\(([a-z_]+)\\): ', 1) AS change, regexp_extract(l, '^([a-z]+)\\(([a-z_]+)\\): ', 2) AS scope, count(*) AS commits FROM (SELECT split_part(replace(text, chr(13), ''), chr(10), 1) AS l FROM documents WHERE kind = 'commit' AND text <> '') WHERE regexp_matches(l, '^[a-z]+\\([a-z_]+\\): ') GROUP BY ALL")
def q_changelog(spark, d):
    first = F.substring_index(F.replace("text", F.lit("\r"), F.lit("")), "\n", 1)
    head = r"^([a-z]+)\(([a-z_]+)\): "
    rows = table(spark, d, "documents").where("kind = 'commit' AND text <> ''").select(first.alias("l")).where(F.col("l").rlike(head))
    return rows.groupBy(F.regexp_extract("l", head, 1).alias("change"), F.regexp_extract("l", head, 2).alias("scope")).agg(F.count(F.lit(1)).alias("commits"))


# ---- change events and commands ----------------------------------------------------------------------------------------


@add("q_session_debounce", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 15 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, n""")
def q_session_debounce(spark, d):
    """Bursts of each user's events that end after 15 minutes of silence; the stream of ``streaming.watch`` does the same."""
    rows = table(spark, d, "events").select("user_id", "ts")
    return debounced(rows, ["user_id"], quiet="15 minutes")


@add("q_incremental_classify", f"WITH {_FILES2}, o AS (SELECT path, md5(coalesce(language, '') || '|' || coalesce(line_count::VARCHAR, '')) AS hash FROM fo), n AS (SELECT path, md5(coalesce(language, '') || '|' || coalesce(line_count::VARCHAR, '')) AS hash FROM fn) SELECT path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n USING (path)")
def q_incremental_classify(spark, d):
    key = F.md5(F.concat(F.coalesce("language", F.lit("")), F.lit("|"), F.coalesce(F.col("line_count").cast("string"), F.lit(""))))
    old, new = (f.select("path", key.alias("hash")) for f in snapshot_files(spark, d))
    return classify(old, new)


@add("q_command_string", f"WITH {_LIN} SELECT path, line_no AS start_line FROM lin WHERE {_word_sql('ledger')} AND language = 'python' AND NOT regexp_matches(path, '^(?:.*/)?tests/.*$')")
def q_command_string(spark, d):
    spec = parse_command('query "ledger" --lang py --exclude "**/tests/*" --unknown')
    return search.text_hits(files_of(spark, d), spec).select("path", "start_line")


@add("q_instruction", "SELECT * FROM (VALUES (0, 0, 'no_results'), (100, 700, 'too_broad'), (20, 60, 'paginated'), (60, 60, NULL)) t(results, total, instruction)")
def q_instruction(spark, d):
    cases = [(0, 0, False), (100, 700, True), (20, 60, True), (60, 60, False)]
    return spark.createDataFrame([(r, t, instruction(r, t, more, QuerySpec(pattern=WORD))) for r, t, more in cases], "results int, total int, instruction string")


@add("q_project_type", f"WITH {_CUR}, c AS (SELECT {_MOD.format('path')} AS repository, language, count(*) AS files FROM cur WHERE language IS NOT NULL GROUP BY ALL) SELECT repository, arg_max(language, (files, language)) AS main_language FROM c GROUP BY repository")
def q_project_type(spark, d):
    """The main language of each repository; of equal ones the last by name."""
    counts = files_of(spark, d, False).where("language IS NOT NULL").groupBy(first_segment(F.col("path")).alias("repository"), "language").agg(F.count(F.lit(1)).alias("files"))
    return counts.groupBy("repository").agg(F.max(F.struct("files", "language"))["language"].alias("main_language"))


@add("q_frameworks", f"WITH {_LIN} SELECT {_MOD.format('path')} AS repository, bool_or(regexp_matches(path, '(^|/)tests?/')) AS has_tests, bool_or(regexp_matches(path, '(^|/)examples/')) AS has_examples, bool_or(language = 'rust' AND regexp_matches(line, '^use crate::')) AS has_crate FROM lin GROUP BY 1")
def q_frameworks(spark, d):
    """Layout marks per repository: tests, examples, and a crate of its own."""
    rows = lines(files_of(spark, d).select("path", "language", "content"))
    return rows.groupBy(first_segment(F.col("path")).alias("repository")).agg(F.bool_or(F.col("path").rlike("(^|/)tests?/")).alias("has_tests"), F.bool_or(F.col("path").rlike("(^|/)examples/")).alias("has_examples"), F.bool_or((F.col("language") == "rust") & F.col("line").rlike("^use crate::")).alias("has_crate"))


# ---- what a repository is: rules over paths and texts ------------------------------------------------------------------

_RULE_ROWS = ", ".join("('{}', '{}', '{}', '{}')".format(*(x.replace("'", "''") for x in rule)) for rule in detection.RULES)


@add("q_context_bundle", f"WITH {_CUR}, rules(kind, name, path_rule, text_rule) AS (VALUES {_RULE_ROWS}) SELECT DISTINCT {_MOD.format('path')} AS repository, kind, name FROM cur, rules WHERE regexp_matches(path, path_rule) AND (text_rule = '' OR regexp_matches(coalesce(content, ''), text_rule))")
def q_context_bundle(spark, d):
    """Project types, frameworks, configuration files and test layouts of each repository."""
    return detection.detected(files_of(spark, d))
