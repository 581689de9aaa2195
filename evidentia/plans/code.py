"""Queries over source code derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import corpus, java
from evidentia.operators.ranking import capped, top_k
from evidentia.plans import sqltext as S
from evidentia.plans.derive import code_files, symbol_queries
from evidentia.plans.registry import query
from evidentia.session import table


def _j(col):
    return F.array_join(col, " ")


def _big(name):
    return F.col(name).cast("bigint").alias(name)


@query("win_brace_depth", f"""WITH {S.CODE}
SELECT file, kind, name, decl_line, end_line FROM decls""")
def win_brace_depth(spark, sf):
    return java.declarations(code_files(spark, sf)).select("file", "kind", "name", "decl_line", "end_line")


@query("win_annotation_back", f"""WITH {S.CODE}
SELECT file, kind, name, decl_line, start_line FROM decls""")
def win_annotation_back(spark, sf):
    return java.declarations(code_files(spark, sf)).select("file", "kind", "name", "decl_line", "start_line")


_CHUNK_SQL = f"""WITH RECURSIVE {S.DECL_CHUNKS}
SELECT repo, file, chunk_type, symbol_name, start_line, end_line, md5(content) AS digest,
  left(sha256(file || ':' || chunk_type || ':' || id_symbol || ':' || start_line || ':' || end_line), 16) AS chunk_id
FROM decl_chunks"""


@query("pl_declarations", _CHUNK_SQL)
def pl_declarations(spark, sf):
    return corpus.finish_chunks(java.declaration_chunks(code_files(spark, sf))).select(
        "repo", "file", "chunk_type", "symbol_name", "start_line", "end_line", F.md5("content").alias("digest"),
        "chunk_id")


@query("win_split_oversized", f"""WITH RECURSIVE {S.DECL_CHUNKS}
SELECT file, kind, name, w, cur + 1 AS start_line, we + 1 AS end_line FROM wins_end""")
def win_split_oversized(spark, sf):
    d = java.with_declarations(code_files(spark, sf)).select("file", "_lines", F.explode("_decls").alias("d"))
    long = F.col("d.end") - F.col("d.start") + 1 > java.MAX_DECL_LINES
    wins = d.where(long).select(
        "file", "d.kind", "d.name",
        F.explode(java.split_block(F.col("_lines"), F.col("d.start"), F.col("d.end"))).alias("x"))
    return wins.select("file", "kind", "name", F.col("x.w").cast("bigint").alias("w"),
                       (F.col("x.s") + 1).cast("bigint").alias("start_line"),
                       (F.col("x.e") + 1).cast("bigint").alias("end_line"))


@query("jn_symbol", f"""WITH {S.CODE}, {S.SYMBOL_ROWS}, {S.SYMBOL_QUERIES}
SELECT q.query_id, q.symbol_no, s.repo, s.file, s.line, s.kind, s.name FROM symbol_rows s
JOIN symbol_queries q ON q.repo = s.repo AND q.symbol = s.name""")
def jn_symbol(spark, sf):
    return java.symbol_matches(code_files(spark, sf), symbol_queries(spark, sf)).select(
        "query_id", _big("symbol_no"), "repo", "file", "line", "kind", "name")


_SYMBOL_TOP = f"""WITH {S.CODE}, {S.SYMBOL_ROWS}, {S.SYMBOL_QUERIES}, found AS (
  SELECT q.query_id, s.file, s.line AS start_line, block_end AS end_line, s.kind, q.symbol,
    left(sha256(file || ':' || kind || ':' || symbol || ':' || line || ':' || block_end), 16) AS chunk_id,
    row_number() OVER (PARTITION BY q.query_id ORDER BY q.symbol_no, s.file, s.line, s.kind) AS rank
  FROM symbol_rows s JOIN symbol_queries q ON q.repo = s.repo AND q.symbol = s.name QUALIFY rank <= 10)"""


def _symbol_top(spark, sf):
    return java.symbol_search(code_files(spark, sf), symbol_queries(spark, sf))


@query("pl_symbol_search", _SYMBOL_TOP + " SELECT query_id, rank, file, start_line, end_line, kind, symbol, chunk_id FROM found")
def pl_symbol_search(spark, sf):
    return _symbol_top(spark, sf).select(
        "query_id", _big("rank"), "file", "start_line", "end_line", "kind", "symbol", "chunk_id")


@query("win_symbol_rank", _SYMBOL_TOP + " SELECT query_id, chunk_id, rank FROM found")
def win_symbol_rank(spark, sf):
    return _symbol_top(spark, sf).select("query_id", "chunk_id", _big("rank"))


@query("srt_symbol_hits", f"""WITH {S.CODE}, {S.SYMBOL_ROWS}, {S.SYMBOL_QUERIES}, m AS (
  SELECT q.query_id, q.symbol, s.file, s.line, s.kind,
    row_number() OVER (PARTITION BY q.query_id, q.symbol ORDER BY s.file, s.line, s.kind) AS n,
    count(*) OVER (PARTITION BY q.query_id, q.symbol) > 50 AS truncated
  FROM symbol_rows s JOIN symbol_queries q ON q.repo = s.repo AND q.symbol = s.name)
SELECT query_id, symbol, file, line, kind, truncated FROM m WHERE n <= 50""")
def srt_symbol_hits(spark, sf):
    m = java.symbol_matches(code_files(spark, sf), symbol_queries(spark, sf)).withColumnRenamed("name", "symbol")
    order = [F.asc("file"), F.asc("line"), F.asc("kind")]
    return capped(m, ["query_id", "symbol"], order, 50).select(
        "query_id", "symbol", "file", "line", "kind", "truncated")


@query("win_candidate_files", f"""WITH {S.CODE}, {S.SYMBOL_ROWS}, {S.SYMBOL_QUERIES}, m AS (
  SELECT q.query_id, q.symbol_no, s.file, s.line, s.kind,
    row_number() OVER (PARTITION BY q.query_id, q.symbol_no ORDER BY s.file, s.line, s.kind) AS match_no
  FROM symbol_rows s JOIN symbol_queries q ON q.repo = s.repo AND q.symbol = s.name QUALIFY match_no <= 20),
f AS (SELECT query_id, file, min(symbol_no * 1000 + match_no) AS seen FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS k FROM f QUALIFY k <= 30)
SELECT query_id, file FROM r""")
def win_candidate_files(spark, sf):
    m = java.symbol_matches(code_files(spark, sf), symbol_queries(spark, sf)).where(F.col("symbol_no") < 8)
    m = m.withColumn("_walk", tx.walk_key(F.col("file")))
    m = top_k(m, ["query_id", "symbol_no"], [F.asc("_walk"), F.asc("line"), F.asc("kind")], 20, "n")
    f = m.groupBy("query_id", "file").agg(F.min(F.struct("symbol_no", "n")).alias("seen"))
    return top_k(f, ["query_id"], [F.asc("seen")], 30).select("query_id", "file")


# ------------------------------------------------------- names and identifiers
_IDENT_OK = f"""length(x) >= 3 AND (lower(x) <> x OR x IN ('int', 'long', 'char'))
 AND x NOT IN {S.in_list(tx.V.SYMBOL_STOP_WORDS)} AND NOT (upper(x) = x AND length(x) <= 4)"""


@query("flt_identifier", f"""SELECT doc_id, unnest(list_distinct(list_filter(
  regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: {_IDENT_OK}))) AS symbol FROM documents""")
def flt_identifier(spark, sf):
    ids = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(tx.IDENTIFIER), 0), tx.is_symbol))
    return table(spark, sf, "documents").select("doc_id", F.explode(ids).alias("symbol"))


_STACK = f"""WITH {S.CODE}, frames AS (
  SELECT doc_id, [cls, method, 'loadAll'] AS log_names, ls FROM code),
parts AS (
  SELECT doc_id, unnest(list_concat(log_names, regexp_extract_all(array_to_string(ls, chr(10)), '[A-Za-z_][A-Za-z0-9_]*'))) AS x,
         generate_subscripts(list_concat(log_names, regexp_extract_all(array_to_string(ls, chr(10)), '[A-Za-z_][A-Za-z0-9_]*')), 1) AS p
  FROM frames),
firsts AS (SELECT doc_id, x, min(p) AS p FROM parts WHERE {_IDENT_OK} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM firsts)
"""


def _stack_log():
    return F.concat(
        F.lit("java.lang.IllegalStateException: boom\n\tat com.acme.app."), F.col("cls"), F.lit("."), F.col("method"),
        F.lit("(X.java:15)\n\tat com.acme.app."), F.col("cls"), F.lit(".loadAll(X.java:3)\n"))


@query("fn_stack_symbols", _STACK + " SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS symbols FROM ranked GROUP BY 1")
def fn_stack_symbols(spark, sf):
    return code_files(spark, sf).select(
        "doc_id", _j(tx.stack_symbols(F.col("content"), _stack_log())).alias("symbols"))


def _mined(spark, sf):
    """Symbols of three sources per file, in source order."""
    files = code_files(spark, sf)
    first = tx.stack_symbols(F.lit(""), _stack_log())
    named = F.array(F.col("dep"), F.col("cls"))
    planned = F.array(F.lit("Transactional"), F.col("method"), F.lit("List"))
    return files.select("doc_id", F.array(first, named, planned).alias("sources"))


_UNION = f"""WITH {S.CODE}, src AS (
  SELECT doc_id, [cls, method, 'loadAll', dep, cls, 'Transactional', method, 'List'] AS xs FROM code),
parts AS (SELECT doc_id, unnest(xs) AS symbol, generate_subscripts(xs, 1) AS p FROM src),
firsts AS (SELECT doc_id, symbol, min(p) AS p FROM parts GROUP BY 1, 2)"""


@query("set_symbol_union", _UNION + """
SELECT doc_id, symbol, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM firsts QUALIFY n <= 8""")
def set_symbol_union(spark, sf):
    merged = F.slice(F.array_distinct(F.flatten("sources")), 1, 8)
    return _mined(spark, sf).select("doc_id", F.posexplode(merged).alias("_p", "symbol")).select(
        "doc_id", "symbol", (F.col("_p") + 1).cast("bigint").alias("n"))


@query("fn_strip_code", f"""WITH {S.CODE}, blanked AS (
  SELECT file, list_concat(ls[1:15],
    ['        String open = ' || repeat(' ', 15) || ';', '        ' || repeat(' ', 18), repeat(' ', 15), '        ' || repeat(' ', 17)],
    list_transform(stm, lambda x: '        text.add(' || repeat(' ', length(x) + 2) || ');'),
    ls[n + 20 : n + 22]) AS ls FROM code)
SELECT file, md5(array_to_string(ls, chr(10)) || chr(10)) AS digest FROM blanked""")
def fn_strip_code(spark, sf):
    return code_files(spark, sf).select("file", F.md5(java.strip_code(F.col("content"))).alias("digest"))


@query("fn_imports", f"""WITH {S.CODE}, per_line AS (SELECT file, unnest(ls) AS line FROM code)
SELECT file, regexp_extract(line, '([A-Za-z_$][\\w$]*)\\s*;\\s*$', 1) AS symbol FROM per_line
WHERE regexp_matches(line, '^\\s*import\\s+(static\\s+)?[A-Za-z_$][\\w$]*(\\.[A-Za-z_$][\\w$]*)+\\s*;\\s*$')""")
def fn_imports(spark, sf):
    return code_files(spark, sf).select("file", F.explode(java.simple_imports(F.col("content"))).alias("symbol"))


@query("fn_type_symbols", f"""WITH {S.CODE}
SELECT file, array_to_string(list_sort([cls, dep, 'List', 'Service', 'Transactional']), ' ') AS confident,
  '' AS uncertain, array_to_string(list_sort([dep, 'List']), ' ') AS qualified FROM code""")
def fn_type_symbols(spark, sf):
    s = code_files(spark, sf).select("file", java.type_symbols(F.col("content")).alias("s"))
    return s.select("file", *[_j(f"s.{f}").alias(f) for f in ("confident", "uncertain", "qualified")])


# ------------------------------------------------------------------- file paths
def _paths(spark, sf):
    """One path per document, spread over layouts that scans and views treat differently."""
    d = table(spark, sf, "documents")
    layouts = F.array(*[F.lit(x) for x in _LAYOUTS])
    path = F.concat(F.element_at(layouts, (F.col("doc_id") % len(_LAYOUTS) + 1).cast("int")),
                    F.lpad(F.col("doc_id").cast("string"), 9, "0"),
                    F.element_at(F.array(*[F.lit(x) for x in _ENDINGS]), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int")))
    return d.select(F.col("source").alias("repo"), "doc_id", path.alias("file"), "text")


_LAYOUTS = ["src/main/java/com/acme/A", "src/main/resources/r", "src/test/java/com/acme/T", "target/classes/X", ".git/o",
            "docs/m", "build/gen/G", "module/src/main/java/B", "benchmark/c", ".env.", "node_modules/p/", "pom", "artifacts/q"]
_ENDINGS = [".java", ".xml", ".yml", ".md", ".properties", ".class", ".sql", ".LOG", ""]
_PATHS = f"""paths AS (
  SELECT doc_id, source AS repo, text, ({[*_LAYOUTS]})[(doc_id % {len(_LAYOUTS)}) + 1] || lpad(doc_id::VARCHAR, 9, '0')
         || ({[*_ENDINGS]})[(doc_id % {len(_ENDINGS)}) + 1] AS file FROM documents)"""


def _scanned(spark, sf):
    from evidentia.sources.files import scannable

    return _paths(spark, sf).where(scannable(F.col("file")))


_SCAN_WHERE = f"""len(list_filter(string_split(file, '/')[:-2], lambda p: p IN {S.in_list(tx.V.SCAN_EXCLUDED_DIRS)} OR p LIKE '.%')) = 0
  AND regexp_extract(file, '[^/](\\.[^./]+)$', 1) IN {S.in_list(tx.V.INDEXABLE_EXTENSIONS)}"""
_WALK = """array_to_string(list_concat(list_transform(string_split(file, '/')[:-2], lambda p: '1/' || p),
  ['0/' || string_split(file, '/')[-1]]), chr(1))"""


@query("src_repo_files", f"""WITH {_PATHS}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_WALK}) AS file_no FROM paths WHERE {_SCAN_WHERE})
SELECT repo, file, file_no, length(text) AS n_chars FROM kept WHERE file_no <= 200""")
def src_repo_files(spark, sf):
    kept = top_k(_scanned(spark, sf), ["repo"], [tx.walk_key(F.col("file"))], 200, "file_no")
    return kept.select("repo", "file", _big("file_no"),
                       F.length("text").cast("bigint").alias("n_chars"))


@query("src_walk_order", f"""WITH {_PATHS} SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY {_WALK}) AS walk_no FROM paths""")
def src_walk_order(spark, sf):
    from evidentia.operators.ranking import ranged_row_number

    return ranged_row_number(_paths(spark, sf), ["repo"], [tx.walk_key(F.col("file"))], "walk_no").select("repo", "file", _big("walk_no"))


@query("srt_list_caps", f"""WITH {_PATHS}, kept AS (
  SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY {_WALK}) AS n, count(*) OVER (PARTITION BY repo) AS total
  FROM paths WHERE {_SCAN_WHERE})
SELECT repo, file, total > 10 AS truncated FROM kept WHERE n <= 10""")
def srt_list_caps(spark, sf):
    return capped(_scanned(spark, sf), ["repo"], [tx.walk_key(F.col("file"))], 10).select("repo", "file", "truncated")


def _view_sql(dirs, names):
    return f"""WITH {_PATHS}, p AS (SELECT repo, file, lower(file) AS f, string_split(lower(file), '/') AS parts FROM paths)
SELECT repo, file FROM p WHERE len(list_intersect(parts, {dirs})) = 0 AND parts[-1] <> '.env' AND parts[-1] NOT LIKE '.env.%'
  AND {names}"""


@query("flt_repo_view", _view_sql(
    "['.git', 'target', 'benchmark', 'artifacts']",
    "f NOT LIKE '%.md' AND f <> 'readme.md' AND NOT contains('/' || f || '/', '/src/test/')"))
def flt_repo_view(spark, sf):
    from evidentia.sources.files import in_repository_view

    return _paths(spark, sf).where(in_repository_view(F.col("file"))).select("repo", "file")


@query("flt_workspace_view", _view_sql(
    "['.git', 'target', 'build', 'node_modules', 'artifacts', 'benchmark', '__pycache__']",
    "NOT regexp_matches(f, '\\.(md|class|jar|log)$')"))
def flt_workspace_view(spark, sf):
    from evidentia.sources.files import in_workspace_view

    return _paths(spark, sf).where(in_workspace_view(F.col("file"))).select("repo", "file")


@query("ag_tree_listing", f"""WITH {_PATHS}, shallow AS (
  SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY {_WALK}) AS n, count(*) OVER (PARTITION BY repo) AS total
  FROM paths WHERE len(string_split(file, '/')) <= 3
    AND len(list_intersect(string_split(file, '/')[:-2], {tx.V.SCAN_EXCLUDED_DIRS})) = 0)
SELECT repo, count(*) AS file_count, count(*) FILTER (file LIKE '%.java') AS java_file_count, max(total) > 200 AS truncated
FROM shallow WHERE n <= 200 GROUP BY 1""")
def ag_tree_listing(spark, sf):
    from evidentia.sources.files import tree_listing

    return tree_listing(_paths(spark, sf))


@query("win_first_seen", """WITH w AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2)
SELECT user_id, event_type, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM w""")
def win_first_seen(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("t")).select(
        "user_id", "event_type", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))
