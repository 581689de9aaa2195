"""Search queries: corpus, BM25, lexical channel, fusion and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import bm25, corpus, fusion, lexical
from evidentia.plans import sqltext as S
from evidentia.plans.derive import bench_queries, chunk_index, doc_files, line_index, posting_index
from evidentia.plans.registry import query
from evidentia.session import materialize, table


def _chunks(spark, sf):
    return corpus.window_corpus(doc_files(spark, sf))


def _joined(col):
    return F.array_join(col, " ")


@query("src_lines", f"""WITH {S.LINES}
SELECT doc_id, line_no, left(trim(line), 200) AS context FROM file_lines""")
def src_lines(spark, sf):
    lines = corpus.numbered_lines(doc_files(spark, sf), "doc_id")
    return lines.select("doc_id", "line_no", F.left(F.trim("line"), F.lit(200)).alias("context"))


@query("win_line_windows", f"""WITH {S.WINDOWS}
SELECT file, start_line, end_line, length(content) AS n_chars, md5(content) AS digest FROM chunks""")
def win_line_windows(spark, sf):
    w = corpus.line_windows(doc_files(spark, sf))
    return w.select("file", "start_line", "end_line", F.length("content").cast("bigint").alias("n_chars"),
                    F.md5("content").alias("digest"))


@query("fn_tok_identifier", f"""SELECT doc_id,
  array_to_string(list_sort(list_distinct({S.plain_tokens('text')})), ' ') AS tokens FROM documents""")
def fn_tok_identifier(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", _joined(F.array_sort(tx.identifier_tokens(F.col("text")))).alias("tokens"))


_FIRST_TOKENS = f"""WITH parts AS (
  SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS p
  FROM (SELECT doc_id, {S.plain_tokens('text')} AS ts FROM documents)),
firsts AS (SELECT doc_id, token, min(p) AS p FROM parts GROUP BY 1, 2)
"""


@query("fn_tok_text", _FIRST_TOKENS + """
SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS token_no FROM firsts""")
def fn_tok_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(tx.text_tokens(F.col("text"))).alias("_p", "token")
    ).select("doc_id", "token", (F.col("_p") + 1).cast("bigint").alias("token_no"))


@query("fn_tok_chunk", f"""WITH {S.CHUNK_TOKENS}
SELECT chunk_id, tok_no AS token_no, token FROM chunk_tokens""")
def fn_tok_chunk(spark, sf):
    return _chunks(spark, sf).select("chunk_id", F.posexplode("tokens").alias("_p", "token")).select(
        "chunk_id", (F.col("_p") + 1).cast("bigint").alias("token_no"), "token")


@query("fn_norm_terms", f"""WITH {S.QUERY_TERMS}
SELECT query_id, string_agg(token, ' ' ORDER BY term_no) AS terms, count(*) AS n_terms
FROM query_terms GROUP BY 1""")
def fn_norm_terms(spark, sf):
    return bench_queries(spark, sf).select(
        "query_id", _joined("terms").alias("terms"), F.size("terms").cast("bigint").alias("n_terms"))


@query("fn_chunk_id", f"""WITH {S.WINDOWS} SELECT file, start_line, end_line, chunk_id FROM chunks""")
def fn_chunk_id(spark, sf):
    w = corpus.line_windows(doc_files(spark, sf))
    return w.select("file", "start_line", "end_line", tx.chunk_id(
        F.col("file"), F.col("chunk_type"), F.col("symbol_name"), F.col("start_line"), F.col("end_line")
    ).alias("chunk_id"))


_PAGE_FILE = "url || (['.java', '.xml', '.yml', '.yaml', '.properties', '.sql', '.txt'])[(page_id % 7) + 1]"


@query("fn_language", f"""SELECT page_id, CASE WHEN f LIKE '%.java' THEN 'java' WHEN f LIKE '%.xml' THEN 'xml'
  WHEN f LIKE '%.yml' OR f LIKE '%.yaml' THEN 'yaml' WHEN f LIKE '%.properties' THEN 'properties'
  WHEN f LIKE '%.sql' THEN 'sql' ELSE 'text' END AS language
FROM (SELECT page_id, {_PAGE_FILE} AS f FROM pages)""")
def fn_language(spark, sf):
    endings = F.array(*[F.lit(e) for e in (".java", ".xml", ".yml", ".yaml", ".properties", ".sql", ".txt")])
    f = F.concat("url", F.element_at(endings, (F.col("page_id") % 7 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", tx.language_of(f).alias("language"))


@query("pl_chunk_corpus", f"""WITH {S.CHUNK_TOKENS}
SELECT c.chunk_id, c.repo, c.file, 'yaml' AS language, 'config_block' AS chunk_type, c.start_line, c.end_line,
       md5(c.content) AS digest, coalesce(string_agg(t.token, ' ' ORDER BY t.tok_no), '') AS tokens
FROM chunks c LEFT JOIN chunk_tokens t USING (chunk_id) GROUP BY ALL""")
def pl_chunk_corpus(spark, sf):
    return corpus.chunk_corpus(doc_files(spark, sf)).select(
        "chunk_id", "repo", "file", "language", "chunk_type", "start_line", "end_line",
        F.md5("content").alias("digest"), _joined("tokens").alias("tokens"))


@query("ag_bm25_stats", f"""WITH {S.BM25}
SELECT token, df, n AS n_chunks, round(avgdl, 6) AS avg_len, round(idf, 6) AS idf FROM idfs, corpus_size""")
def ag_bm25_stats(spark, sf):
    return chunk_index(spark, sf)[1].select(
        "token", "df", "n_chunks", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


@query("jn_postings", f"""WITH {S.CHUNK_TOKENS}, {S.QUERY_TERMS}
SELECT query_id, chunk_id, token FROM query_terms JOIN chunk_tokens USING (token)""")
def jn_postings(spark, sf):
    return bm25.postings(posting_index(spark, sf), bm25.query_terms(bench_queries(spark, sf))).select(
        "query_id", "chunk_id", "token")


def _scores(spark, sf, queries):
    chunks, idf = chunk_index(spark, sf)
    return bm25.all_scores(chunks, queries, idf, posting_index(spark, sf))


@query("ag_bm25_score", f"""WITH {S.BM25}
SELECT query_id, chunk_id, round(score, 6) AS score, matched FROM bm25_all""")
def ag_bm25_score(spark, sf):
    return _scores(spark, sf, bench_queries(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), _joined("matched_terms").alias("matched"))


def _bm25_top(spark, sf, k=10):
    chunks, idf = chunk_index(spark, sf)
    return bm25.bm25_search(chunks, bench_queries(spark, sf), k, idf, posting_index(spark, sf))


_TOP = "SELECT query_id, rank, file, start_line, end_line, chunk_id, round(score, 6) AS score, matched FROM "


def _top_columns(df):
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), "file", "start_line", "end_line",
                     "chunk_id", F.round("score", 6).alias("score"), _joined("matched_terms").alias("matched"))


@query("pl_bm25_search", f"WITH {S.BM25} {_TOP} bm25_top")
def pl_bm25_search(spark, sf):
    return _top_columns(_bm25_top(spark, sf))


@query("win_topk", f"""WITH {S.BM25}
SELECT query_id, rank, chunk_id FROM bm25_top WHERE rank <= 5""")
def win_topk(spark, sf):
    return _bm25_top(spark, sf, 5).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id")


@query("srt_hits", f"""WITH {S.BM25}
SELECT b.query_id, c.file, c.start_line, chunk_id, round(b.score, 6) AS score FROM bm25_all b JOIN chunks c USING (chunk_id)
QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, c.file, c.start_line, chunk_id) <= 25
ORDER BY b.query_id, b.score DESC, c.file, c.start_line, chunk_id""")
def srt_hits(spark, sf):
    return _bm25_top(spark, sf, 25).orderBy("query_id", "rank").select(
        "query_id", "file", "start_line", "chunk_id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------- lexical
_RAW_TERMS = r"""raw_terms AS (
  SELECT DISTINCT query_id, term, CASE
      WHEN regexp_full_match(term, '@[A-Z][A-Za-z0-9_]*') THEN 'annotation'
      WHEN regexp_full_match(term, '[A-Z][A-Za-z0-9_]*Exception') THEN 'exception'
      WHEN regexp_full_match(term, '[A-Z][A-Za-z0-9_]*') THEN 'class'
      WHEN regexp_full_match(term, '[a-z][a-zA-Z0-9_]*[A-Z][a-zA-Z0-9_]*') THEN 'method'
      WHEN length(term) BETWEEN 2 AND 64 THEN 'plain' END AS kind
  FROM (SELECT item_id AS query_id, unnest(string_split_regex(trim(text), '\s+')) AS term FROM benchmark)),
weighted_terms AS (
  SELECT query_id, term, kind, CASE WHEN kind = 'annotation' THEN term[2:] ELSE term END AS needle,
         CASE kind WHEN 'annotation' THEN 2.5 WHEN 'exception' THEN 3.0 WHEN 'class' THEN 2.0
              WHEN 'method' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM raw_terms WHERE kind IS NOT NULL)"""


@query("fn_classify_terms", f"WITH {_RAW_TERMS} SELECT query_id, term, kind, weight FROM weighted_terms")
def fn_classify_terms(spark, sf):
    return lexical.classified_terms(bench_queries(spark, sf)).select("query_id", "term", "kind", "weight")


@query("jn_substring", f"""WITH {S.LINES}, {_RAW_TERMS}
SELECT DISTINCT file, line_no, needle FROM file_lines JOIN (SELECT DISTINCT needle FROM weighted_terms)
ON contains(line, needle)""")
def jn_substring(spark, sf):
    terms = lexical.classified_terms(bench_queries(spark, sf))
    return lexical.needle_lines(line_index(spark, sf, lexical.NON_BLANK_RUN), terms).drop("repo")


_SCORED = f"""WITH {S.LINES}, {_RAW_TERMS}, scored AS (
  SELECT query_id, file, line_no, sum(weight) AS score,
         array_to_string(list_sort(list_distinct(list(term))), ' ') AS terms
  FROM file_lines JOIN weighted_terms ON contains(line, needle) GROUP BY 1, 2, 3)"""


@query("win_first_n", _SCORED + """ SELECT query_id, file, line_no, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id, file ORDER BY line_no) <= 100""")
def win_first_n(spark, sf):
    terms = lexical.classified_terms(bench_queries(spark, sf))
    return lexical.scored_lines(line_index(spark, sf, lexical.NON_BLANK_RUN), terms, 100).select("query_id", "file", "line_no", "score")


@query("srt_line_hits", _SCORED + """
SELECT query_id, rank, file, line_no, score, terms FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, file, line_no) AS rank FROM scored) WHERE rank <= 10""")
def srt_line_hits(spark, sf):
    return lexical.search_lines(doc_files(spark, sf), bench_queries(spark, sf), index=line_index(spark, sf, lexical.NON_BLANK_RUN)).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "file", "line_no", "score",
        _joined("terms").alias("terms"))


@query("ag_lexical_file", _SCORED + """
SELECT query_id, file, sum(score) AS score, min(line_no) AS start_line, max(line_no) AS end_line
FROM scored GROUP BY 1, 2""")
def ag_lexical_file(spark, sf):
    terms = lexical.classified_terms(bench_queries(spark, sf))
    return lexical.file_totals(line_index(spark, sf, lexical.NON_BLANK_RUN), terms).select("query_id", "file", "score", "start_line", "end_line")


def _lexical_top(spark, sf, k=10):
    return lexical.lexical_search(
        doc_files(spark, sf), lexical.normal_query_terms(bench_queries(spark, sf)), k, lexical.NORMAL_RUN,
        index=line_index(spark, sf, lexical.NORMAL_RUN))


@query("pl_lexical_search", f"WITH {S.LINES}, {S.QUERY_TERMS}, {S.LEXICAL} {_TOP} lex_top")
def pl_lexical_search(spark, sf):
    return _top_columns(_lexical_top(spark, sf))


# -------------------------------------------------------------------- fusion
def _channels(spark, sf):
    return {"baseline": _lexical_top(spark, sf), "bm25": _bm25_top(spark, sf)}


_FILE_LINES = S.LINES.split("file_lines AS", 1)[1]
_BOTH = f"""WITH {S.BM25}, file_lines AS {_FILE_LINES}, {S.LEXICAL}, both_channels AS (
  SELECT query_id, chunk_id, file, start_line, end_line, rank, matched, 'baseline' AS channel, 0 AS channel_no FROM lex_top
  UNION ALL
  SELECT query_id, chunk_id, file, start_line, end_line, rank, matched, 'bm25', 1 FROM bm25_top)"""
_FUSED = _BOTH + """, fused AS (
  SELECT query_id, chunk_id, any_value(file) AS file, any_value(start_line) AS start_line,
         any_value(end_line) AS end_line, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score,
         string_agg(channel, ' ' ORDER BY channel_no) AS sources
  FROM both_channels GROUP BY 1, 2)"""


@query("set_union_channels", _BOTH + " SELECT query_id, channel, rank, chunk_id, file FROM both_channels")
def set_union_channels(spark, sf):
    return fusion.union_channels(_channels(spark, sf)).select(
        "query_id", "channel", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "file")


@query("ag_rrf", _FUSED + " SELECT query_id, chunk_id, file, start_line, end_line, round(score, 9) AS score, sources FROM fused")
def ag_rrf(spark, sf):
    return fusion.rrf(fusion.union_channels(_channels(spark, sf))).select(
        "query_id", "chunk_id", "file", "start_line", "end_line", F.round("score", 9).alias("score"),
        _joined("sources").alias("sources"))


@query("ext_channel", _BOTH + """, extra AS (
  SELECT * FROM both_channels UNION ALL
  SELECT query_id, chunk_id, file, start_line, end_line, rank, matched, 'custom', 2 FROM bm25_top WHERE rank <= 3)
SELECT query_id, chunk_id, round(sum(CASE channel WHEN 'bm25' THEN 0.5 ELSE 1.0 END::DOUBLE / (10 + rank)), 9) AS score,
       string_agg(channel, ' ' ORDER BY channel_no) AS sources FROM extra GROUP BY 1, 2""")
def ext_channel(spark, sf):
    channels = _channels(spark, sf)
    channels["bm25"] = materialize(channels["bm25"], "channel-bm25")  # read twice
    channels["custom"] = channels["bm25"].where(F.col("rank") <= 3)
    fused = fusion.rrf(fusion.union_channels(channels), k=10, weights={"bm25": 0.5})
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), _joined("sources").alias("sources"))
