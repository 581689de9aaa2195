"""SQL fragments shared by the reference queries (DuckDB dialect)."""

from __future__ import annotations

from evidentia.functions import values as V

BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def lines(col: str) -> str:
    """List of lines without a final empty one."""
    s = f"string_split_regex({col}, '{BREAK}')"
    return f"(CASE WHEN {s}[-1] = '' THEN {s}[1:len({s})-1] ELSE {s} END)"


def plain_tokens(col: str) -> str:
    spaced = (
        f"regexp_replace(regexp_replace({col}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), "
        "'([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    )
    return f"regexp_extract_all(lower(regexp_replace({spaced}, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]{{2,}}')"


STOP = in_list(V.STOP_WORDS)

# Documents as files of one corpus, benchmark items as queries on it.
FILES = """
files AS (
  SELECT 'corpus' AS repo, 'docs/d' || lpad(doc_id::VARCHAR, 9, '0') || '.yml' AS file,
         text AS content, doc_id
  FROM documents)"""

LINES = FILES + f""",
file_lines AS (
  SELECT repo, file, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
  FROM (SELECT repo, file, doc_id, {lines('content')} AS ls FROM files))"""

WINDOWS = FILES + f""",
win_lines AS (SELECT repo, file, doc_id, {lines('content')} AS ls FROM files),
win_starts AS (
  SELECT *, unnest(range(0, greatest(ceil((len(ls) - 40) / 35.0) * 35, 0)::BIGINT + 1, 35)) AS st
  FROM win_lines WHERE len(ls) > 0),
win_body AS (
  SELECT repo, file, doc_id, st + 1 AS start_line, least(st + 40, len(ls)) AS end_line,
         array_to_string(ls[st+1 : st+40], chr(10)) AS body
  FROM win_starts),
chunks AS (
  SELECT repo, file, doc_id, start_line, end_line,
         body AS content,
         left(sha256(file || ':config_block::' || start_line || ':' || end_line), 16) AS chunk_id
  FROM win_body)"""

TOKENS = f"""
idents AS (
  SELECT chunk_id, unnest(ids) AS ident, generate_subscripts(ids, 1) AS p1
  FROM (SELECT chunk_id, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*') AS ids FROM chunks)),
ident_parts AS (
  SELECT chunk_id, p1, unnest(ps) AS token, generate_subscripts(ps, 1) AS p2
  FROM (SELECT chunk_id, p1, list_concat({plain_tokens('ident')},
               CASE WHEN length(ident) >= 2 THEN [lower(ident)] ELSE [] END) AS ps FROM idents)),
first_seen AS (
  SELECT chunk_id, token, min(p1 * 1000 + p2) AS pos FROM ident_parts
  WHERE token NOT IN {STOP} GROUP BY ALL),
chunk_tokens AS (
  SELECT chunk_id, token, pos, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS tok_no
  FROM first_seen)"""
CHUNK_TOKENS = WINDOWS + "," + TOKENS

QUERY_TERMS = f"""
query_idents AS (
  SELECT item_id AS query_id, unnest(ids) AS ident, generate_subscripts(ids, 1) AS p1
  FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3) AS ids
        FROM benchmark)),
query_parts AS (
  SELECT query_id, p1, unnest(ps) AS token, generate_subscripts(ps, 1) AS p2
  FROM (SELECT query_id, p1, {plain_tokens('ident')} AS ps FROM query_idents)),
query_first AS (
  SELECT query_id, token, min(p1 * 1000 + p2) AS pos FROM query_parts WHERE token NOT IN {STOP} GROUP BY ALL),
query_terms AS (
  SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS term_no
  FROM query_first)"""

BM25 = CHUNK_TOKENS + "," + QUERY_TERMS + """,
chunk_len AS (SELECT chunk_id, count(*) AS dl FROM chunk_tokens GROUP BY 1),
corpus_size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM chunk_len),
dfs AS (SELECT token, count(*) AS df FROM chunk_tokens GROUP BY 1),
raw_idf AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, corpus_size),
idfs AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw_idf) ELSE r END AS idf FROM raw_idf),
bm25_all AS (
  SELECT q.query_id, t.chunk_id,
         round(sum(idf * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score,
         string_agg(t.token, ' ' ORDER BY q.term_no) AS matched
  FROM query_terms q JOIN chunk_tokens t USING (token) JOIN idfs USING (token)
  JOIN chunk_len USING (chunk_id), corpus_size GROUP BY 1, 2 HAVING score > 0),
bm25_top AS (
  SELECT b.query_id, c.repo, c.file, c.start_line, c.end_line, b.chunk_id, b.score, b.matched,
         row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, c.file, c.start_line, b.chunk_id) AS rank
  FROM bm25_all b JOIN chunks c USING (chunk_id) QUALIFY rank <= 10)"""

LEXICAL = """
lex_pairs AS (
  SELECT q.query_id, l.file, l.line_no, count(*) AS score, list(q.token) AS terms
  FROM file_lines l JOIN query_terms q ON contains(l.line, q.token) GROUP BY 1, 2, 3),
lex_files AS (
  SELECT query_id, file, sum(score)::DOUBLE AS score, min(line_no) AS start_line, max(line_no) AS end_line,
         array_to_string(list_sort(list_distinct(flatten(list(terms)))), ' ') AS matched
  FROM lex_pairs GROUP BY 1, 2),
lex_top AS (
  SELECT *, left(sha256(file || ':file_window::' || start_line || ':' || end_line), 16) AS chunk_id,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file, start_line) AS rank
  FROM lex_files QUALIFY rank <= 10)"""


def capital(word: str, default: str) -> str:
    w = f"coalesce({word}, '{default}')"
    return f"(upper({w}[1]) || lower({w}[2:]))"


_FOUND = "regexp_extract_all(text, '[A-Za-z]{3,}')"

# Documents as source files; ``n`` statements between fixed first and last lines.
CODE = f"""
code_base AS (
  SELECT doc_id, source AS repo, {lines('text')} AS body,
         'src/main/java/com/acme/' || source || '/D' || lpad(doc_id::VARCHAR, 9, '0') || '.java' AS file,
         {capital(_FOUND + '[1]', 'alpha')} || 'Service' AS cls,
         {capital(_FOUND + '[2]', 'beta')} || 'Repository' AS dep,
         'find' || {capital(_FOUND + '[3]', 'gamma')} AS method
  FROM documents),
code_clean AS (
  SELECT *, len(body) AS n, list_transform(body, lambda x: regexp_replace(x, '[^A-Za-z0-9 ]', '', 'g')) AS stm
  FROM code_base),
code AS (
  SELECT *, list_concat(
    ['package com.acme.' || repo || ';', '', 'import java.util.List;', 'import com.acme.store.' || dep || ';', '',
     '@Service', 'public class ' || cls || ' {{', '    private final ' || dep || ' repo;', '',
     '    public ' || cls || '(' || dep || ' repo) {{', '        this.repo = repo;', '    }}', '', '    @Transactional',
     '    public List<String> ' || method || '(String key) {{', '        String open = "{{ not a brace";',
     '        /* block {{ comment', '           }} */', '        // line }} comment'],
    list_transform(stm, lambda x: '        text.add("' || x || '");'),
    ['        return repo.load(key);', '    }}', '}}']) AS ls
  FROM code_clean),
decls AS (
  SELECT repo, file, doc_id, ls, 'class' AS kind, cls AS name, 7 AS decl_line, 5 AS start_line, n + 22 AS end_line FROM code
  UNION ALL SELECT repo, file, doc_id, ls, 'constructor', cls, 10, 9, 12 FROM code
  UNION ALL SELECT repo, file, doc_id, ls, 'method', method, 15, 13, n + 21 FROM code)"""

SYMBOL_ROWS = """
symbol_rows AS (
  SELECT repo, file, n, 7 AS line, 'class' AS kind, cls AS name, n + 22 AS block_end FROM code
  UNION ALL SELECT repo, file, n, 6, 'annotation', 'Service', least(n + 22, 36) FROM code
  UNION ALL SELECT repo, file, n, 14, 'annotation', 'Transactional', least(n + 22, 44) FROM code
  UNION ALL SELECT repo, file, n, 15, 'method', method, n + 21 FROM code)"""

SYMBOL_QUERIES = f"""
symbol_queries AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo,
         unnest([{capital(_FOUND + '[1]', 'alpha')} || 'Service', 'find' || {capital(_FOUND + '[2]', 'beta')},
                 'Transactional']) AS symbol,
         unnest([0, 1, 2]) AS symbol_no
  FROM benchmark)"""

# Chunks of the declarations: long blocks become windows of at most 60 lines that overlap by five.
DECL_CHUNKS = CODE + """,
spans AS (
  SELECT *, start_line - 1 AS s, end_line - 1 AS e, end_line - start_line + 1 > 60 AS is_long FROM decls),
wins_end AS (
  SELECT repo, file, kind, name, ls, w, s + w * 55 AS cur, least(s + w * 55 + 59, e) AS we
  FROM (SELECT *, unnest(range(0, greatest(ceil((e - s - 59) / 55.0), 0)::BIGINT + 1)) AS w FROM spans WHERE is_long)),
decl_chunks AS (
  SELECT repo, file, kind AS chunk_type, name AS symbol_name, name AS id_symbol, start_line, end_line,
         array_to_string(ls[start_line:end_line], chr(10)) AS content FROM spans WHERE NOT is_long
  UNION ALL
  SELECT repo, file, kind, name, name || '_w' || w, cur + 1, we + 1, array_to_string(ls[cur+1 : we+1], chr(10)) FROM wins_end)"""

# Documents and the code derived from them in one repository per source; items search the code
# and text of their repository through three channels.
MIXED = DECL_CHUNKS + "," + SYMBOL_ROWS + "," + SYMBOL_QUERIES + f""",
mx AS (
  SELECT source AS repo, 'docs/d' || lpad(doc_id::VARCHAR, 9, '0') || '.yml' AS file, {lines('text')} AS ls FROM documents
  UNION ALL SELECT repo, file, ls FROM code),
mx_lines AS (SELECT repo, file, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM mx),
mx_starts AS (
  SELECT *, unnest(range(0, greatest(ceil((len(ls) - 40) / 35.0) * 35, 0)::BIGINT + 1, 35)) AS st FROM mx WHERE len(ls) > 0 AND suffix(file, '.yml')),
chunks AS (
  SELECT repo, file, st + 1 AS start_line, least(st + 40, len(ls)) AS end_line, array_to_string(ls[st+1 : st+40], chr(10)) AS content,
         left(sha256(file || ':config_block::' || (st + 1) || ':' || least(st + 40, len(ls))), 16) AS chunk_id FROM mx_starts
  UNION ALL
  SELECT repo, file, start_line, end_line, content,
         left(sha256(file || ':' || chunk_type || ':' || id_symbol || ':' || start_line || ':' || end_line), 16) FROM decl_chunks),""" + TOKENS + f""",
case_terms AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo,
    list_concat(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3),
      [{capital(_FOUND + '[1]', 'alpha')} || 'Service', 'find' || {capital(_FOUND + '[2]', 'beta')}, 'Transactional']) AS ts FROM benchmark),
case_parts AS (
  SELECT query_id, repo, p1, unnest(ps) AS token, generate_subscripts(ps, 1) AS p2 FROM (
    SELECT query_id, repo, p1, {plain_tokens('t')} AS ps FROM (SELECT query_id, repo, unnest(ts) AS t, generate_subscripts(ts, 1) AS p1 FROM case_terms))),
query_terms AS (
  SELECT query_id, repo, token, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS term_no
  FROM (SELECT query_id, repo, token, min(p1 * 1000 + p2) AS pos FROM case_parts WHERE token NOT IN {STOP} GROUP BY ALL)),
chunk_len AS (SELECT chunk_id, repo, count(*) AS dl FROM chunk_tokens JOIN chunks USING (chunk_id) GROUP BY 1, 2),
corpus_size AS (SELECT repo, count(*) AS n, avg(dl) AS avgdl FROM chunk_len GROUP BY 1),
dfs AS (SELECT repo, token, count(*) AS df FROM chunk_tokens JOIN chunk_len USING (chunk_id) GROUP BY 1, 2),
raw_idf AS (SELECT repo, token, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs JOIN corpus_size USING (repo)),
idfs AS (SELECT *, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY repo) ELSE r END AS idf FROM raw_idf),
bm25_all AS (
  SELECT q.query_id, t.chunk_id, round(sum(idf * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
  FROM query_terms q JOIN idfs i ON i.repo = q.repo AND i.token = q.token JOIN chunk_tokens t ON t.token = q.token
  JOIN chunk_len l ON l.chunk_id = t.chunk_id AND l.repo = q.repo GROUP BY 1, 2 HAVING score > 0),
bm25_top AS (
  SELECT b.query_id, c.file, c.start_line, c.end_line, b.chunk_id,
         row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, c.file, c.start_line, b.chunk_id) AS rank
  FROM bm25_all b JOIN chunks c USING (chunk_id) QUALIFY rank <= 10),
lex_files AS (
  SELECT q.query_id, l.file, count(*)::DOUBLE AS score, min(l.line_no) AS start_line, max(l.line_no) AS end_line
  FROM mx_lines l JOIN query_terms q ON l.repo = q.repo AND contains(l.line, q.token) GROUP BY 1, 2),
lex_top AS (
  SELECT *, left(sha256(file || ':file_window::' || start_line || ':' || end_line), 16) AS chunk_id,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file, start_line) AS rank FROM lex_files QUALIFY rank <= 10),
symbol_top AS (
  SELECT q.query_id, s.file, s.line AS start_line, block_end AS end_line,
         left(sha256(file || ':' || kind || ':' || symbol || ':' || line || ':' || block_end), 16) AS chunk_id,
         row_number() OVER (PARTITION BY q.query_id ORDER BY q.symbol_no, s.file, s.line, s.kind) AS rank
  FROM symbol_rows s JOIN symbol_queries q ON q.repo = s.repo AND q.symbol = s.name QUALIFY rank <= 10),
both_channels AS (
  SELECT query_id, chunk_id, file, start_line, end_line, rank, 'baseline' AS channel, 0 AS channel_no FROM lex_top
  UNION ALL SELECT query_id, chunk_id, file, start_line, end_line, rank, 'bm25', 1 FROM bm25_top
  UNION ALL SELECT query_id, chunk_id, file, start_line, end_line, rank, 'symbol', 2 FROM symbol_top),
fused AS (
  SELECT query_id, chunk_id, any_value(file) AS file, any_value(start_line) AS start_line, any_value(end_line) AS end_line,
         round(sum(CASE channel WHEN 'symbol' THEN 1.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 12) AS score,
         string_agg(channel, ' ' ORDER BY channel_no) AS sources FROM both_channels GROUP BY 1, 2)"""

CASES = f"""
doc_n AS (
  SELECT doc_id AS case_id, 'docs/d' || doc_id AS file, text, len(ls) AS n
  FROM (SELECT doc_id, text, {lines('text')} AS ls FROM documents) WHERE len(ls) > 0),
snippets AS (
  SELECT case_id, file, k + 1 AS rank, (case_id * 7 + k * 11) % n + 1 AS start_line,
         least((case_id * 7 + k * 11) % n + 1 + 5 + k * 3, n) AS end_line
  FROM doc_n, range(3) t(k)),
refs AS (
  SELECT case_id, j % 3 AS candidate_index, j AS evidence_index,
         CASE WHEN j = 5 THEN 'docs/none' ELSE file END AS file, (case_id * 5 + j * 9) % n + 1 AS start_line,
         (case_id * 5 + j * 9) % n + 1 + j * 2 - CASE WHEN j = 4 THEN 10 ELSE 0 END AS end_line
  FROM doc_n, range(6) t(j))"""

# What becomes of each derived edit, by construction.
VERDICTS = CODE + """,
edit_rows AS (
  SELECT doc_id AS case_id, file, i AS edit_index, doc_id % 7 = 0 AS idle, doc_id % 3 AS three, doc_id % 5 = 0 AS five
  FROM code, range(10) t(i)
  WHERE (i = 0) OR (i = 1 AND doc_id % 3 <> 2) OR (i > 1 AND doc_id % 4 <> 0)),
verdicts AS (
  SELECT case_id, edit_index,
    CASE edit_index WHEN 5 THEN 'src/test/java/T.java' WHEN 8 THEN 'src/main/java/Other.java' ELSE file END AS file,
    CASE WHEN edit_index = 5 THEN 'path_not_allowed' WHEN idle THEN 'proposal_not_proposed' ELSE
      CASE edit_index
        WHEN 0 THEN CASE WHEN three = 2 THEN 'missing_required_import' END
        WHEN 1 THEN CASE WHEN three = 1 THEN 'unrelated_import' END
        WHEN 2 THEN 'conflicting_edit' WHEN 3 THEN 'old_code_mismatch'
        WHEN 4 THEN CASE WHEN five THEN 'dangerous_new_code' ELSE 'empty_or_unchanged_edit' END
        WHEN 6 THEN 'line_range_invalid' WHEN 7 THEN 'duplicate_edit' WHEN 8 THEN 'file_not_in_validated_evidence'
        WHEN 9 THEN 'line_range_outside_evidence' END END AS reason,
    CASE WHEN edit_index = 0 AND three = 2 AND NOT idle THEN 'TextHelper' END AS symbol
  FROM edit_rows)"""

EXPECTED = r"""
expected AS (
  SELECT DISTINCT i.item_id AS query_id, 'docs/d' || lpad(d.doc_id::VARCHAR, 9, '0') || '.yml' AS file
  FROM (SELECT doc_id, source, unnest(string_split_regex(text, '[.\n]+\s*')) AS s FROM documents) d
  JOIN (SELECT item_id, 'src' || (item_id % 20) AS source, unnest(string_split_regex(text, '[.\n]+\s*')) AS s FROM benchmark) i USING (s, source)
  WHERE s <> '')"""


def merged(source: str, name: str) -> str:
    """Fold of the fused hits of each (query, file) into clusters of overlapping ranges."""
    inter = "greatest(0, least(c.e, x[1].e) - greatest(c.s, x[1].s) + 1)"
    shorter = "(least(c.e - c.s, x[1].e - x[1].s) + 1)"
    wide = "(x[1].e - x[1].s > c.e - c.s)"
    return f"""
{name}_lists AS (
  SELECT query_id, file, list([struct_pack(k := struct_pack(a := -score, f := file, b := start_line, c := chunk_id),
      id := chunk_id, s := start_line, e := end_line, score := score, src := string_split(sources, ' '))]
      ORDER BY score DESC, file, start_line, chunk_id) AS hs FROM {source} GROUP BY 1, 2),
{name}_fold AS (
  SELECT query_id, file, unnest(list_reduce(hs, lambda a, x:
    CASE WHEN list_contains(list_transform(a, lambda c: {inter} / {shorter} >= 0.5), true)
    THEN list_transform(a, lambda c, i: CASE
      WHEN i = list_position(list_transform(a, lambda c: {inter} / {shorter} >= 0.5), true)
      THEN struct_pack(k := c.k, id := CASE WHEN {wide} THEN x[1].id ELSE c.id END,
             s := CASE WHEN {wide} THEN x[1].s ELSE c.s END, e := CASE WHEN {wide} THEN x[1].e ELSE c.e END,
             score := greatest(c.score, x[1].score), src := list_concat(c.src, list_filter(x[1].src, lambda z: NOT list_contains(c.src, z))))
      ELSE c END)
    ELSE list_concat(a, x) END)) AS h FROM {name}_lists),
{name} AS (SELECT query_id, file, h.k AS hit_no, h.id AS chunk_id, h.s AS start_line, h.e AS end_line, h.score AS score,
  array_to_string(h.src, ' ') AS sources FROM {name}_fold)"""
