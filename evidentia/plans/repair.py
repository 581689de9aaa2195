"""Queries over evidence ranges and proposed edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.operators import edits as ed
from evidentia.operators import intervals, java
from evidentia.plans import sqltext as S
from evidentia.plans.code import _PATHS, _paths
from evidentia.plans.derive import (
    case_refs, case_snippets, code_cases, code_evidence, doc_files, proposed_edits,
)
from evidentia.plans.registry import query
from evidentia.session import table


def _big(name):
    return F.col(name).cast("bigint").alias(name)


def _blank(name):
    return F.coalesce(name, F.lit("")).alias(name)


# ------------------------------------------------------------------ evidence
_EVIDENCE = f"""WITH {S.CASES}, wide AS (
  SELECT case_id, file, max(struct_pack(w := end_line - start_line, r := -rank, s := start_line, e := end_line)) AS x
  FROM snippets GROUP BY 1, 2),
verdict AS (
  SELECT r.*, CASE WHEN x IS NULL THEN 'file_not_in_retrieved_snippets'
      WHEN r.start_line > r.end_line THEN 'start_line_greater_than_end_line'
      WHEN NOT EXISTS (SELECT 1 FROM snippets s WHERE s.case_id = r.case_id AND s.file = r.file
                       AND r.start_line >= s.start_line AND r.end_line <= s.end_line) THEN 'line_range_outside_snippet'
    END AS reason, x.s AS ws, x.e AS we
  FROM refs r LEFT JOIN wide USING (case_id, file))"""


@query("jn_evidence_containment", _EVIDENCE + """
SELECT case_id, candidate_index, evidence_index, file, start_line, end_line, coalesce(reason, 'kept') AS reason,
  CASE WHEN reason = 'line_range_outside_snippet' THEN ws END AS widest_start,
  CASE WHEN reason = 'line_range_outside_snippet' THEN we END AS widest_end FROM verdict
UNION ALL SELECT case_id, candidate_index, -1, '', NULL, NULL, 'candidate_no_valid_evidence', NULL, NULL
FROM verdict GROUP BY case_id, candidate_index HAVING count(*) FILTER (reason IS NULL) = 0""")
def jn_evidence_containment(spark, sf):
    return intervals.check_evidence(case_refs(spark, sf), case_snippets(spark, sf)).withColumn(
        "reason", F.coalesce("reason", F.lit("kept")))


@query("jn_target_status", f"""WITH {S.CASES}
SELECT t.case_id, t.file, t.rank, CASE
  WHEN EXISTS (SELECT 1 FROM refs e WHERE e.case_id = t.case_id AND e.file = t.file
               AND e.start_line >= t.start_line AND e.end_line <= t.end_line) THEN 'exact_containment'
  WHEN EXISTS (SELECT 1 FROM refs e WHERE e.case_id = t.case_id AND e.file = t.file
               AND e.start_line <= t.end_line AND t.start_line <= e.end_line) THEN 'overlap_only'
  ELSE 'miss' END AS status FROM snippets t""")
def jn_target_status(spark, sf):
    return intervals.target_status(case_snippets(spark, sf), case_refs(spark, sf)).select(
        "case_id", "file", "rank", "status")


@query("jn_edit_evidence", f"""WITH {S.CASES}
SELECT r.case_id, r.evidence_index, EXISTS (SELECT 1 FROM snippets s WHERE s.case_id = r.case_id AND s.file = r.file
  AND r.start_line <= s.end_line AND s.start_line <= r.end_line) AS supported FROM refs r WHERE r.start_line <= r.end_line""")
def jn_edit_evidence(spark, sf):
    refs = case_refs(spark, sf).where("start_line <= end_line")
    return intervals.with_overlap(refs, case_snippets(spark, sf), ["case_id", "file"], "supported").select(
        "case_id", "evidence_index", "supported")


@query("win_first_rank", f"""WITH {S.CASES}, w AS (
  SELECT case_id, file, min(rank) AS first_rank,
    max(struct_pack(w := end_line - start_line, r := -rank, s := start_line, e := end_line)) AS x FROM snippets GROUP BY 1, 2)
SELECT case_id, file, first_rank, x.s AS widest_start, x.e AS widest_end FROM w""")
def win_first_rank(spark, sf):
    w = case_snippets(spark, sf).groupBy("case_id", "file").agg(
        F.min("rank").alias("first_rank"),
        F.max(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), (-F.col("rank")).alias("r"),
                       "start_line", "end_line")).alias("x"))
    return w.select("case_id", "file", "first_rank", F.col("x.start_line").alias("widest_start"),
                    F.col("x.end_line").alias("widest_end"))


_GATE_RANGES = [(8, 9), (10, 12), (18, 30), (9, 8), (18, 20)]


@query("jn_evidence_gate", f"""WITH {S.CODE}, gate AS (
  SELECT doc_id AS case_id, file, ls, unnest([8, 10, 18, 9, 18, 8]) AS s, unnest([9, 12, 30, 8, 20, 9]) AS e FROM code),
kept AS (SELECT DISTINCT case_id, file, s, e, array_to_string(ls[s:e], chr(10)) AS body FROM gate
  WHERE s <= e AND ((s >= 8 AND e <= 11) OR (s >= 18 AND e <= 25)))
SELECT case_id, file, s AS start_line, e AS end_line, md5(body) AS digest FROM kept WHERE length(body) >= 1""")
def jn_evidence_gate(spark, sf):
    ranges = F.array(*[F.struct(F.lit(s).cast("bigint").alias("start_line"), F.lit(e).cast("bigint").alias("end_line"))
                       for s, e in [*_GATE_RANGES, (8, 9)]])
    refs = code_cases(spark, sf).select("case_id", "file", F.posexplode(ranges).alias("evidence_index", "r")).select(
        "case_id", "file", "evidence_index", (F.col("evidence_index") % 3).alias("candidate_index"), "r.*")
    kept = ed.validated_evidence(refs, code_evidence(spark, sf), code_cases(spark, sf))
    return kept.select("case_id", "file", "start_line", "end_line", F.md5("content").alias("digest"))


# --------------------------------------------------------------------- slices
@query("prj_line_slice", f"""WITH {S.LINES}, sl AS (
  SELECT doc_id, ls, len(ls) AS total, least((doc_id * 3) % 50, len(ls)) AS s,
    CASE WHEN (doc_id * 3) % 50 + doc_id % 90 > len(ls) THEN len(ls) ELSE (doc_id * 3) % 50 + doc_id % 90 END AS e
  FROM (SELECT doc_id, {S.lines('content')} AS ls FROM files)),
cut AS (SELECT doc_id, total, s, greatest(e - s, 0) AS asked, least(greatest(e - s, 0), 60) AS got,
  array_to_string(ls[s + 1 : s + least(greatest(e - s, 0), 60)], chr(10)) AS body FROM sl)
SELECT doc_id, total AS total_lines, s + 1 AS first_line, s + got AS last_line, asked > 60 OR length(body) > 4000 AS truncated,
  md5(CASE WHEN length(body) > 4000 THEN regexp_replace(left(body, 4000), '(?s)^(.+)\\n[^\\n]*$', '\\1') ELSE body END) AS digest
FROM cut""")
def prj_line_slice(spark, sf):
    from evidentia.operators.corpus import line_slice

    d = doc_files(spark, sf)
    start = (F.col("doc_id") * 3) % 50
    return line_slice(d, F.col("content"), start, start + F.col("doc_id") % 90).select(
        "doc_id", "total_lines", "first_line", "last_line", "truncated", F.md5("body").alias("digest"))


# ------------------------------------------------------------- path and code rules
@query("flt_patch_path", f"""WITH {_PATHS}, p AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '/' || file
    WHEN doc_id % 19 = 0 THEN replace(file, '/', '\\') ELSE file END AS f FROM paths),
q AS (SELECT doc_id, replace(f, '\\', '/') AS f FROM p)
SELECT doc_id, CASE WHEN f NOT LIKE '/%' AND NOT regexp_matches(f, '^[A-Za-z]:/')
  AND len(list_intersect(string_split(f, '/'), ['..', '.git', 'benchmark', 'target', 'artifacts'])) = 0
  AND len(list_filter(string_split(f, '/'), lambda x: x = '.env' OR x LIKE '.env.%')) = 0
  AND lower(f) NOT LIKE '%.md' AND NOT contains('/' || f || '/', '/src/test/')
  AND regexp_matches(lower(f), '^src/main/(java|resources)/') THEN 'allowed' ELSE 'path_not_allowed' END AS verdict FROM q""")
def flt_patch_path(spark, sf):
    f = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("/"), "file")).when(
        F.col("doc_id") % 19 == 0, F.replace("file", F.lit("/"), F.lit("\\"))).otherwise(F.col("file"))
    return _paths(spark, sf).select(
        "doc_id", F.when(ed.path_allowed(f), "allowed").otherwise("path_not_allowed").alias("verdict"))


def _re2(p):
    return p.replace("'", "''")


_DANGER = " , ".join(f"CASE WHEN regexp_matches(text, '{_re2(p)}') THEN '{n}' END" for n, p in V.DANGEROUS_CODE)


@query("flt_dangerous_code", f"""SELECT doc_id, array_to_string(list_filter([{_DANGER}], lambda x: x IS NOT NULL), ' ') AS families
FROM documents""")
def flt_dangerous_code(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(ed.dangerous_families(F.col("text")), " ").alias("families"))


@query("flt_sensitive_diff", f"""SELECT doc_id, regexp_matches(text, '{_re2(V.SENSITIVE_DIFF)}')
  OR regexp_matches(text, '(?i)(^|[^a-z0-9_])[a-z]:[\\\\/]([^\\\\/\\s]|$)') AS sensitive FROM documents""")
def flt_sensitive_diff(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ed.is_sensitive_diff(F.col("text")).alias("sensitive"))


@query("fn_path_norm", f"""WITH {_PATHS} SELECT doc_id, lower(trim(replace(' ' || replace(file, '/', '\\') || ' ', '\\', '/'))) AS path
FROM paths""")
def fn_path_norm(spark, sf):
    raw = F.concat(F.lit(" "), F.replace("file", F.lit("/"), F.lit("\\")), F.lit(" "))
    return _paths(spark, sf).select("doc_id", tx.gold_path(raw).alias("path"))


@query("fn_newline_canon", """SELECT doc_id, md5(replace(replace(replace(text, chr(10), chr(13) || chr(10)),
  chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents""")
def fn_newline_canon(spark, sf):
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.canonical_newlines(crlf)).alias("digest"))


# ----------------------------------------------------------------- validation
def _validated(spark, sf):
    return ed.validate_edits(proposed_edits(spark, sf), code_cases(spark, sf), code_evidence(spark, sf))


_V = f"WITH {S.VERDICTS} "


@query("pl_validate_proposal", _V + """
SELECT case_id, edit_index, file, coalesce(reason, '') AS reason, coalesce(symbol, '') AS symbol FROM verdicts""")
def pl_validate_proposal(spark, sf):
    return _validated(spark, sf)[0].select("case_id", "edit_index", "file", _blank("reason"), _blank("symbol"))


_SUMMARY = _V + """, summary AS (
  SELECT case_id, count(*) AS original_edits, count(*) FILTER (reason IS NULL) AS accepted_edits,
    count(*) FILTER (reason IS NOT NULL) AS rejected_edits,
    CASE WHEN bool_or(coalesce(reason, '') = 'dangerous_new_code') THEN 'unsafe_to_propose'
         WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'proposed' ELSE 'insufficient_evidence' END AS status
  FROM verdicts GROUP BY 1)"""


@query("pl_proposal_summary", _SUMMARY + """
SELECT *, status = 'proposed' AND rejected_edits = 0 AS passed FROM summary""")
def pl_proposal_summary(spark, sf):
    return ed.proposal_summary(_validated(spark, sf)[0])


@query("jn_edit_import", _V + """
SELECT case_id, edit_index, coalesce(reason, '') AS reason FROM verdicts
WHERE edit_index IN (0, 1) AND case_id % 7 <> 0""")
def jn_edit_import(spark, sf):
    v = _validated(spark, sf)[0]
    imports = v.where(java.is_import_only(F.col("new_code")) | F.contains("new_code", F.lit(".add(")))
    first = imports.where("edit_index in (0, 1) and proposal_status = 'proposed'")
    return first.select("case_id", "edit_index", _blank("reason"))


@query("pl_import_check", f"""WITH {S.CODE}
SELECT doc_id AS case_id, file, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'TextHelper' END AS introduced,
  CASE WHEN doc_id % 3 = 0 THEN 'TextHelper' ELSE '' END AS resolved,
  CASE WHEN doc_id % 3 = 2 THEN 'TextHelper' ELSE '' END AS unresolved,
  CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'unknown' ELSE 'fail' END AS status
FROM code WHERE doc_id % 7 <> 0""")
def pl_import_check(spark, sf):
    checks = _validated(spark, sf)[1]
    return checks.select("case_id", "file", *[F.array_join(c, " ").alias(c) for c in ("introduced", "resolved", "unresolved")],
                         "status")


@query("jn_edit_source", _V + """
SELECT case_id, edit_index, NOT (edit_index = 3 OR edit_index = 6) AS matches,
  edit_index <> 6 AS in_range FROM edit_rows WHERE edit_index NOT IN (5, 8)""")
def jn_edit_source(spark, sf):
    e = proposed_edits(spark, sf).join(code_cases(spark, sf).select("case_id", "file", "content"), ["case_id", "file"])
    lines = tx.code_lines(F.col("content"))
    return e.select(
        "case_id", "edit_index",
        ed.same_code(ed.code_slice(lines, F.col("start_line"), F.col("end_line")), F.col("old_code")).alias("matches"),
        (F.col("end_line") <= F.size(lines)).alias("in_range"))


@query("jn_edit_conflict_first", _V + """
SELECT case_id, edit_index, CASE WHEN edit_index = 2 THEN 'conflicting_edit' WHEN edit_index = 7 THEN 'duplicate_edit'
  ELSE '' END AS conflict FROM verdicts WHERE edit_index IN (0, 1, 2, 7) AND case_id % 7 <> 0""")
def jn_edit_conflict_first(spark, sf):
    rows = ed.checked_edits(proposed_edits(spark, sf), code_cases(spark, sf), code_evidence(spark, sf))
    folded = rows.select("case_id", F.explode(ed.greedy_conflicts(F.col("_judged"))).alias("e"))
    clean = folded.where("e.reason is null or e.reason in ('conflicting_edit', 'duplicate_edit')")
    return clean.select("case_id", "e.edit_index", F.coalesce("e.reason", F.lit("")).alias("conflict"))


@query("jn_edit_conflict_pair", _V + """
SELECT case_id, edit_index, CASE
    WHEN edit_index = 5 THEN 'path_not_allowed' WHEN edit_index = 8 THEN 'new_file_not_supported'
    WHEN edit_index = 3 THEN 'stale_patch' WHEN edit_index = 6 THEN 'invalid_range'
    WHEN edit_index = 4 AND NOT five THEN 'empty_or_unchanged_edit'
    WHEN edit_index = 0 AND case_id % 4 <> 0 THEN 'conflicting_edit'
    WHEN edit_index = 2 THEN 'conflicting_edit'
    WHEN edit_index = 7 THEN CASE WHEN three = 1 THEN 'duplicate_edit' ELSE 'conflicting_edit' END
    ELSE '' END AS failure FROM edit_rows""")
def jn_edit_conflict_pair(spark, sf):
    rows = ed.preflight(proposed_edits(spark, sf), code_cases(spark, sf))
    return rows.select("case_id", F.explode("_edits").alias("e")).select(
        "case_id", "e.edit_index", F.coalesce("e.failure", F.lit("")).alias("failure"))


# ---------------------------------------------------------------- application
def _applied(spark, sf):
    verdicts, _ = _validated(spark, sf)
    return ed.apply_edits(ed.passed_edits(verdicts), code_cases(spark, sf))


# A whole proposal passes when it consists of the first edits only and they hold.
_APPLIED = f"""WITH {S.CODE}, base AS (
  SELECT *, doc_id AS case_id, doc_id % 3 = 0 AS adds FROM code WHERE doc_id % 7 <> 0 AND doc_id % 4 = 0 AND doc_id % 3 = 0),
done AS (
  SELECT *, list_concat(ls[1:3], ['import com.acme.util.TextHelper;'], ls[4:19], ['        text.add(TextHelper.of(key));'],
    ls[21:]) AS new_ls,
    '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -1,6 +1,7 @@' || chr(10)
    || array_to_string(list_transform(ls[1:3], lambda x: ' ' || x), chr(10)) || chr(10) || '+import com.acme.util.TextHelper;' || chr(10)
    || array_to_string(list_transform(ls[4:6], lambda x: ' ' || x), chr(10)) || chr(10) || '@@ -17,7 +18,7 @@' || chr(10)
    || array_to_string(list_transform(ls[17:19], lambda x: ' ' || x), chr(10)) || chr(10) || '-' || ls[20] || chr(10)
    || '+        text.add(TextHelper.of(key));' || chr(10)
    || array_to_string(list_transform(ls[21:23], lambda x: ' ' || x), chr(10)) || chr(10) AS diff
  FROM base),
safe AS (SELECT *, regexp_matches(diff, '{_re2(V.SENSITIVE_DIFF)}') AS unsafe FROM done)"""


@query("pl_apply_edits", _APPLIED + """
SELECT case_id, file, CASE WHEN unsafe THEN 'rejected' ELSE 'applied' END AS status,
  CASE WHEN unsafe THEN 'unsafe_diff' ELSE '' END AS error,
  CASE WHEN unsafe THEN '' ELSE md5(array_to_string(new_ls, chr(10)) || chr(10)) END AS digest FROM safe""")
def pl_apply_edits(spark, sf):
    return _applied(spark, sf).select(
        "case_id", "file", "status", _blank("error"), F.coalesce(F.md5("content"), F.lit("")).alias("digest"))


@query("pl_unified_diff", _APPLIED + " SELECT case_id, file, md5(diff) AS diff_digest FROM safe WHERE NOT unsafe")
def pl_unified_diff(spark, sf):
    return _applied(spark, sf).where("status = 'applied'").select("case_id", "file", F.md5("diff").alias("diff_digest"))


@query("src_unified_patch", _APPLIED + """ SELECT case_id, file, 'a/' || file || ' b/' || file AS touched, 1 AS removed, 2 AS added,
  2 AS logical_changes FROM safe WHERE NOT unsafe""")
def src_unified_patch(spark, sf):
    from evidentia.sources.patches import patch_stats

    a = _applied(spark, sf).where("status = 'applied'")
    git = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n"), "diff")
    stats = patch_stats(a.select("case_id", "file", git.alias("patch")), "case_id", "file")
    return stats.select("case_id", "file",
                        F.concat_ws(" ", F.concat(F.lit("a/"), F.element_at("paths", 1)), F.concat(F.lit("b/"), F.element_at("paths", 1)))
                        .alias("touched"), "removed", "added", "logical_changes")


@query("set_subset", _APPLIED + """ SELECT case_id, doc_id % 2 = 0 AS within FROM safe WHERE NOT unsafe""")
def set_subset(spark, sf):
    changed = _applied(spark, sf).where("changed").groupBy("case_id").agg(F.collect_set("file").alias("changed"))
    # every second case accepts the changed file, the others another one
    accepted = code_cases(spark, sf).select(
        "case_id", F.array(F.when(F.col("doc_id") % 2 == 0, F.col("file")).otherwise(F.lit("pom.xml"))).alias("accepted"))
    return changed.join(accepted, "case_id").select(
        "case_id", (F.size(F.array_except("changed", "accepted")) == 0).alias("within"))
