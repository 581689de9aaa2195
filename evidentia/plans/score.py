"""Scoring queries over results derived from events, cases and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import edits as ed
from evidentia.operators import intervals, scoring as sc
from evidentia.plans import sqltext as S
from evidentia.plans.derive import case_refs, case_snippets, code_cases, code_evidence, proposed_edits, through_files
from evidentia.plans.registry import query
from evidentia.session import table
from evidentia.sources import records

_MODS = [("baseline_verified", 13), ("diagnosis_completed", 11), ("diagnosis_benchmark_pass", 2), ("proposal_generated", 17),
         ("proposal_valid", 7), ("patch_applied", 19), ("all_edits_applied", 23), ("original_repository_unchanged", 101),
         ("source_integrity", 103), ("test_integrity_preserved", 107), ("pom_integrity_preserved", 109), ("workspace_cleanup_success", 113),
         ("target_test_found", 5), ("maven_executed", 29), ("diff_generated", 31)]


def results(spark, sf):
    """One result row per event: flags from the event number, durations from its value."""
    i = F.col("event_id")
    ok = F.when(i % 3 == 0, 1).otherwise(0)
    e = table(spark, sf, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("run_id"), i.alias("case_id"),
        *[(i % m != 0).alias(n) for n, m in _MODS], (i % 37 == 0).alias("maven_timeout"), F.lit(1).alias("tests"),
        ok.alias("failures"), F.lit(0).alias("errors"), F.lit(0).alias("skipped"), ok.alias("maven_exit_code"),
        F.when(i % 13 == 0, F.when(i % 2 == 0, "maven_not_found").otherwise("baseline_bug_not_reproduced")).alias("baseline_reason"),
        (i % 22 == 0).alias("diagnosis_provider_failed"), (i % 34 == 0).alias("patch_provider_failed"),
        F.lit("proposal_validation_rejected").alias("proposal_reason"), F.when(i % 3 == 0, "test_failure").alias("patched_reason"),
        F.when(i % 3 == 0, "test_failure").when(i % 41 == 0, "main_compile_failure").otherwise("success").alias("failure_category"),
        (i % 4 != 0).alias("surefire_report_found"), ((i % 5) / 4.0).alias("coverage"), ((i % 3) / 2.0).alias("target_recall"),
        (i % 4).alias("llm_calls"), (i % 4 + i % 2).alias("http_attempts"), (i % 7).alias("model_evidence"), (i % 7 - i % 2 * (i % 7 > 0).cast("int")).alias("validated_evidence"),
        (i % 2 * (i % 7 > 0).cast("int")).alias("rejected_evidence"), F.when((F.col("user_id") % 3 != 0) | (i % 50 != 0), i % 1000).alias("input_tokens"), (i % 300).alias("output_tokens"),
        F.floor("value").cast("bigint").alias("duration_ms"), F.col("event_type"))
    return sc.outcomes(e)


_R = "WITH e AS (SELECT 'r' || user_id % 3 AS run_id, event_id AS case_id, event_id AS i, " + ", ".join(
    f"event_id % {m} <> 0 AS {n}" for n, m in _MODS) + """, event_id % 5 / 4.0::DOUBLE AS coverage, event_id % 3 / 2.0::DOUBLE AS target_recall,
  event_id % 4 AS llm_calls, event_id % 4 + event_id % 2 AS http_attempts, event_id % 7 AS model_evidence, event_id % 7 - event_id % 2 * (event_id % 7 > 0)::INT AS validated_evidence,
  event_id % 2 * (event_id % 7 > 0)::INT AS rejected_evidence, CASE WHEN user_id % 3 <> 0 OR event_id % 50 <> 0 THEN event_id % 1000 END AS input_tokens, event_id % 300 AS output_tokens,
  floor(value)::BIGINT AS duration_ms, event_type FROM events),
g AS (SELECT *, """ + " AND ".join(sc.GATE_TRUE) + """ AND i % 37 <> 0 AND i % 3 <> 0 AS repair_success,
  CASE WHEN i % 3 = 0 THEN 'test_failure' WHEN i % 41 = 0 THEN 'main_compile_failure' ELSE 'success' END AS cat FROM e),
s AS (SELECT *, CASE WHEN NOT baseline_verified OR NOT original_repository_unchanged THEN 'baseline'
    WHEN i % 22 = 0 OR NOT diagnosis_completed THEN 'diagnosis' WHEN NOT proposal_valid THEN 'proposal' WHEN repair_success THEN NULL
    WHEN NOT patch_applied THEN 'application' ELSE 'verification' END AS failed_stage FROM g),
res AS (SELECT *, CASE failed_stage WHEN 'baseline' THEN CASE WHEN i % 13 = 0 THEN CASE WHEN i % 2 = 0 THEN 'maven_not_found' ELSE 'baseline_bug_not_reproduced' END ELSE 'original_repository_modified' END
    WHEN 'diagnosis' THEN CASE WHEN i % 22 = 0 THEN 'provider_failure' ELSE 'diagnosis_execution_failed' END
    WHEN 'proposal' THEN CASE WHEN i % 34 = 0 AND NOT proposal_generated THEN 'provider_failure' ELSE 'proposal_validation_rejected' END
    WHEN 'application' THEN 'patch_application_failed' WHEN 'verification' THEN CASE WHEN i % 3 = 0 THEN 'test_failure' ELSE 'verification_failed' END END AS failure_reason,
  CASE failed_stage WHEN 'baseline' THEN CASE WHEN i % 26 = 0 THEN 'infrastructure_failed' ELSE 'verification_failed' END
    WHEN 'diagnosis' THEN CASE WHEN i % 22 = 0 THEN 'provider_failed' ELSE 'diagnosis_failed' END
    WHEN 'proposal' THEN CASE WHEN i % 34 = 0 AND NOT proposal_generated THEN 'provider_failed' ELSE 'proposal_failed' END
    WHEN 'application' THEN 'application_failed' WHEN 'verification' THEN 'verification_failed'
    ELSE CASE WHEN diagnosis_benchmark_pass THEN 'complete_success' ELSE 'repair_success_with_diagnostic_metric_miss' END END AS outcome,
  CASE WHEN cat = 'main_compile_failure' THEN false WHEN cat = 'success' THEN true WHEN i % 4 <> 0 AND target_test_found THEN true END AS compile_success FROM s)
"""


@query("pl_outcome", _R + "SELECT case_id, failed_stage, failure_reason, outcome, compile_success FROM res")
def pl_outcome(spark, sf):
    return results(spark, sf).select("case_id", "failed_stage", "failure_reason", "outcome", "compile_success")


@query("ag_success_gate", _R + "SELECT run_id, count(*) FILTER (repair_success) AS successes, bool_and(repair_success) AS all_ok FROM res GROUP BY 1")
def ag_success_gate(spark, sf):
    return results(spark, sf).groupBy("run_id").agg(F.count_if("repair_success").alias("successes"), F.bool_and("repair_success").alias("all_ok"))


_FLAGS = [c for _n, c in sc.FUNNEL]


def _rate(c):
    return f"round(count(*) FILTER ({c}) / count(*), 4) AS {c}_rate"


def _dur(p):
    return f"round(avg(duration_ms), 3) AS mean_{p}, round(median(duration_ms), 3) AS p50_{p}, max(duration_ms) AS max_{p}"


@query("ag_e2e_totals", _R + "SELECT run_id, count(*) AS cases_total, count(*) FILTER (diagnosis_completed) AS cases_completed, "
       + ", ".join(f"sum({c})::BIGINT AS total_{c}" for c in ("model_evidence", "validated_evidence", "rejected_evidence", "http_attempts"))
       + ", CASE WHEN count(input_tokens) = count(*) THEN sum(input_tokens + output_tokens)::BIGINT END AS total_tokens, " + ", ".join(f"count(*) FILTER ({c}) AS {c}_count" for c in _FLAGS) + ", "
       + ", ".join(_rate(c) for c in _FLAGS) + f""", round(avg(coverage), 4) AS mean_coverage, round(avg(target_recall), 4) AS mean_target_recall,
  sum(llm_calls)::BIGINT AS total_llm_calls, CASE WHEN count(input_tokens) = count(*) THEN sum(input_tokens)::BIGINT END AS total_input_tokens,
  sum(output_tokens)::BIGINT AS total_output_tokens, {_dur('pipeline_ms')} FROM res GROUP BY 1""")
def ag_e2e_totals(spark, sf):
    return sc.e2e_totals(results(spark, sf), "run_id")


@query("ag_funnel", _R + " UNION ALL ".join(
    f"SELECT run_id, {i + 1} AS stage_no, '{n}' AS stage, count(*) FILTER ({c}) AS passed, count(*) AS total FROM res GROUP BY 1"
    for i, (n, c) in enumerate(sc.FUNNEL)))
def ag_funnel(spark, sf):
    return sc.funnel(results(spark, sf), "run_id")


@query("ag_reason_hist", _R + "SELECT run_id, failure_reason, count(*) AS n FROM res WHERE failure_reason IS NOT NULL GROUP BY 1, 2")
def ag_reason_hist(spark, sf):
    return sc.reason_histogram(results(spark, sf), "failure_reason", "run_id")


_APP = ("proposal_valid", "patch_applied", "all_edits_applied", "original_repository_unchanged", "diff_generated", "workspace_cleanup_success")
_VER = ("baseline_verified", "patch_applied", "maven_executed", "target_test_found", "repair_success", "original_repository_unchanged", "workspace_cleanup_success")


@query("ag_application_totals", _R + "SELECT run_id, count(*) AS cases, " + ", ".join(_rate(c) for c in _APP) + " FROM res GROUP BY 1")
def ag_application_totals(spark, sf):
    return sc.application_totals(results(spark, sf), "run_id")


@query("ag_verification_totals", _R + "SELECT run_id, count(*) AS cases, " + ", ".join(_rate(c) for c in _VER) + f", {_dur('verification_ms')} FROM res GROUP BY 1")
def ag_verification_totals(spark, sf):
    return sc.verification_totals(results(spark, sf), "run_id")


@query("jn_run_delta", _R + """, a AS (SELECT * FROM res), b AS (SELECT case_id + 7 AS case_id, coverage AS cov2, repair_success AS ok2, duration_ms FROM res)
SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'added' WHEN b.case_id IS NULL THEN 'removed' WHEN a.repair_success AND NOT ok2 THEN 'regressed'
  WHEN NOT a.repair_success AND ok2 THEN 'fixed' ELSE 'unchanged' END AS transition, round(cov2 - a.coverage, 4) AS delta_coverage, b.duration_ms - a.duration_ms AS delta_duration_ms
FROM a FULL JOIN b ON a.case_id = b.case_id""")
def jn_run_delta(spark, sf):
    """All results beside all results of a run whose cases are numbered seven further."""
    first = results(spark, sf).withColumn("passed", F.col("repair_success"))
    d = sc.run_delta(first, first.withColumn("case_id", F.col("case_id") + 7), ["coverage", "duration_ms"])
    return d.withColumn("delta_coverage", F.round("delta_coverage", 4))


@query("ext_scorer", "SELECT event_id AS case_id, round(value * 2 + event_id % 3, 6) AS score FROM events")
def ext_scorer(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_id").alias("case_id"), "value", F.lit(True).alias("completed"), F.lit(None).cast("double").alias("score"))
    return sc.score_with(r, lambda df: F.round(df["value"] * 2 + df["case_id"] % 3, 6)).select("case_id", "score")


# ----------------------------------------------------------------- case metrics
_TEXT = "lower(text)"
_GROUPS = "[['the', 'zzqq'], ['password', 'una'], ['qqzz']]"


def _metrics(spark, sf):
    i = F.col("doc_id")
    groups = F.array(*[F.array(*[F.lit(a) for a in g]) for g in (("the", "zzqq"), ("password", "una"), ("qqzz",))])
    cases = table(spark, sf, "documents").select(
        i.alias("case_id"), (i % 11 != 0).alias("completed"), (i % 29 == 0).alias("timed_out"),
        F.when(i % 4 == 0, "partial").otherwise("complete").alias("diagnosis_status"), F.lit("complete").alias("expected_status"),
        F.when(i % 3 == 0, "Config").otherwise("transactions").alias("category"), F.lit("configuration").alias("expected_category"),
        F.col("text"), F.when(i % 5 == 0, F.slice(groups, 1, 1)).otherwise(groups).alias("groups"))
    refs = case_refs(spark, sf).where("candidate_index < 3")
    checked = intervals.check_evidence(refs, case_snippets(spark, sf)).where("evidence_index >= 0")
    targets = case_snippets(spark, sf).where("rank < 3")
    expected = case_snippets(spark, sf).select("case_id", "file").unionByName(
        case_snippets(spark, sf).select("case_id", F.lit("pom.xml").alias("file")))
    return sc.case_metrics(cases, checked, targets, expected)


_METRICS = f"""WITH {S.CASES},
ev AS (SELECT r.*, CASE WHEN r.file = 'docs/none' THEN 'bad' WHEN r.start_line > r.end_line THEN 'bad' WHEN NOT EXISTS (SELECT 1 FROM snippets s
    WHERE s.case_id = r.case_id AND s.file = r.file AND r.start_line >= s.start_line AND r.end_line <= s.end_line) THEN 'bad' END AS reason FROM refs r),
ec AS (SELECT case_id, count(*) FILTER (reason IS NULL) AS good, count(*) FILTER (reason IS NOT NULL) AS bad FROM ev GROUP BY 1),
ts AS (SELECT t.case_id, count(*) AS targets, count(*) FILTER (EXISTS (SELECT 1 FROM ev e WHERE e.reason IS NULL AND e.case_id = t.case_id AND e.file = t.file
    AND e.start_line <= t.end_line AND t.start_line <= e.end_line)) AS hits FROM snippets t WHERE rank < 3 GROUP BY 1),
m0 AS (SELECT d.doc_id AS case_id, d.doc_id % 11 <> 0 AND d.doc_id % 29 <> 0 AS done, d.doc_id % 4 <> 0 AS same, d.doc_id % 3 = 0 AS cat_ok,
    coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(targets, 0) AS targets, coalesce(hits, 0) AS hits,
    CASE WHEN d.doc_id % 5 = 0 THEN contains({_TEXT}, 'the')::INT::DOUBLE
      ELSE round((contains({_TEXT}, 'the')::INT + (contains({_TEXT}, 'password') OR contains({_TEXT}, 'una'))::INT) / 3, 4) END AS coverage
  FROM documents d LEFT JOIN ec ON ec.case_id = d.doc_id LEFT JOIN ts ON ts.case_id = d.doc_id),
met AS (SELECT case_id, done AS agent_completed, done AND same AS diagnosis_match, done AND cat_ok AS category_match, coverage, good > 0 AS expected_file_hit,
  CASE WHEN good > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS expected_file_recall, hits AS target_hits, CASE WHEN targets > 0 THEN round(hits / targets, 4) ELSE 0.0 END AS target_recall,
  good + bad AS model_evidence, good AS valid_evidence, bad AS invalid_evidence, CASE WHEN good + bad > 0 THEN round(good / (good + bad), 4) END AS valid_rate,
  CASE WHEN good + bad > 0 THEN round(bad / (good + bad), 4) END AS hallucinated_rate,
  done AND same AND coverage >= 0.66 AND good > 0 AND hits > 0 AND bad = 0 AS case_pass FROM m0)"""


@query("ag_case_metrics", _METRICS + " SELECT * FROM met")
def ag_case_metrics(spark, sf):
    return _metrics(spark, sf)


@query("ag_case_totals", _METRICS + f""" SELECT case_id % 4 AS run_no, count(*) AS cases_total, count(*) FILTER (agent_completed) AS cases_completed, count(*) FILTER (case_pass) AS cases_passed,
  {', '.join(f'round(count(*) FILTER ({c}) / count(*), 4) AS {n}' for c, n in (('case_pass', 'case_pass_rate'), ('category_match', 'category_match_rate'), ('diagnosis_match', 'diagnosis_match_rate'), ('expected_file_hit', 'expected_file_hit_rate')))},
  round(avg(coverage), 4) AS mean_coverage, round(avg(target_recall), 4) AS mean_target_recall, sum(model_evidence)::BIGINT AS total_evidence,
  round(sum(valid_evidence) / sum(model_evidence), 4) AS valid_evidence_rate, round(sum(invalid_evidence) / sum(model_evidence), 4) AS hallucinated_rate,
  count(*) FILTER (agent_completed) AS cases_structurally_valid, sum(valid_evidence)::BIGINT AS total_valid_evidence, sum(invalid_evidence)::BIGINT AS total_invalid_evidence,
  round(avg(CASE WHEN first_rank <= 1 THEN 0.5 ELSE 0 END), 4) AS mean_recall_1, round(avg(CASE WHEN first_rank <= 3 THEN 0.5 ELSE 0 END), 4) AS mean_recall_3,
  round(avg(CASE WHEN first_rank <= 5 THEN 0.5 ELSE 0 END), 4) AS mean_recall_5, sum(case_id % 5)::BIGINT AS total_llm_calls, sum(case_id % 5 + case_id % 2)::BIGINT AS total_http_attempts,
  sum(case_id % 100)::BIGINT AS total_output_tokens, CASE WHEN count(CASE WHEN case_id % 12 <> 0 THEN 1 END) = count(*) THEN sum(case_id)::BIGINT END AS total_input_tokens, round(avg(case_id * 3), 3) AS mean_duration_ms, round(median(case_id * 3), 3) AS p50_duration_ms,
  max(case_id * 3) AS max_duration_ms FROM met LEFT JOIN (SELECT case_id, min(rank) AS first_rank FROM snippets GROUP BY 1) USING (case_id) GROUP BY 1""")
def ag_case_totals(spark, sf):
    i = F.col("case_id")
    # each case expects its own file, which retrieval finds, and one that it never finds
    found = case_snippets(spark, sf).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    recall = {f"recall_{k}": F.when(F.col("first_rank") <= k, 0.5).otherwise(0.0) for k in (1, 3, 5)}
    m = _metrics(spark, sf).join(found, "case_id", "left").withColumns({
        "run_no": i % 4, "input_tokens": F.when(i % 12 != 0, i), "output_tokens": i % 100, "duration_ms": i * 3, "llm_calls": i % 5,
        "http_attempts": i % 5 + i % 2, "structurally_valid": F.col("agent_completed"), **recall})
    return sc.case_totals(m, "run_no")


# -------------------------------------------------------------------- proposals
def _gold(spark, sf):
    return code_cases(spark, sf).select(
        "case_id", F.array(F.upper("file")).alias("acceptable_files"), F.array(F.lit("src/test"), F.lit("pom.xml")).alias("forbidden_files"),
        F.array(F.lit("transaction proxy"), F.lit("TextHelper")).alias("concepts"))


def _proposals(spark, sf):
    v, _ = ed.validate_edits(proposed_edits(spark, sf), code_cases(spark, sf), code_evidence(spark, sf))
    return sc.proposal_metrics(v, _gold(spark, sf))


_PROP = f"""WITH {S.VERDICTS}, pm AS (SELECT case_id, count(*) AS edits, count(*) FILTER (reason IS NULL) AS validated,
  round(count(*) FILTER (reason IS NULL) / count(*), 4) AS valid_edit_rate, CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS allowed_file_rate,
  bool_or(edit_index = 5) AS forbidden_edits, bool_or(reason IS NULL AND case_id % 3 = 0) AS concept_hit FROM verdicts GROUP BY 1),
rh AS (SELECT case_id, string_agg(reason || '=' || n, ' ' ORDER BY reason) AS reasons FROM (SELECT case_id, reason, count(*) AS n FROM verdicts WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("ag_proposal_metrics", _PROP + " SELECT pm.*, coalesce(reasons, '') AS reasons FROM pm LEFT JOIN rh USING (case_id)")
def ag_proposal_metrics(spark, sf):
    entries = F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _proposals(spark, sf).withColumn("reasons", F.coalesce(F.array_join(F.array_sort(entries), " "), F.lit("")))


@query("ag_proposal_totals", _PROP + """ SELECT case_id % 4 AS run_no, count(*) AS cases, round(avg(valid_edit_rate), 4) AS mean_valid_edit_rate,
  round(sum(validated) / sum(edits), 4) AS supported_edit_rate, round(count(*) FILTER (concept_hit) / count(*), 4) AS concept_hit_rate,
  sum(edits)::BIGINT AS total_edits, sum(validated)::BIGINT AS total_validated, sum(edits - validated)::BIGINT AS total_rejected,
  round(count(*) FILTER (edits > 0) / count(*), 4) AS generation_rate, round(count(*) FILTER (validated = edits) / count(*), 4) AS validation_rate,
  round(count(*) FILTER (dangerous) / count(*), 4) AS unsafe_rate, sum(case_id % 3)::BIGINT AS total_diagnostic_calls, sum(case_id % 2)::BIGINT AS total_patch_calls,
  sum(case_id % 3 + case_id % 2)::BIGINT AS total_calls, sum(case_id % 5)::BIGINT AS total_http_attempts, sum(case_id)::BIGINT AS total_input_tokens,
  CASE WHEN count(CASE WHEN case_id % 8 <> 0 THEN 1 END) = count(*) THEN sum(case_id % 100)::BIGINT END AS total_output_tokens, round(avg(case_id * 2), 3) AS mean_duration_ms
  FROM pm JOIN (SELECT case_id, bool_or(reason = 'dangerous_new_code') IS TRUE AS dangerous FROM verdicts GROUP BY 1) USING (case_id) GROUP BY 1""")
def ag_proposal_totals(spark, sf):
    i = F.col("case_id")
    unsafe = F.map_contains_key(F.coalesce("reasons", F.create_map().cast("map<string,bigint>")), F.lit("dangerous_new_code"))
    p = _proposals(spark, sf).withColumns({
        "run_no": i % 4, "generated": F.col("edits") > 0, "passed": F.col("validated") == F.col("edits"),
        "status": F.when(unsafe, "unsafe_to_propose").otherwise("proposed"), "diagnostic_calls": i % 3, "patch_calls": i % 2, "http_attempts": i % 5,
        "input_tokens": i, "output_tokens": F.when(i % 8 != 0, i % 100), "duration_ms": i * 2})
    return sc.proposal_totals(p, "run_no")


@query("jn_gold_files", f"""WITH {S.VERDICTS} SELECT case_id, edit_index, edit_index NOT IN (5, 8) AS acceptable, edit_index = 5 AS forbidden FROM verdicts""")
def jn_gold_files(spark, sf):
    e = proposed_edits(spark, sf).join(_gold(spark, sf), "case_id")
    return e.select("case_id", "edit_index",
                    F.exists("acceptable_files", lambda a: tx.gold_path(a) == tx.gold_path(F.col("file"))).alias("acceptable"),
                    sc.forbidden_file(F.col("file"), F.col("forbidden_files")).alias("forbidden"))


@query("jn_case_spec", "SELECT doc_id AS case_id, source AS spec FROM documents")
def jn_case_spec(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.col("source").alias("spec"))
    return sc.with_mandatory(d.select("case_id"), d)


# --------------------------------------------------------------- strict records
def _raw_cases(spark, sf):
    """Documents as JSONL case records; some with bad JSON, unknown keys, blanks or repeated ids."""
    i = F.col("doc_id")
    rec = F.to_json(F.struct(
        F.when(i % 17 == 0, F.lit("case-0")).otherwise(F.concat(F.lit("case-"), i.cast("string"))).alias("case_id"),
        F.concat(F.lit("samples/"), "source").alias("repository"),
        F.when(i % 13 == 0, F.lit(" ")).otherwise(F.regexp_replace("text", "[^A-Za-z0-9 ]", " ")).alias("issue_description"),
        F.lit("configuration").alias("expected_issue_category"), F.lit("complete").alias("expected_diagnosis_status"),
        F.array(F.concat(F.lit("src/D"), i.cast("string"), F.lit(".java"))).alias("expected_files")))
    broken = F.when(i % 11 == 0, F.left(rec, F.lit(40))).when(i % 7 == 0, F.regexp_replace(rec, r"\}\z", ',"hint":1}')).otherwise(rec)
    return table(spark, sf, "documents").select(F.col("doc_id"), broken.alias("raw"))


_STRICT = """CASE WHEN doc_id % 11 = 0 THEN 'invalid_json' WHEN doc_id % 7 = 0 THEN 'unknown_field:hint'
  WHEN doc_id % 13 = 0 OR trim(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')) = '' THEN 'missing:issue_description'
  WHEN doc_id % 17 = 0 THEN 'duplicate_key' ELSE '' END"""


def _strict(spark, sf):
    """The records read back from JSONL files."""
    lines = through_files(_raw_cases(spark, sf).select("raw"), "cases")
    return records.strict_records(lines, records.CASE_SCHEMA, "case_id", records.CASE_REQUIRED)


@query("src_cases_jsonl", f"""WITH recs AS (SELECT *, '{{"case_id":"case-' || CASE WHEN doc_id % 17 = 0 THEN 0 ELSE doc_id END || '","repository":"samples/' || source
    || '","issue_description":"' || CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') END
    || '","expected_issue_category":"configuration","expected_diagnosis_status":"complete","expected_files":["src/D' || doc_id || '.java"]}}' AS rec FROM documents)
SELECT md5(CASE WHEN doc_id % 11 = 0 THEN left(rec, 40) WHEN doc_id % 7 = 0 THEN left(rec, length(rec) - 1) || ',"hint":1}}' ELSE rec END) AS record,
  {_STRICT} AS error FROM recs""")
def src_cases_jsonl(spark, sf):
    return _strict(spark, sf).select(F.md5("raw").alias("record"), F.coalesce("error", F.lit("")).alias("error"))


@query("prj_agent_view", f"""SELECT 'case-' || doc_id AS case_id, 'samples/' || source AS repository,
  md5(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')) AS issue, 'error_log,issue_description,repository' AS visible FROM documents WHERE {_STRICT} = ''""")
def prj_agent_view(spark, sf):
    view = records.public_view(_strict(spark, sf).where("error is null").select("rec.*"))
    names = ",".join(sorted(c for c in view.columns if c != "case_id"))
    return view.select("case_id", "repository", F.md5("issue_description").alias("issue"), F.lit(names).alias("visible"))


@query("flt_split_select", """SELECT CASE WHEN doc_id % 3 = 0 THEN 'holdout' ELSE 'legacy' END AS split, count(*) AS cases, count(DISTINCT doc_id) AS ids,
  count(*) = count(DISTINCT doc_id) AS disjoint FROM documents GROUP BY 1""")
def flt_split_select(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("legacy").alias("split"), F.col("doc_id").alias("case_id"))
    per = d.groupBy("split", "case_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("cases"), F.count(F.lit(1)).alias("ids"), (F.max("n") == 1).alias("disjoint"))


_PATH_OF = "([ 'src/a', '/etc/x', 'C:\\x', 'src/../b', '', '\\\\srv\\x' ])[doc_id % 6 + 1]"


@query("flt_manifest_path", f"""SELECT doc_id, (['', 'absolute', 'absolute', 'traversal', 'blank', 'absolute'])[doc_id % 6 + 1] AS error FROM documents""")
def flt_manifest_path(spark, sf):
    p = F.element_at(F.array(*[F.lit(x) for x in ("src/a", "/etc/x", "C:\\x", "src/../b", "", "\\\\srv\\x")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(records.unsafe_path(p), F.lit("")).alias("error"))


@query("src_gold_jsonl", "SELECT 'case-' || doc_id AS case_id, 'src/d' || doc_id || '.java' AS file FROM documents")
def src_gold_jsonl(spark, sf):
    i = F.col("doc_id").cast("string")
    raw = table(spark, sf, "documents").select(F.to_json(F.struct(
        F.concat(F.lit("case-"), i).alias("case_id"), F.array(F.concat(F.lit(" src\\D"), i, F.lit(".java "))).alias("acceptable_files"),
        F.array(F.lit("x")).alias("acceptable_change_concepts"), F.array(F.lit("src/test")).alias("forbidden_files"))).alias("raw"))
    g = records.strict_records(through_files(raw, "gold"), records.GOLD_SCHEMA, "case_id", records.GOLD_FIELDS).where("error is null")
    return g.select("rec.case_id", F.explode(F.transform("rec.acceptable_files", tx.gold_path)).alias("file"))


@query("src_specs_jsonl", "SELECT 'case-' || doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN 'repeated_name' ELSE '' END AS error, 2 AS variants FROM documents")
def src_specs_jsonl(spark, sf):
    from evidentia.plans.meaning import specs

    s = specs(spark, sf)
    twice = F.when(F.col("case_id") % 5 == 0, F.concat("required_relations", F.slice("required_relations", 1, 1))).otherwise(F.col("required_relations"))
    raw = s.select(F.to_json(F.struct(F.lit("v").alias("schema_version"), F.concat(F.lit("case-"), F.col("case_id").cast("string")).alias("case_id"),
                                      "required_concepts", twice.alias("required_relations"), "forbidden_relations")).alias("raw"))
    names = F.concat("rec.required_concepts.name", "rec.required_relations.name", "rec.forbidden_relations.name")
    r = records.strict_records(through_files(raw, "specs"), records.SPEC_SCHEMA, "case_id", ["case_id", "required_concepts", "required_relations"],
                               rules={"repeated_name": F.size(F.array_distinct(names)) < F.size(names)})
    n = F.size(F.array_distinct(F.flatten(F.col("rec.required_relations.variants"))))
    return r.select("rec.case_id", F.coalesce("error", F.lit("")).alias("error"), n.cast("bigint").alias("variants"))


@query("src_regressions_jsonl", """SELECT source AS corpus, count(*) AS records, count(DISTINCT doc_id // 40) AS ids, count(*) = 11 AND count(DISTINCT doc_id // 40) = 11 AS ok FROM documents GROUP BY 1""")
def src_regressions_jsonl(spark, sf):
    i = F.col("doc_id")
    raw = table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.to_json(F.struct(
        F.lit("v").alias("schema_version"), F.floor(i / 40).cast("string").alias("regression_id"), i.cast("string").alias("case_id"),
        F.lit("c").alias("semantic_component_id"), F.create_map(F.lit("text"), F.col("text")).alias("bounded_input"))).alias("raw"))
    lines = through_files(raw, "regressions", "corpus").withColumn("corpus", F.regexp_extract("source", "corpus=([^/]*)/", 1))
    r = records.strict_records(lines, records.REGRESSION_SCHEMA, "regression_id", ["regression_id", "case_id"], scope=["corpus"])
    return records.cardinality_check(r, 11, F.col("rec.regression_id"), "corpus")


@query("src_frozen_summary", "SELECT doc_id AS case_id, n_chars % 2 = 0 AS passed FROM documents")
def src_frozen_summary(spark, sf):
    d = table(spark, sf, "documents")
    # archived summaries hold a few cases each
    body = d.groupBy((F.col("doc_id") / 8).cast("bigint").alias("run")).agg(F.to_json(F.struct(F.collect_list(F.struct(
        F.col("doc_id").alias("case_id"), (F.col("n_chars") % 2 == 0).alias("diagnosis_benchmark_pass"))).alias("cases"))).alias("json"))
    return records.frozen_cases(through_files(body.select("json"), "summaries")).select("case_id", F.col("diagnosis_benchmark_pass").alias("passed"))


@query("pl_manifest_check", f"""WITH {S.CODE} SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN 'file_missing' WHEN doc_id % 7 = 0 THEN 'range_outside_file'
  WHEN doc_id % 3 = 0 THEN 'required_text_missing' ELSE '' END AS error, doc_id % 2 = 0 AS symbol_found FROM code""")
def pl_manifest_check(spark, sf):
    from evidentia.operators.manifest import check_targets

    c = code_cases(spark, sf)
    i = F.col("doc_id")
    targets = c.select(
        "case_id", F.when(i % 5 == 0, F.concat("file", F.lit("x"))).otherwise(F.col("file")).alias("file"), F.lit(7).alias("start_line"),
        F.when(i % 7 == 0, F.lit(1_000_000)).otherwise(F.lit(8)).alias("end_line"),
        F.array(F.when(i % 3 == 0, F.lit("zzqq")).otherwise(F.col("cls"))).alias("required_text"),
        F.when(i % 2 == 0, F.col("cls")).otherwise(F.lit("zzqqxx")).alias("symbol"))
    return check_targets(targets, c).select("case_id", F.coalesce("error", F.lit("")).alias("error"), "symbol_found")
