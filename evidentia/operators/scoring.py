"""Case metrics, run totals, funnels, outcomes and run-to-run deltas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators.intervals import target_status

# Reasons that count as invalid evidence, gate conditions, funnel stages.
INVALID_EVIDENCE = ["file_not_in_retrieved_snippets", "line_range_outside_snippet", "start_line_greater_than_end_line"]
MIN_COVERAGE = 0.66
GATE_TRUE = [
    "baseline_verified", "diagnosis_completed", "proposal_generated", "proposal_valid", "patch_applied",
    "all_edits_applied", "original_repository_unchanged", "source_integrity", "test_integrity_preserved",
    "pom_integrity_preserved", "workspace_cleanup_success", "target_test_found", "maven_executed",
]
FUNNEL = [
    ("Baseline Reproduced", "baseline_verified"), ("Diagnosis Completed", "diagnosis_completed"),
    ("Diagnosis Benchmark Passed", "diagnosis_benchmark_pass"), ("Proposal Generated", "proposal_generated"),
    ("Proposal Validated", "proposal_valid"), ("Patch Applied", "patch_applied"),
    ("Target Test Executed", "target_test_found"), ("Repair Successful", "repair_success"),
]
# end fixed values
SEMANTIC_ANYWHERE = ["src/test", "target", "benchmark"]


def rate(flag: str) -> Column:
    return tx.ratio(F.count_if(flag), F.count(F.lit(1)))


def mean(column: str, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.avg(column), digits), F.lit(0.0))


def durations(column: str, prefix: str) -> list[Column]:
    return [
        mean(column, 3).alias(f"mean_{prefix}"),
        F.coalesce(F.round(F.median(column), 3), F.lit(0.0)).alias(f"p50_{prefix}"),
        F.coalesce(F.max(column), F.lit(0)).alias(f"max_{prefix}"),
    ]


# ----------------------------------------------------------------- case metrics
def keyword_coverage(text: Column, groups: Column) -> Column:
    """Share of keyword groups with at least one alias in the text; 1.0 without groups."""
    low = F.lower(text)
    hit = F.size(F.filter(groups, lambda g: F.exists(g, lambda a: F.contains(low, F.lower(a)))))
    return F.when(F.size(groups) == 0, 1.0).otherwise(tx.ratio(hit, F.size(groups)))


def case_metrics(cases: DataFrame, evidence: DataFrame, targets: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per case.

    cases: case_id, completed, timed_out, diagnosis_status, expected_status, category, expected_category,
    text, groups.  evidence: case_id, file, start_line, end_line, reason (null when valid).
    targets: case_id, file, start_line, end_line.  expected: case_id, file.
    """
    valid = evidence.where("reason is null")
    counts = evidence.groupBy("case_id").agg(
        F.count_if(F.col("reason").isNull()).alias("valid_evidence"),
        F.count_if(F.col("reason").isin(*INVALID_EVIDENCE)).alias("invalid_evidence"))
    status = target_status(targets, valid).groupBy("case_id").agg(
        F.count_if(F.col("status") == "exact_containment").alias("targets_exact"),
        F.count_if(F.col("status") == "overlap_only").alias("targets_overlap"), F.count(F.lit(1)).alias("targets"))
    wanted = expected.select("case_id", "file").distinct()
    files = wanted.join(valid.select("case_id", "file").distinct().withColumn("_hit", F.lit(1)), ["case_id", "file"], "left")
    files = files.groupBy("case_id").agg(F.count("_hit").alias("files_hit"), F.count(F.lit(1)).alias("files_expected"))
    df = cases
    for part in (counts, status, files):
        df = df.join(part, "case_id", "left")
    df = df.fillna(0, ["valid_evidence", "invalid_evidence", "targets_exact", "targets_overlap", "targets", "files_hit", "files_expected"])
    done = F.col("completed") & ~F.col("timed_out")
    total = F.col("valid_evidence") + F.col("invalid_evidence")
    hits = F.col("targets_exact") + F.col("targets_overlap")
    df = df.withColumns({
        "agent_completed": done,
        "diagnosis_match": done & F.col("diagnosis_status").eqNullSafe(F.col("expected_status")),
        "category_match": done & (tx.category(F.col("category")) == tx.category(F.col("expected_category"))),
        "coverage": keyword_coverage(F.col("text"), F.col("groups")),
    })
    passed = (
        F.col("diagnosis_match") & (F.col("coverage") >= MIN_COVERAGE) & (F.col("files_hit") > 0) & (hits > 0)
        & (F.col("invalid_evidence") == 0))
    return df.select(
        "case_id", "agent_completed", "diagnosis_match", "category_match", "coverage",
        (F.col("files_hit") > 0).alias("expected_file_hit"), tx.ratio(F.col("files_hit"), F.col("files_expected")).alias("expected_file_recall"),
        hits.alias("target_hits"), tx.ratio(hits, F.col("targets")).alias("target_recall"), total.alias("model_evidence"),
        "valid_evidence", "invalid_evidence", tx.ratio_or_null(F.col("valid_evidence"), total).alias("valid_rate"),
        tx.ratio_or_null(F.col("invalid_evidence"), total).alias("hallucinated_rate"), passed.alias("case_pass"))


def case_totals(cases: DataFrame, *keys: str) -> DataFrame:
    """Run totals; failed cases stay in every denominator.

    Beside the columns of ``case_metrics``: structurally_valid, recall_1, recall_3, recall_5 of
    the expected files, llm_calls, http_attempts, input_tokens, output_tokens, duration_ms.
    """
    ev, good, bad = F.sum("model_evidence"), F.sum("valid_evidence"), F.sum("invalid_evidence")
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases_total"), F.count_if("agent_completed").alias("cases_completed"),
        F.count_if("case_pass").alias("cases_passed"), rate("case_pass").alias("case_pass_rate"),
        rate("category_match").alias("category_match_rate"), rate("diagnosis_match").alias("diagnosis_match_rate"),
        mean("coverage").alias("mean_coverage"), rate("expected_file_hit").alias("expected_file_hit_rate"),
        mean("target_recall").alias("mean_target_recall"), ev.alias("total_evidence"),
        tx.ratio_or_null(good, ev).alias("valid_evidence_rate"), tx.ratio_or_null(bad, ev).alias("hallucinated_rate"),
        F.count_if("structurally_valid").alias("cases_structurally_valid"), good.alias("total_valid_evidence"), bad.alias("total_invalid_evidence"),
        *[mean(f"recall_{k}").alias(f"mean_recall_{k}") for k in (1, 3, 5)], F.sum("llm_calls").alias("total_llm_calls"),
        F.sum("http_attempts").alias("total_http_attempts"), tx.sum_if_all_known(F.col("output_tokens")).alias("total_output_tokens"),
        tx.sum_if_all_known(F.col("input_tokens")).alias("total_input_tokens"), *durations("duration_ms", "duration_ms"))


# -------------------------------------------------------------------- proposals
def concept_aliases(concepts: Column) -> Column:
    """Change concepts with the words that count as naming them."""
    def wider(c: Column) -> Column:
        c = F.lower(c)
        extra = [
            (F.contains(c, F.lit("qualifier")), ["@qualifier"]), (F.contains(c, F.lit("primary")), ["@primary"]),
            (F.contains(c, F.lit("prefix")) | F.contains(c, F.lit("hierarchy")), ["prefix", "hierarchy"]),
            (F.contains(c, F.lit("proxy")) | F.contains(c, F.lit("transaction")), ["proxy", "transactional"]),
        ]
        none = F.array().cast("array<string>")
        return F.concat(F.array(c), *[F.when(cond, tx.words(*names)).otherwise(none) for cond, names in extra])

    return F.array_distinct(F.flatten(F.transform(concepts, wider)))


def concept_hit(text: Column, concepts: Column) -> Column:
    low = F.lower(text)
    return F.exists(concept_aliases(concepts), lambda a: (a != "") & F.contains(low, a))


def forbidden_file(file: Column, forbidden: Column) -> Column:
    f = tx.gold_path(file)

    def bad(x: Column) -> Column:
        p = tx.gold_path(x)
        return (f == p) | F.startswith(f, F.concat(F.regexp_replace(p, r"/+\z", ""), F.lit("/"))) | (
            p.isin(*SEMANTIC_ANYWHERE) & F.contains(f, p))

    return F.exists(forbidden, bad)


def proposal_metrics(verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case: edit rates, files against gold and the histogram of rejection reasons.

    ``verdicts`` is the edit table of validation; a case has a handful of edits.
    """
    v = verdicts.join(gold, "case_id")
    ok = F.col("reason").isNull()
    allowed = ok & F.exists("acceptable_files", lambda a: tx.gold_path(a) == tx.gold_path(F.col("file")))
    n = F.count(F.lit(1))
    base = v.groupBy("case_id").agg(
        n.alias("edits"), F.count_if(ok).alias("validated"), tx.ratio(F.count_if(ok), n).alias("valid_edit_rate"),
        tx.ratio(F.count_if(allowed), F.count_if(ok)).alias("allowed_file_rate"),
        F.bool_or(forbidden_file(F.col("file"), F.col("forbidden_files"))).alias("forbidden_edits"),
        F.bool_or(ok & concept_hit(F.col("new_code"), F.col("concepts"))).alias("concept_hit"))
    reasons = verdicts.where("reason is not null").groupBy("case_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    hist = reasons.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("_h")).select(
        "case_id", F.map_from_entries("_h").alias("reasons"))
    return base.join(hist, "case_id", "left")


def import_status(checks: DataFrame) -> DataFrame:
    """fail before unknown before pass per case."""
    order = F.when(F.col("status") == "fail", 2).when(F.col("status") == "unknown", 1).otherwise(0)
    return checks.groupBy("case_id").agg(F.max(order).alias("o")).select(
        "case_id", F.when(F.col("o") == 2, "fail").when(F.col("o") == 1, "unknown").otherwise("pass").alias("import_status"))


def proposal_totals(cases: DataFrame, *keys: str) -> DataFrame:
    """Run totals of proposals.

    Beside the columns of ``proposal_metrics``: generated, passed, status, diagnostic_calls,
    patch_calls, http_attempts, input_tokens, output_tokens, duration_ms.
    """
    calls = F.sum("diagnostic_calls"), F.sum("patch_calls")
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), mean("valid_edit_rate").alias("mean_valid_edit_rate"),
        tx.ratio(F.sum("validated"), F.sum("edits")).alias("supported_edit_rate"), rate("concept_hit").alias("concept_hit_rate"),
        F.sum("edits").alias("total_edits"), F.sum("validated").alias("total_validated"), F.sum(F.col("edits") - F.col("validated")).alias("total_rejected"),
        rate("generated").alias("generation_rate"), rate("passed").alias("validation_rate"),
        tx.ratio(F.count_if(F.col("status") == "unsafe_to_propose"), F.count(F.lit(1))).alias("unsafe_rate"),
        calls[0].alias("total_diagnostic_calls"), calls[1].alias("total_patch_calls"), (calls[0] + calls[1]).alias("total_calls"),
        F.sum("http_attempts").alias("total_http_attempts"), tx.sum_if_all_known(F.col("input_tokens")).alias("total_input_tokens"),
        tx.sum_if_all_known(F.col("output_tokens")).alias("total_output_tokens"), mean("duration_ms", 3).alias("mean_duration_ms"))


def application_totals(cases: DataFrame, *keys: str) -> DataFrame:
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), *[rate(c).alias(f"{c}_rate") for c in
                                           ("proposal_valid", "patch_applied", "all_edits_applied", "original_repository_unchanged",
                                            "diff_generated", "workspace_cleanup_success")])


def verification_totals(cases: DataFrame, *keys: str) -> DataFrame:
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), *[rate(c).alias(f"{c}_rate") for c in
                                           ("baseline_verified", "patch_applied", "maven_executed", "target_test_found",
                                            "repair_success", "original_repository_unchanged", "workspace_cleanup_success")],
        *durations("duration_ms", "verification_ms"))


# ------------------------------------------------------------------- end to end
def success_gate() -> Column:
    """All conditions of a successful repair."""
    out = F.lit(True)
    for c in GATE_TRUE:
        out = out & F.coalesce(F.col(c), F.lit(False))
    return (
        out & ~F.col("maven_timeout") & (F.col("tests") > 0) & F.coalesce(F.col("maven_exit_code") == 0, F.lit(False))
        & (F.col("failures") == 0) & (F.col("errors") == 0) & (F.col("skipped") == 0))


def outcomes(cases: DataFrame) -> DataFrame:
    """Adds repair_success, failed_stage, failure_reason, outcome and compile_success."""
    df = cases.withColumn("repair_success", success_gate())
    infra = F.col("baseline_reason").isin("maven_not_found", "java_not_compatible")
    provider_diag = F.col("diagnosis_provider_failed")
    provider_patch = F.col("patch_provider_failed") & ~F.col("proposal_generated")
    stage = (
        F.when(~F.col("baseline_verified") | ~F.col("original_repository_unchanged"), "baseline")
        .when(provider_diag | ~F.col("diagnosis_completed"), "diagnosis")
        .when(~F.col("proposal_valid"), "proposal")
        .when(F.col("repair_success"), None)
        .when(~F.col("patch_applied"), "application")
        .otherwise("verification"))
    df = df.withColumn("failed_stage", stage)
    s = F.col("failed_stage")
    reason = (
        F.when(s == "baseline", F.coalesce("baseline_reason", F.lit("original_repository_modified")))
        .when(s == "diagnosis", F.when(provider_diag, "provider_failure").otherwise("diagnosis_execution_failed"))
        .when(s == "proposal", F.when(provider_patch, "provider_failure").otherwise(F.col("proposal_reason")))
        .when(s == "application", "patch_application_failed")
        .when(s == "verification", F.coalesce("patched_reason", F.lit("verification_failed"))))
    outcome = (
        F.when(s == "baseline", F.when(infra, "infrastructure_failed").otherwise("verification_failed"))
        .when(s == "diagnosis", F.when(provider_diag, "provider_failed").otherwise("diagnosis_failed"))
        .when(s == "proposal", F.when(provider_patch, "provider_failed").otherwise("proposal_failed"))
        .when(s == "application", "application_failed")
        .when(s == "verification", "verification_failed")
        .when(F.col("diagnosis_benchmark_pass"), "complete_success")
        .otherwise("repair_success_with_diagnostic_metric_miss"))
    cat = F.col("failure_category")
    compiled = (
        F.when(cat.isin("main_compile_failure", "test_compile_failure"), False).when(cat == "success", True)
        .when(F.col("surefire_report_found") & F.col("target_test_found"), True))
    return df.withColumns({"failure_reason": reason, "outcome": outcome, "compile_success": compiled})


def e2e_totals(cases: DataFrame, *keys: str) -> DataFrame:
    """Run totals; a token total is null as soon as one case lacks it."""
    flags = [c for _n, c in FUNNEL]
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases_total"), F.count_if(F.col("diagnosis_completed")).alias("cases_completed"),
        *[F.sum(c).alias(f"total_{c}") for c in ("model_evidence", "validated_evidence", "rejected_evidence", "http_attempts")],
        tx.sum_if_all_known(tokens).alias("total_tokens"), *[F.count_if(c).alias(f"{c}_count") for c in flags],
        *[rate(c).alias(f"{c}_rate") for c in flags], mean("coverage").alias("mean_coverage"), mean("target_recall").alias("mean_target_recall"),
        F.sum("llm_calls").alias("total_llm_calls"), tx.sum_if_all_known(F.col("input_tokens")).alias("total_input_tokens"),
        tx.sum_if_all_known(F.col("output_tokens")).alias("total_output_tokens"), *durations("duration_ms", "pipeline_ms"))


def funnel(cases: DataFrame, *keys: str) -> DataFrame:
    """(keys, stage_no, stage, passed, total): eight rows per key from one aggregate."""
    one = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(c) for _n, c in FUNNEL])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage_no"), F.lit(n).alias("stage"), F.col(c).alias("passed"))
                     for i, (n, c) in enumerate(FUNNEL)])
    return one.select(*keys, "total", F.explode(rows).alias("r")).select(*keys, "r.*", "total")


def reason_histogram(df: DataFrame, reason: str, *keys: str) -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))


def run_delta(a: DataFrame, b: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Cases of two runs side by side: metric differences and the change of outcome."""
    left = a.select("case_id", F.lit(True).alias("_a"), *[F.col(m).alias(f"a_{m}") for m in (*metrics, "passed")])
    right = b.select("case_id", F.lit(True).alias("_b"), *[F.col(m).alias(f"b_{m}") for m in (*metrics, "passed")])
    change = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .when(F.col("a_passed") & ~F.col("b_passed"), "regressed").when(~F.col("a_passed") & F.col("b_passed"), "fixed")
        .otherwise("unchanged"))
    return left.join(right, "case_id", "full_outer").select(
        "case_id", change.alias("transition"), *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"delta_{m}") for m in metrics])


def with_mandatory(cases: DataFrame, gold: DataFrame, key: str = "case_id") -> DataFrame:
    """Joins gold to every case; a case without gold fails the job."""
    df = cases.join(gold.withColumn("_found", F.lit(True)), key, "left")
    check = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("missing gold for "), F.col(key).cast("string"))))
    return df.withColumn(key, check).drop("_found")


def score_with(results: DataFrame, score: Callable[[DataFrame], Column]) -> DataFrame:
    """Adds ``score`` from a user's column function; incomplete or already scored results are refused."""
    refuse = F.when(~F.col("completed"), F.raise_error(F.lit("run is not complete"))).when(
        F.col("score").isNotNull(), F.raise_error(F.lit("result is already scored")))
    return results.withColumn("score", F.coalesce(refuse.cast("double"), score(results).cast("double")))
