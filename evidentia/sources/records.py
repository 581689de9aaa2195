"""Strict JSON records: manifests, cases, rule specs, gold and archived summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import text as tx
from evidentia.operators.ranking import split_row_number


def manifest_rows(df: DataFrame, *keys: str, json: str = "json") -> DataFrame:
    """A JSON map path -> sha256 per row becomes one row per path."""
    parsed = F.from_json(json, "map<string,string>")
    return df.select(*keys, F.explode(parsed).alias("file", "sha256"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, raw) of all non-blank lines of JSONL files.

    A file of any size is read in splits; line numbers are counted inside each split
    and shifted by the sizes of the splits before it.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    numbered = split_row_number(lines, ["source"], F.col("_start"), [F.col("_at")], "line_no")
    return numbered.select("source", F.col("line_no").cast("bigint").alias("line_no"), "raw").where(~F.col("raw").rlike(r"^\s*$"))


FROZEN_SCHEMA = "cases array<struct<case_id:bigint,diagnosis_benchmark_pass:boolean>>"


def frozen_cases(raw: DataFrame, schema: str = FROZEN_SCHEMA) -> DataFrame:
    """One row per case of archived run summaries, each a JSON object with a ``cases`` list.

    A summary that is no object or has no list fails the job.
    """
    parsed = F.from_json("raw", schema)["cases"]
    checked = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("frozen summary does not contain a cases list")))
    return raw.select(F.explode(checked).alias("_c")).select("_c.*")


def strict_records(
    raw: DataFrame, schema: str, key: str, required: Sequence[str], scope: Sequence[str] = (),
    rules: dict[str, Column] | None = None,
) -> DataFrame:
    """Parses ``raw`` by ``schema`` and names the first error of each record.

    Bad JSON, unknown keys, missing required fields and repeated keys inside
    ``scope`` are errors; ``rules`` adds more (message -> condition that holds
    for bad rows, written over the column ``rec``).
    """
    schema = T.StructType.fromDDL(schema)
    parsed = raw.withColumn("rec", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))
    valid = F.try_parse_json("raw").isNotNull() & F.json_object_keys("raw").isNotNull()
    unknown = F.array_except(F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")), tx.words(*schema.names))
    parsed = parsed.withColumn("_key", F.col(f"rec.{key}"))
    # repeated keys are found by a count, not by bringing the copies together
    repeats = (
        parsed.where(valid).groupBy(*scope, "_key").agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _key is not null").select(*scope, "_key", F.lit(True).alias("_dup"))
    )
    joined = parsed.join(repeats, [*scope, "_key"], "left")
    error = F.when(~valid, "invalid_json").when(F.size(unknown) > 0, F.concat(F.lit("unknown_field:"), F.array_join(F.array_sort(unknown), ",")))
    for name in required:
        value = F.col(f"rec.{name}")
        missing = value.isNull()
        if isinstance(schema[name].dataType, T.StringType):
            missing = missing | value.rlike(r"^\s*$")
        error = error.when(missing, f"missing:{name}")
    for message, bad in (rules or {}).items():
        error = error.when(bad, message)
    error = error.when(F.col("_dup"), "duplicate_key")
    return joined.withColumn("error", error).drop("_key", "_dup")


def cardinality_check(records: DataFrame, expected: int, key: Column, *scope: str) -> DataFrame:
    """Do the records of each corpus number exactly ``expected`` with unique ids?"""
    return records.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("ids"),
    ).withColumn("ok", (F.col("records") == expected) & (F.col("ids") == expected))


# --------------------------------------------------------------------- schemas
CASE_SCHEMA = (
    "case_id string, repository string, issue_description string, error_log string, expected_issue_category string, "
    "expected_diagnosis_status string, expected_root_cause_keywords array<string>, keyword_groups array<array<string>>, "
    "expected_files array<string>, expected_symbols array<string>, "
    "evidence_targets array<struct<file:string,start_line:int,end_line:int,required_text:array<string>>>, "
    "expected_maven struct<test_name:string,tests:int,failures:int,errors:int,skipped:int,required_failure_terms:array<string>>"
)
CASE_REQUIRED = ["case_id", "repository", "issue_description", "expected_issue_category", "expected_diagnosis_status"]
GOLD_SCHEMA = (
    "case_id string, acceptable_files array<string>, acceptable_change_concepts array<string>, forbidden_files array<string>"
)
_PATTERNS = "array<struct<anchor_aliases:array<string>,value_aliases:array<string>,max_token_distance:int>>"
_VARIANTS = (
    "array<struct<left_aliases:array<string>,relation_aliases:array<string>,right_aliases:array<string>,"
    "required_value_aliases:array<string>,context_aliases:array<string>,max_token_distance:int,"
    "value_max_token_distance:int,context_max_token_distance:int>>"
)
_RELATIONS = f"array<struct<name:string,variants:{_VARIANTS}>>"
SPEC_SCHEMA = (
    "schema_version string, case_id string, "
    f"required_concepts array<struct<name:string,aliases:array<string>,bounded_patterns:{_PATTERNS}>>, "
    f"required_relations {_RELATIONS}, forbidden_relations {_RELATIONS}"
)
REGRESSION_SCHEMA = (
    "schema_version string, regression_id string, case_id string, semantic_component_id string, "
    "bounded_input map<string,string>, expected_v2_0 map<string,string>, expected_v2_1 map<string,string>, "
    "expected_v2_2 map<string,string>"
)
GOLD_FIELDS = ["case_id", "acceptable_files", "acceptable_change_concepts", "forbidden_files"]
PUBLIC_FIELDS = ["repository", "issue_description", "error_log"]


def public_view(cases: DataFrame) -> DataFrame:
    """What an agent may see of a case."""
    return cases.select("case_id", *PUBLIC_FIELDS)


def gold_view(cases: DataFrame) -> DataFrame:
    """Everything else."""
    return cases.drop(*PUBLIC_FIELDS)


def unsafe_path(path: Column) -> Column:
    """Error of a manifest path, null when it is a plain relative path."""
    p = tx.normal_path(path)
    return (
        F.when(p.isNull() | p.rlike(r"^\s*$"), "blank")
        .when(p.rlike(r"^/|^[A-Za-z]:") | F.startswith(path, F.lit("\\\\")), "absolute")
        .when(F.exists(F.split(p, "/"), lambda x: x == ".."), "traversal")
    )
