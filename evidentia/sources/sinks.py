"""Sinks: redacted case artifacts and the task store tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx


def redacted(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Every string of every column redacted, at any depth."""
    return df.select(*[
        F.col(f.name) if f.name in skip else tx.redact_nested(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields
    ])


def write_case_artifacts(cases: DataFrame, path: str) -> str:
    """One JSON record per case with sorted keys, under mode and run_id.

    Redaction happens here, so no caller can forget it.
    """
    keys = ("mode", "run_id", "case_id")
    safe = redacted(cases, skip=keys)
    record = F.to_json(F.struct(*[F.col(c) for c in sorted(safe.columns) if c not in keys]), {"ignoreNullFields": "false"})
    safe.select(*keys, record.alias("record")).write.mode("overwrite").partitionBy("mode", "run_id").json(path)
    return path


def write_run_summary(summary: DataFrame, path: str) -> None:
    redacted(summary, skip=("run_id",)).write.mode("overwrite").partitionBy("run_id").json(path)


def write_trace_tables(root: str, tasks: DataFrame, traces: DataFrame, reports: DataFrame) -> None:
    """tasks, traces (by day) and reports as Parquet."""
    tasks.write.mode("overwrite").parquet(f"{root}/tasks")
    by_day = traces.withColumn("day", F.to_date("recorded_at"))
    # one range of (day, task) per task keeps files few and a busy day in several of them
    by_day.repartitionByRange("day", "task_id", "seq").write.mode("overwrite").partitionBy("day").parquet(f"{root}/traces")
    reports.write.mode("overwrite").parquet(f"{root}/reports")
