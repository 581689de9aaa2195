"""Task and trace tables: sequence numbers, status, rollups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import jsontext as js
from evidentia.operators.ranking import split_row_number

STATUSES = ["pending", "running", "completed", "failed"]
# Fixed value: the recorded reason.
INTERRUPTED_REASON = "interrupted_by_service_restart"


def sequenced(traces: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Gap-free ``seq`` from 0 per task by (recorded_at, arrival).

    A task that logs a third of all traces is numbered minute by minute.
    """
    minute = F.date_trunc("minute", F.col("recorded_at"))
    order = [F.asc("recorded_at"), F.asc(arrival)]
    return split_row_number(traces, ["task_id"], minute, order, "_n").withColumn("seq", (F.col("_n") - 1).cast("bigint")).drop("_n")


def valid_status(status: Column) -> Column:
    """The status itself; any other value fails the job."""
    return F.when(status.isin(*STATUSES), status).otherwise(
        F.raise_error(F.concat(F.lit("invalid status: "), F.coalesce(status, F.lit("null")))))


def status_columns(at: Column) -> list[Column]:
    """Aggregates that fold status updates of a task; the same in batch and stream."""
    return [
        F.max_by("status", at).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("recorded_at"))).alias("started_at"),
        F.min(F.when(F.col("status").isin("completed", "failed"), F.col("recorded_at"))).alias("finished_at"),
        # node and error are only replaced by given values
        F.max_by("node", F.when(F.col("node").isNotNull(), at)).alias("current_node"),
        F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error_message"),
    ]


def task_status(updates: DataFrame) -> DataFrame:
    """Current row per task from (task_id, recorded_at, arrival, status, node, error)."""
    checked = updates.withColumn("status", valid_status(F.col("status")))
    return checked.groupBy("task_id").agg(*status_columns(F.struct("recorded_at", "arrival")))


def mark_interrupted(tasks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, recovery traces): open tasks fail once; a second run changes nothing."""
    is_open = F.col("status").isin("pending", "running")
    fixed = tasks.withColumns({
        "status": F.when(is_open, "failed").otherwise(F.col("status")),
        "finished_at": F.when(is_open, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")),
        "error_message": F.when(is_open, INTERRUPTED_REASON).otherwise(F.col("error_message")),
    })
    recovery = tasks.where(is_open).select(
        "task_id", F.lit("system_recovery").alias("kind"), now.alias("recorded_at"),
        F.to_json(F.struct(F.col("current_node").alias("original_node"), F.lit(INTERRUPTED_REASON).alias("reason")), {"ignoreNullFields": "false"}).alias("payload"),
    )
    return fixed, recovery


def llm_columns(parsed: Column) -> list[Column]:
    """Call, attempt and token aggregates over model-call traces; ``parsed`` is the payload as VARIANT."""
    call = F.col("kind") == "llm_call"
    provider = js.field_text(parsed, "provider")
    attempt = F.greatest(F.lit(1), F.coalesce(js.field_int(parsed, "attempt"), F.lit(1)))
    success = call & (js.field_text(parsed, "status") == "success")
    tokens_in = F.when(call, js.field_int(parsed, "input_tokens"))
    tokens_out = F.when(call, js.field_int(parsed, "output_tokens"))

    def complete(value: Column) -> Column:
        """Total only when every call reported it; zero calls total zero."""
        return F.when(F.count(value) == F.count_if(call), F.coalesce(F.sum(value), F.lit(0)))

    return [
        F.count_if(call).alias("llm_calls"),
        F.sum(F.when(call, F.when(provider == "mock", 1).otherwise(attempt)).otherwise(0)).alias("http_attempts"),
        F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"),
        complete(tokens_in).alias("input_tokens_complete"), complete(tokens_out).alias("output_tokens_complete"),
        ((F.count_if(call) > 0) & (F.count_if(success) == 0)).alias("provider_failed"),
    ]


def task_rollup(traces: DataFrame) -> DataFrame:
    """Model-call totals per task."""
    parsed = traces.select("task_id", "kind", F.try_parse_json("payload").alias("_payload"))
    return parsed.groupBy("task_id").agg(*llm_columns(F.col("_payload")))


def node_rollup(traces: DataFrame) -> DataFrame:
    """Per task and node: summed and last duration of node timings."""
    parsed = traces.where("kind = 'node_timing'").select("task_id", "seq", F.try_parse_json("payload").alias("_payload"))
    timing = parsed.select(
        "task_id", "seq", js.field_text(F.col("_payload"), "node").alias("node"), js.field_int(F.col("_payload"), "duration_ms").alias("ms"))
    return timing.where("node is not null").groupBy("task_id", "node").agg(
        F.sum("ms").alias("duration_ms"),
        F.greatest(F.lit(0), F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("seq")))).alias("last_ms"))


def latest_report(reports: DataFrame, at: Column) -> DataFrame:
    """One report per task: the newest body, the first creation time."""
    return reports.groupBy("task_id").agg(
        F.max_by("body", at).alias("body"), F.min("recorded_at").alias("created_at"), F.max("recorded_at").alias("updated_at"))


def task_reports(tasks: DataFrame, rollup: DataFrame, reports: DataFrame) -> DataFrame:
    """The stored report row of each task as JSON with a fixed key order."""
    df = tasks.join(rollup, "task_id", "left").join(reports, "task_id", "left")
    body = F.struct(
        F.col("body").alias("diagnosis"), F.coalesce("http_attempts", F.lit(0)).alias("http_attempts"),
        F.coalesce("llm_calls", F.lit(0)).alias("llm_calls"), F.col("status"), F.col("task_id"))
    return df.select("task_id", "status", F.to_json(body, {"ignoreNullFields": "false"}).alias("json_report"))
