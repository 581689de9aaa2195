"""Trace and task queries, in batch and as streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import traces as tr
from evidentia.plans.registry import query
from evidentia.session import new_table_path, table
from evidentia.streaming import jobs


def _shape(events):
    """Events as traces: user is the task, the type decides the kind, values make the payload."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "llm_call").when(F.col("event_type") == "click", "tool_call").otherwise("node_timing")
    payload = F.to_json(F.struct(
        F.when(F.col("event_type") == "view", "retrieve_code").when(F.col("event_type") == "signup", "issue_parser")
        .otherwise("root_cause_analyzer").alias("node"),
        F.floor("value").cast("bigint").alias("duration_ms"),
        F.when(i % 4 == 0, "mock").otherwise("live").alias("provider"), (i % 4).alias("attempt"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.when(i % 50 != 0, i % 1000).alias("input_tokens"), (i % 300).alias("output_tokens")))
    return events.select(
        F.col("user_id").alias("task_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("recorded_at"),
        i.alias("arrival"), payload.alias("payload"), "event_type", "value")


def _updates(traces):
    status = (F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "completed")
              .when(F.col("event_type") == "error", "failed").otherwise("running"))
    return traces.select("task_id", "recorded_at", "arrival", status.alias("status"),
                         F.when(F.col("arrival") % 3 != 0, F.col("kind")).alias("node"),
                         F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("arrival").cast("string"))).alias("error"))


def traces(spark, sf):
    return _shape(table(spark, sf, "events"))


def trace_stream(spark, sf):
    """The events file as a file stream."""
    schema = table(spark, sf, "events").schema
    return _shape(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _paths(spark, name):
    return new_table_path(spark, name), new_table_path(spark, f"{name}-checkpoint")


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


_TR = """WITH tr AS (
  SELECT user_id AS task_id, event_id AS arrival, ts AS recorded_at, event_type, value,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'llm_call' WHEN event_type = 'click' THEN 'tool_call' ELSE 'node_timing' END AS kind,
    CASE event_type WHEN 'view' THEN 'retrieve_code' WHEN 'signup' THEN 'issue_parser' ELSE 'root_cause_analyzer' END AS node,
    floor(value)::BIGINT AS ms, CASE WHEN event_id % 50 <> 0 THEN event_id % 1000 END AS tin, event_id % 300 AS tout,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
up AS (SELECT task_id, recorded_at, arrival, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN arrival % 3 <> 0 THEN kind END AS node, CASE WHEN event_type = 'error' THEN 'e' || arrival END AS error, seq FROM tr),
st AS (SELECT task_id, arg_max(status, seq) AS status, min(CASE WHEN status = 'running' THEN recorded_at END) AS started_at,
    min(CASE WHEN status IN ('completed', 'failed') THEN recorded_at END) AS finished_at,
    arg_max(node, CASE WHEN node IS NOT NULL THEN seq END) AS current_node, arg_max(error, CASE WHEN error IS NOT NULL THEN seq END) AS error_message FROM up GROUP BY 1),
roll AS (SELECT task_id, count(*) FILTER (kind = 'llm_call') AS llm_calls,
    sum(CASE WHEN kind = 'llm_call' THEN CASE WHEN arrival % 4 = 0 THEN 1 ELSE greatest(1, arrival % 4) END ELSE 0 END)::BIGINT AS http_attempts,
    sum(CASE WHEN kind = 'llm_call' THEN tin END)::BIGINT AS input_tokens, sum(CASE WHEN kind = 'llm_call' THEN tout END)::BIGINT AS output_tokens,
    CASE WHEN count(CASE WHEN kind = 'llm_call' THEN tin END) = count(*) FILTER (kind = 'llm_call') THEN coalesce(sum(CASE WHEN kind = 'llm_call' THEN tin END), 0)::BIGINT END AS input_tokens_complete,
    coalesce(sum(CASE WHEN kind = 'llm_call' THEN tout END), 0)::BIGINT AS output_tokens_complete,
    count(*) FILTER (kind = 'llm_call') > 0 AND count(*) FILTER (event_type = 'purchase') = 0 AS provider_failed FROM tr GROUP BY 1)
"""
_FMT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
_STATUS = _TR + f"SELECT task_id, status, {_FMT.format('started_at')}, {_FMT.format('finished_at')}, current_node, error_message FROM st"


def _status_rows(df):
    return df.select("task_id", "status", _iso("started_at"), _iso("finished_at"), "current_node", "error_message")


@query("win_sequence", _TR + "SELECT task_id, arrival, seq FROM tr")
def win_sequence(spark, sf):
    return tr.sequenced(traces(spark, sf)).select("task_id", "arrival", "seq")


@query("srt_tasks", _TR + "SELECT task_id, min(strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f')) AS submitted_at FROM tr GROUP BY 1 ORDER BY 2 DESC")
def srt_tasks(spark, sf):
    t = traces(spark, sf).groupBy("task_id").agg(F.min("recorded_at").alias("submitted_at"))
    return t.orderBy(F.desc("submitted_at"), "task_id").select("task_id", _iso("submitted_at"))


@query("ag_trace_rollup", _TR + "SELECT * FROM roll")
def ag_trace_rollup(spark, sf):
    return tr.task_rollup(traces(spark, sf))


@query("ag_stage_durations", _TR + """SELECT task_id, node, sum(ms)::BIGINT AS duration_ms, greatest(0, arg_max(ms, seq)) AS last_ms
FROM tr WHERE kind = 'node_timing' GROUP BY 1, 2""")
def ag_stage_durations(spark, sf):
    return tr.node_rollup(tr.sequenced(traces(spark, sf)))


_REPORT = """, rep AS (SELECT task_id, arg_max('v' || arrival, seq) AS body, min(recorded_at) AS created_at, max(recorded_at) AS updated_at
  FROM tr WHERE event_type = 'purchase' GROUP BY 1)"""


def _reports(t):
    return t.where("event_type = 'purchase'").select(
        "task_id", "recorded_at", "arrival", F.concat(F.lit("v"), F.col("arrival").cast("string")).alias("body"))


@query("pl_task_report", _TR.rstrip() + _REPORT + """
SELECT task_id, status, '{"diagnosis":' || CASE WHEN body IS NULL THEN 'null' ELSE '"' || body || '"' END || ',"http_attempts":' || http_attempts || ',"llm_calls":' || llm_calls
  || ',"status":"' || status || '","task_id":' || task_id || '}' AS json_report FROM st JOIN roll USING (task_id) LEFT JOIN rep USING (task_id)""")
def pl_task_report(spark, sf):
    t = traces(spark, sf)
    reports = tr.latest_report(_reports(t), F.struct("recorded_at", "arrival"))
    return tr.task_reports(tr.task_status(_updates(t)), tr.task_rollup(t), reports.select("task_id", "body"))


# -------------------------------------------------------------------- streams
@query("st_trace_append", _TR + "SELECT task_id, arrival, seq, kind FROM tr WHERE task_id % 10 <> 0")
def st_trace_append(spark, sf):
    folder, checkpoint = _paths(spark, "traces")
    known = table(spark, sf, "events").where("user_id % 10 <> 0").select(F.col("user_id").alias("task_id"))
    jobs.append_traces(trace_stream(spark, sf), known, folder, checkpoint)
    return spark.read.parquet(f"{folder}/traces").select("task_id", "arrival", "seq", "kind")


def _status_table(spark, sf):
    folder, checkpoint = _paths(spark, "status")
    jobs.keyed_changes(jobs.status_stream(_updates(trace_stream(spark, sf))), folder, checkpoint)
    return jobs.current_rows(spark, folder, "task_id")


@query("st_task_status", _STATUS)
def st_task_status(spark, sf):
    return _status_rows(_status_table(spark, sf))


_NOW = "2030-01-01 00:00:00"


@query("st_interrupted", _TR + f"""SELECT task_id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN ('pending', 'running') THEN '{tr.INTERRUPTED_REASON}' ELSE error_message END AS error_message,
  CASE WHEN status IN ('pending', 'running') THEN 1 ELSE 0 END AS recovery_traces FROM st""")
def st_interrupted(spark, sf):
    fixed, recovery = tr.mark_interrupted(_status_table(spark, sf), F.lit(_NOW).cast("timestamp"))
    n = recovery.groupBy("task_id").agg(F.count(F.lit(1)).alias("recovery_traces"))
    return fixed.join(n, "task_id", "left").select(
        "task_id", "status", "error_message", F.coalesce("recovery_traces", F.lit(0)).alias("recovery_traces"))


@query("st_report_upsert", _TR.rstrip() + _REPORT + f" SELECT task_id, body, {_FMT.format('created_at')}, {_FMT.format('updated_at')} FROM rep")
def st_report_upsert(spark, sf):
    folder, checkpoint = _paths(spark, "reports")
    jobs.keyed_changes(jobs.report_stream(_reports(trace_stream(spark, sf))), folder, checkpoint)
    return jobs.current_rows(spark, folder, "task_id").select("task_id", "body", _iso("created_at"), _iso("updated_at"))


@query("st_trace_rollup", _TR + "SELECT task_id, node, count(*) AS traces, sum(ms)::BIGINT AS duration_ms FROM tr GROUP BY 1, 2")
def st_trace_rollup(spark, sf):
    folder, checkpoint = _paths(spark, "rollup")
    jobs.keyed_changes(jobs.rollup_stream(trace_stream(spark, sf)), folder, checkpoint)
    return jobs.current_rows(spark, folder, "task_id", "node")


# ---------------------------------------------------------------------- sinks
@query("snk_trace_tables", _TR + "SELECT strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS traces, count(DISTINCT task_id) AS tasks FROM tr GROUP BY 1")
def snk_trace_tables(spark, sf):
    from evidentia.sources.sinks import write_trace_tables

    t = traces(spark, sf)
    root = new_table_path(spark, "task-store")
    reports = tr.latest_report(_reports(t), F.struct("recorded_at", "arrival"))
    write_trace_tables(root, tr.task_status(_updates(t)), tr.sequenced(t).drop("event_type", "value"), reports)
    return spark.read.parquet(f"{root}/traces").groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("traces"), F.count_distinct("task_id").alias("tasks"))


@query("snk_case_artifacts", """SELECT 'r' || user_id % 3 AS run_id, event_id::VARCHAR AS case_id,
  '{"diff_sha256":"' || sha256('diff ' || event_id) || '","note":"see <path>","status":"' || event_type || '"}' AS record FROM events""")
def snk_case_artifacts(spark, sf):
    from evidentia.sources.sinks import write_case_artifacts

    e = table(spark, sf, "events").select(
        F.lit("mock").alias("mode"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.col("event_id").cast("string").alias("case_id"), F.col("event_type").alias("status"),
        F.lit("see /home/me/x").alias("note"),
        F.sha2(F.concat(F.lit("diff "), F.col("event_id").cast("string")), 256).alias("diff_sha256"))
    path = write_case_artifacts(e, new_table_path(spark, "artifacts"))
    return spark.read.schema("case_id string, record string, mode string, run_id string").json(path).select("run_id", "case_id", "record")
