"""Structured Streaming jobs over the trace log.

Every job writes one folder per micro-batch and overwrites it when the batch is
retried, so the tables are exact after any failure.  Keyed results keep their
state in Spark's state store and write only the keys that changed; readers take
the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import jsontext as js
from evidentia.operators import traces as tr

BatchWriter = Callable[[DataFrame, int], None]


def run_to_end(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append") -> None:
    """Processes everything available, then stops; restarts continue from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _save(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:010d}")


def _load(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    except Exception as exc:  # nothing written yet
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def append_traces(stream: DataFrame, tasks: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends traces of known tasks with gap-free numbers; others go to ``rejected``.

    Numbers continue from the totals written by earlier batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = tasks.select("task_id").distinct()
        _save(batch.join(known, "task_id", "left_anti"), f"{folder}/rejected", batch_id)
        numbered = tr.sequenced(batch.join(known, "task_id", "left_semi"))
        earlier = _load(spark, f"{folder}/totals")
        if earlier is not None:
            before = earlier.where(F.col("batch") < batch_id).groupBy("task_id").agg(F.max("total").alias("_before"))
            numbered = numbered.join(before, "task_id", "left").withColumn(
                "seq", F.col("seq") + F.coalesce("_before", F.lit(0))).drop("_before")
        _save(numbered, f"{folder}/traces", batch_id)
        written = spark.read.parquet(f"{folder}/traces/batch={batch_id:010d}")
        _save(written.groupBy("task_id").agg((F.max("seq") + 1).alias("total")), f"{folder}/totals", batch_id)

    run_to_end(stream, write, checkpoint)


def keyed_changes(aggregated: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes the changed rows of a streaming aggregate, one folder per batch."""
    run_to_end(aggregated, lambda df, batch_id: _save(df, folder, batch_id), checkpoint, "update")


def current_rows(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """The newest row per key of a changes table."""
    df = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    values = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row")).select(*keys, "_row.*")


def status_stream(updates: DataFrame) -> DataFrame:
    """Streaming twin of ``task_status``."""
    return tr.task_status(updates)


def report_stream(reports: DataFrame) -> DataFrame:
    """Streaming twin of ``latest_report``."""
    return tr.latest_report(reports, F.struct("recorded_at", "arrival"))


def rollup_stream(traces: DataFrame, watermark: str | None = None) -> DataFrame:
    """Per task and node: calls and durations; with a watermark repeats are dropped and state expires."""
    df = traces
    if watermark is not None:
        df = df.withWatermark("recorded_at", watermark).dropDuplicatesWithinWatermark(["task_id", "arrival"])
    timed = df.select(
        "task_id", js.payload_text(F.col("payload"), "node").alias("node"),
        js.payload_int(F.col("payload"), "duration_ms").alias("ms"))
    return timed.groupBy("task_id", "node").agg(F.count(F.lit(1)).alias("traces"), F.sum("ms").alias("duration_ms"))
