"""Quality checks of case manifests against the files of their repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators.edits import code_slice
from evidentia.sources.records import unsafe_path


def check_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """First error of each gold range, and whether its symbol occurs anywhere in the case.

    targets: case_id, file, start_line, end_line, required_text, symbol.
    """
    met = targets.join(files.select("case_id", "file", "content"), ["case_id", "file"], "left")
    lines = tx.lines_of(F.col("content"))
    inside = code_slice(lines, F.col("start_line"), F.col("end_line"))
    error = (
        F.coalesce(
            unsafe_path(F.col("file")),
            F.when(F.col("content").isNull(), "file_missing")
            .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.size(lines)),
                  "range_outside_file")
            .when(F.exists("required_text", lambda t: ~F.contains(inside, t)), "required_text_missing"),
        )
    )
    symbols = targets.select("case_id", "symbol").distinct().join(
        files.where(~F.lower("file").rlike(r"(?:^|/)readme\.md\z")).select("case_id", "content"), "case_id")
    found = symbols.groupBy("case_id", "symbol").agg(F.bool_or(F.contains("content", F.col("symbol"))).alias("symbol_found"))
    return met.withColumn("error", error).drop("content").join(found, ["case_id", "symbol"], "left").fillna(False, ["symbol_found"])
