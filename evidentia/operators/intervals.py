"""Line-range joins without pairing every range with every other.

Ranges of one file are first reduced to one row per distinct bound (with the
extreme of the other bound), so a group never holds more rows than the file has
lines, however many ranges point at it.  A running extreme over those bounds
then answers "is there a range that ..." for every probe at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _extreme_at(probes: DataFrame, ranges: DataFrame, keys: Sequence[str], pos: str, *, forward: bool) -> DataFrame:
    """(keys, pos, value) for each distinct probe position.

    forward: the largest ``end_line`` of ranges that start at or before it;
    backward: the smallest ``end_line`` of ranges that start at or after it.
    """
    reduce = F.max if forward else F.min
    bounds = ranges.groupBy(*keys, F.col("start_line").alias(pos)).agg(reduce("end_line").alias("_v"))
    points = probes.select(*keys, pos).distinct().withColumn("_v", F.lit(None).cast("bigint"))
    order = F.asc(pos) if forward else F.desc(pos)
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = bounds.withColumn("_probe", F.lit(False)).unionByName(points.withColumn("_probe", F.lit(True)))
    return every.withColumn("_x", reduce("_v").over(w)).where("_probe").select(*keys, pos, F.col("_x"))


def with_containment(probes: DataFrame, ranges: DataFrame, keys: Sequence[str], out: str = "contained") -> DataFrame:
    """Flags probes that lie inside at least one range of the same keys."""
    at = _extreme_at(
        probes.withColumn("_at", F.col("start_line")), ranges, keys, "_at", forward=True
    )
    return (
        probes.withColumn("_at", F.col("start_line"))
        .join(at, [*keys, "_at"], "left")
        .withColumn(out, F.coalesce(F.col("_x") >= F.col("end_line"), F.lit(False)))
        .drop("_at", "_x")
    )


def with_overlap(probes: DataFrame, ranges: DataFrame, keys: Sequence[str], out: str = "overlaps") -> DataFrame:
    """Flags probes that share a line with at least one range of the same keys."""
    at = _extreme_at(probes.withColumn("_at", F.col("end_line")), ranges, keys, "_at", forward=True)
    return (
        probes.withColumn("_at", F.col("end_line"))
        .join(at, [*keys, "_at"], "left")
        .withColumn(out, F.coalesce(F.col("_x") >= F.col("start_line"), F.lit(False)))
        .drop("_at", "_x")
    )


def with_enclosed(probes: DataFrame, ranges: DataFrame, keys: Sequence[str], out: str = "encloses") -> DataFrame:
    """Flags probes that enclose at least one whole range of the same keys."""
    at = _extreme_at(probes.withColumn("_at", F.col("start_line")), ranges, keys, "_at", forward=False)
    return (
        probes.withColumn("_at", F.col("start_line"))
        .join(at, [*keys, "_at"], "left")
        .withColumn(out, F.coalesce(F.col("_x") <= F.col("end_line"), F.lit(False)))
        .drop("_at", "_x")
    )


def range_arrays(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """The ranges of each key as one array; for the few ranges that a search returns per case and file."""
    return df.groupBy(*keys).agg(F.collect_set(F.struct("start_line", "end_line")).alias("_ranges"), *more)


def check_evidence(refs: DataFrame, snippets: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Verdict of every evidence reference against the retrieved ranges of its case.

    Adds ``reason`` (null when kept) and, for a range outside all snippets, the
    widest one.  Each candidate left without evidence adds a row of its own with
    ``evidence_index`` -1.  ``max_candidates`` looks at the first candidates only.
    Snippets are search hits, a few per case and file, and travel as arrays.
    """
    keys = ["case_id", "file"]
    used = refs if max_candidates is None else refs.where(F.col("candidate_index") < max_candidates)
    widest = F.max(F.struct(
        (F.col("end_line") - F.col("start_line")).alias("w"), (-F.col("rank")).alias("r"),
        F.col("start_line").alias("widest_start"), F.col("end_line").alias("widest_end"))).alias("_wide")
    marked = used.join(range_arrays(snippets, keys, widest), keys, "left")
    start, end = F.col("start_line"), F.col("end_line")
    contained = F.exists("_ranges", lambda r: (r["start_line"] <= start) & (r["end_line"] >= end))
    reason = (
        F.when(F.col("_wide").isNull(), "file_not_in_retrieved_snippets")
        .when(start > end, "start_line_greater_than_end_line")
        .when(~contained, "line_range_outside_snippet")
    )
    outside = F.col("reason") == "line_range_outside_snippet"
    verdicts = marked.withColumn("reason", reason).select(
        "case_id", "candidate_index", "evidence_index", "file", "start_line", "end_line", "reason",
        F.when(outside, F.col("_wide.widest_start")).alias("widest_start"),
        F.when(outside, F.col("_wide.widest_end")).alias("widest_end"),
    )
    candidate = Window.partitionBy("case_id", "candidate_index")
    counted = verdicts.withColumns({
        "_kept": F.count_if(F.col("reason").isNull()).over(candidate),
        "_no": F.row_number().over(candidate.orderBy("evidence_index", "file", "start_line", "end_line"))})
    fields = ["evidence_index", "file", "start_line", "end_line", "reason", "widest_start", "widest_end"]
    none = F.lit(None).cast("bigint")
    empty = F.struct(
        F.lit(-1).cast("bigint").alias("evidence_index"), F.lit("").alias("file"), none.alias("start_line"), none.alias("end_line"),
        F.lit("candidate_no_valid_evidence").alias("reason"), none.alias("widest_start"), none.alias("widest_end"))
    row = F.struct(*[F.col(c).cast("bigint").alias(c) if c not in ("file", "reason") else F.col(c) for c in fields])
    rows = F.when((F.col("_kept") == 0) & (F.col("_no") == 1), F.array(row, empty)).otherwise(F.array(row))
    return counted.select("case_id", "candidate_index", F.explode(rows).alias("_v")).select("case_id", "candidate_index", "_v.*")


def target_status(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """exact_containment, overlap_only or miss for each gold range; a case's evidence per file is a few ranges."""
    marked = targets.join(range_arrays(evidence, ["case_id", "file"]), ["case_id", "file"], "left")
    start, end = F.col("start_line"), F.col("end_line")
    encloses = F.exists("_ranges", lambda r: (r["start_line"] >= start) & (r["end_line"] <= end))
    overlaps = F.exists("_ranges", lambda r: (r["start_line"] <= end) & (r["end_line"] >= start))
    return marked.withColumn(
        "status", F.when(encloses, "exact_containment").when(overlaps, "overlap_only").otherwise("miss")).drop("_ranges")
