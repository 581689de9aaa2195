"""Unified patch texts: touched paths and changed-line counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx

# Fixed value: the header of a file section.
HEADER = r"(?m)^diff --git a/(.+) b/\1$"


def patch_stats(patches: DataFrame, *keys: str, patch: str = "patch") -> DataFrame:
    """Per patch: paths, added and removed lines, and the larger of the two counts."""
    lines = tx.lines_of(F.col(patch))
    removed = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))
    added = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))))
    return patches.select(
        *keys,
        # sections that rename a file name no single touched path
        F.array_distinct(F.regexp_extract_all(patch, F.lit(HEADER), 1)).alias("paths"),
        removed.cast("bigint").alias("removed"), added.cast("bigint").alias("added"),
        F.greatest(removed, added).cast("bigint").alias("logical_changes"),
    )
