"""Content hashes, manifests, freeze checks and contamination audits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import phrases

# Texts that must not occur in test sources, as patterns.
PROHIBITED_TEST_TEXT = [
    "expected_fix", "reference patch", "repair gold", "solution hint", "change application",
    "replace .* with", "modify .* to", "correct annotation", "correct key",
]
PUBLIC_TREE_SKIP = [".git", "target", "artifacts", "benchmark"]
MIN_LEAK_SYMBOL = 8
MIN_FAMILIES, MAX_PER_FAMILY = 6, 2
# end fixed values


def canonical_bytes(content: Column) -> Column:
    """BINARY content with unified line ends when it is UTF-8; other bytes untouched."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), tx.canonical_newlines(text).cast("binary")).otherwise(content.cast("binary"))


def file_manifest(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, file, sha256) of raw content."""
    return files.select(*keys, "file", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def tree_hash(files: DataFrame, keys: Sequence[str], out: str = "tree_sha256") -> DataFrame:
    """One sha256 per key over ``path NUL content NUL`` in path order.

    The rows of a tree are sorted by the shuffle and streamed through a running
    digest, so memory does not grow with the tree.  The digest is sequential by
    definition; keys are case trees, not whole corpora.
    """
    skip = F.exists(F.split("file", "/"), lambda p: p.isin(*PUBLIC_TREE_SKIP))
    rows = (
        files.where(~skip)
        .select(*[F.col(k).cast("string").alias(k) for k in keys], "file", canonical_bytes(F.col("content")).alias("content"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "file")
    )
    names = list(keys)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, running = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                key = tuple(row[: len(names)])
                if key != current:
                    if current is not None:
                        done.append((*current, running.hexdigest()))
                    current, running = key, hashlib.sha256()
                running.update(row[-2].encode("utf-8"))
                running.update(b"\0")
                running.update(row[-1])
                running.update(b"\0")
            if done:
                yield pd.DataFrame(done, columns=[*names, out])
        if current is not None:
            yield pd.DataFrame([(*current, running.hexdigest())], columns=[*names, out])

    schema = ", ".join(f"{k} string" for k in names) + f", {out} string"
    return rows.mapInPandas(digest, schema)


def record_hash(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """sha256 of the compact JSON of each record with sorted keys; nulls are written."""
    record = F.struct(*[F.col(f) for f in sorted(fields)])
    body = F.to_json(record, {"ignoreNullFields": "false"})
    return df.select(key, F.sha2(body, 256).alias("sha256"))


def manifest_diff(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Paths whose hash differs, appears or disappears."""
    b = before.select(*keys, "file", F.col("sha256").alias("before"))
    a = after.select(*keys, "file", F.col("sha256").alias("after"))
    return b.join(a, [*keys, "file"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def change_scope(file: Column) -> Column:
    """Which protected part of a repository a changed path belongs to."""
    return F.when(F.startswith(file, F.lit("src/test/")), "tests").when(file == "pom.xml", "pom").otherwise("other")


def freeze_check(frozen: DataFrame, actual: DataFrame) -> DataFrame:
    """Frozen (section, file, sha256) against actual hashes; a missing file is a mismatch."""
    seen = actual.select("file", F.col("sha256").alias("_actual"))
    return frozen.join(seen, "file", "left").select(
        "section", "file", F.coalesce("_actual", F.lit("missing")).alias("actual"),
        (F.coalesce("_actual", F.lit("missing")) == F.col("sha256")).alias("intact"),
    )


def section_status(checked: DataFrame) -> DataFrame:
    return checked.groupBy("section").agg(
        F.bool_and("intact").alias("intact"), F.count_if(~F.col("intact")).alias("mismatches"),
        F.count(F.lit(1)).alias("files"))


def term_leaks(texts: DataFrame, terms: DataFrame, index: phrases.Phrases | None = None) -> DataFrame:
    """(repo, file, term): which lower-cased text contains which term, anywhere; ``index`` is that of ``phrases.build``."""
    return phrases.holding(phrases.build(texts) if index is None else index, terms)


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that occur in a text, in list order."""
    def holds(p: str) -> Column:
        return F.contains(text, F.lit(p)) if re.fullmatch(r"[\w ]+", p) else text.rlike(p)  # a plain text needs no pattern

    return F.array_compact(F.array(*[F.when(holds(p), F.lit(p)) for p in patterns]))


def literal_hits(text: Column, tokens: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in tokens]))


def novelty(fresh: DataFrame, known: DataFrame, copied: DataFrame, min_families: int = MIN_FAMILIES, max_per_family: int = MAX_PER_FAMILY) -> DataFrame:
    """One verdict row: no shared trees, no shared descriptions, nothing copied, balanced families.

    ``fresh`` and ``known`` are (tree_sha256, description, family); ``copied``
    lists the copies that were found.
    """
    def shared(column: str) -> DataFrame:
        return fresh.select(column).intersect(known.select(column)).agg(F.count(F.lit(1)).alias(f"shared_{column}"))

    families = fresh.groupBy("family").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("families"), F.max("n").alias("largest_family"))
    # four one-row counts are stacked and folded into one row
    stacked = (
        shared("tree_sha256")
        .unionByName(shared("description"), allowMissingColumns=True)
        .unionByName(families, allowMissingColumns=True)
        .unionByName(copied.agg(F.count(F.lit(1)).alias("copied")), allowMissingColumns=True)
    )
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    ok = (
        (F.col("shared_tree_sha256") == 0) & (F.col("shared_description") == 0) & (F.col("copied") == 0)
        & (F.col("families") >= min_families) & (F.col("largest_family") <= max_per_family)
    )
    return row.withColumn("passed", ok)


def check_rows(check: str, df: DataFrame, passed: Column, detail: Column | None = None) -> DataFrame:
    """One PASS/FAIL row per input row in the common shape of integrity reports."""
    return df.select(
        F.lit(check).alias("check"), F.col("case_id").cast("string").alias("case_id"), passed.alias("passed"),
        (detail if detail is not None else F.lit("")).cast("string").alias("detail"))
