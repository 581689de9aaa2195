"""Search queries built from everything known about a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx

# Shapes of exception and annotation names.
EXCEPTION = r"\b([A-Z][A-Za-z0-9_]*Exception)\b"
ANNOTATION_START = r"^@([A-Z][A-Za-z0-9_]*)"
# end fixed values


def build_queries(
    cases: DataFrame, issue: Column, log: Column, search_terms: Column, concepts: Column, symbols: Column,
    exceptions: Column, step_terms: Column, step_symbols: Column, mined: Column, max_terms: int | None = None,
    max_symbols: int | None = None, max_exceptions: int | None = None, max_annotations: int | None = None,
) -> DataFrame:
    """Adds terms, exact_symbols, exception_types and annotations.

    Arrays may be null.  Sources are merged in a fixed order, first seen wins.
    The limits keep the first items of a list; by default all are kept.
    """
    none = F.array().cast("array<string>")

    def given(a: Column) -> Column:
        return F.filter(F.coalesce(a, none), lambda x: ~x.rlike(r"^\s*$"))

    issue, log = F.coalesce(issue, F.lit("")), F.coalesce(log, F.lit(""))
    in_issue = F.regexp_extract_all(issue, F.lit(EXCEPTION), 1)
    in_log = F.regexp_extract_all(log, F.lit(EXCEPTION), 1)
    long_names = F.filter(F.regexp_extract_all(issue, F.lit(tx.IDENTIFIER), 0), lambda x: F.length(x) >= 3)
    raw = F.concat(
        long_names, in_issue, in_log, given(search_terms), given(concepts), given(symbols), given(exceptions),
        given(step_terms), given(step_symbols),
    )
    raw = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: F.length(x) >= 2))
    named = F.transform(
        F.filter(given(concepts), lambda c: c.rlike(ANNOTATION_START)), lambda c: F.regexp_extract(c, ANNOTATION_START, 1)
    )
    kinds = F.array_distinct(F.concat(in_issue, in_log, given(exceptions)))
    df = cases.withColumn("_raw", raw).withColumn("_kinds", kinds)
    df = df.withColumn("_terms", tx.normal_terms(F.col("_raw"), max_terms))
    # names of exceptions are searched with all their parts, stop words included
    parts = F.flatten(F.transform(
        F.filter("_kinds", lambda e: ~F.array_contains(F.col("_terms"), F.lower(e))), tx.identifier_tokens))
    return df.select(
        *cases.columns,
        tx.first_items(F.array_distinct(F.concat("_terms", parts)), max_terms).alias("terms"),
        tx.first_items(F.array_distinct(F.concat(given(symbols), given(step_symbols), given(mined))), max_symbols).alias("exact_symbols"),
        tx.first_items(F.col("_kinds"), max_exceptions).alias("exception_types"),
        tx.first_items(F.array_distinct(named), max_annotations).alias("annotations"),
    )
