"""Small shared steps: written tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import new_table_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: durable, and cuts the lineage."""
    spark = df.sparkSession
    path = new_table_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fold(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has two id columns u and v; the result has (id, component) for every id with
    an edge, component being the smallest id reachable.  Every round is a written table, no
    list of neighbours is ever collected, and a hub's rows are summed before they move.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, f"{name}-edges")
    before = _fold(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small")
        now = _fold(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return nodes.union(roots).groupBy("id").agg(F.min("component").alias("component"))

