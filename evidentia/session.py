"""Session helpers: building a local session, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side within both limits stays far below Spark's broadcast limits; anything
# larger goes through a shuffle join.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "8", app: str = "evidentia") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evidentia-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder, remembered
    for the life of the session; on a cluster that is an error, as executors and
    driver do not share local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evidentia/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A folder for a table of this application."""
    return f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


_dropped = 0


def drops() -> int:
    """How often tables were dropped; what is kept by name is void after the next drop."""
    return _dropped


def drop_tables(spark: SparkSession) -> None:
    """Deletes all tables this application has written by ``materialize``; results that read them are void."""
    global _dropped
    _dropped += 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage on durable storage, so a lost executor never forces the
    upstream work to be repeated, and later reads prune columns.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row; nested values count as the text that shows them."""
    total = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif "<" in kind:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(name)))), F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only after checking rows and bytes; else leave a shuffle join."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def rows_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> list | None:
    """The rows, to be sent to every task, if they are within the limits of a broadcast; else None."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return df.collect() if rows <= max_rows and (size or 0) <= max_bytes else None


def broadcast_if_light(df: DataFrame, *columns: str, max_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """The same check by size, for stored tables of short strings."""
    width = sum((F.octet_length(c) for c in columns), F.lit(64))
    total = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rebalances an input with fewer partitions than cores.

    A handful of large row groups would keep most cores idle through all the
    text work that follows; an input with enough splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def computed_once(df: DataFrame, **columns) -> DataFrame:
    """Adds columns that later expressions use many times.

    The optimizer may copy an expression into each of its uses, and inside a
    lambda it would then run once per element.  A one-row generator keeps the
    value computed, with no shuffle.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
