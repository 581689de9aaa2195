"""Index tables on disk, in folders by a hash of their key: a search reads the folders of its own keys only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.session import new_table_path

MIN_BUCKETS, MAX_BUCKETS = 16, 1024
#: Parts of a folder, dealt by other columns, so that a frequent key is no single task or file.
PARTS = 4


def bucket_count(keys: int, keys_per_bucket: int) -> int:
    return min(MAX_BUCKETS, max(MIN_BUCKETS, keys // keys_per_bucket))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")).cast("int")


@dataclass
class Bucketed:
    """A written table with a folder per bucket of ``key``."""

    rows: DataFrame
    key: str
    buckets: int

    @classmethod
    def write(cls, rows: DataFrame, key: str, buckets: int, spread: list[str], sort: list[str], name: str) -> Bucketed:
        path = new_table_path(rows.sparkSession, name)
        part = F.pmod(F.xxhash64(*spread), F.lit(PARTS).cast("long"))
        (rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket", part).sortWithinPartitions("bucket", *sort)
         .write.partitionBy("bucket").option("compression", "zstd").parquet(path))
        return cls(rows.sparkSession.read.parquet(path), key, buckets)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that the keys fall in; at most all bucket numbers, a fixed number, are collected."""
        asked = sorted(r[0] for r in keys.select(bucket_of(self.key, self.buckets).alias("b")).distinct().collect())
        return self.rows.where(F.col("bucket").isin(asked)).drop("bucket")
