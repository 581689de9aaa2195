"""URL filters: a sort-merge range join of urls with host and path rules.

A url's canonical key is its host with the labels reversed, each followed by a dot, and then the
path (``net.example.blog./en/1``).  A rule for a host and its subdomains is the interval of keys
that begin with the rule's reversed host.  Keys are dealt to ranges of about equal numbers of
rows (the rows of one very common key to several ranges that all hold it); a rule goes to
every range that its interval meets.  In a range, rules and urls are sorted together and
swept once, with a stack of the rules whose intervals are open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.tables import free_name

RANGE_ROWS = 100_000
#: Keys looked at to place the ranges, for each range; the layout never changes a result.
SAMPLED = 40
_LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a url; both empty without ``://`` or for null."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.regexp_replace(text, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def reversed_host(host: Column) -> Column:
    """``blog.example.net`` as ``net.example.blog.``"""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """Open rules over sorted rows: a stack of (reversed host, [(path, verdict, rule)])."""

    def __init__(self):
        self.stack: list[tuple[str, list]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, verdict: str, rule: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, []))
        self.stack[-1][1].append((path, verdict, rule))

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        for _, rules in reversed(self.stack):
            fitting = [r for r in rules if path.startswith(r[0])]
            if fitting:
                best = max(fitting, key=lambda r: (len(r[0]), r[1] == "block"))
                return best[2], best[1]
        return None, None


def _deal(bounds: list[str]):
    """Adds the range of each row: a url's one, a copy of a rule for every range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, (is_url, key, spread) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("is_url", "full", "spread")), strict=True)):
                low = bisect_left(bounds, key)
                if is_url:
                    here = [low + spread % (bisect_right(bounds, key) - low + 1)]
                else:
                    here = range(low, bisect_right(bounds, key + _LAST) + 1)
                rows += [i] * len(here)
                parts += here
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts, pa.int32())], names=[*batch.schema.names, "part"])
    return run


def _sweep(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, part = Sweep(), None
        for batch in batches:
            found = []
            for p, is_url, key, path, verdict, rule in zip(*(batch.column(c).to_pylist() for c in ("part", "is_url", "key", "path", "verdict", "rule")), strict=True):
                if p != part:
                    sweep, part = Sweep(), p
                if is_url:
                    found.append(sweep.judge(key, path))
                else:
                    sweep.rule(key, path, verdict, rule)
            urls = batch.filter(batch.column("is_url"))
            yield pa.RecordBatch.from_arrays(
                [urls.column(n) for n in names] + [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=[*names, "rule", "verdict"])
    return run


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """The input's columns with host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block); a rule fits its host and all
    subdomains if the url's path begins with the rule's.  The rule with the longest host wins,
    then the longest path, then block.  Rows without a fitting rule get a null rule and the
    default.  Null or odd urls have an empty host and path, which no rule with a host fits.
    New columns whose names are taken get an underscore.
    """
    spark = pages.sparkSession
    names = [f"c{i}" for i in range(len(pages.columns))]
    host, path = host_and_path(pages[pages.columns.index(url_col)])
    urls = pages.select(*(pages[i].alias(n) for i, n in enumerate(names)), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("full", F.concat(reversed_host(F.col("host")), "path"))
    given = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select(
        reversed_host(F.lower("host")).alias("key"), "path", "verdict", F.concat("host", "path").alias("rule")).distinct()

    rows = urls.count()
    ranges = ranges or max(1, rows // RANGE_ROWS)
    fraction = min(1.0, SAMPLED * ranges / max(1, rows))
    sampled = sorted(r[0] for r in urls.sample(fraction=fraction, seed=9).select("full").collect()) if ranges > 1 else []
    bounds = [sampled[len(sampled) * i // ranges] for i in range(1, ranges)] if sampled else []

    no = F.lit(None).cast("string")
    held = [*names, "host"]
    tagged = urls.select(F.lit(True).alias("is_url"), reversed_host(F.col("host")).alias("key"), "path", no.alias("verdict"), no.alias("rule"), "full",
                         F.pmod(F.xxhash64(*names), F.lit(1 << 20)).alias("spread"), *held)
    opened = given.select(F.lit(False).alias("is_url"), "key", "path", "verdict", "rule", F.col("key").alias("full"), F.lit(0).cast("long").alias("spread"),
                          *(F.lit(None).cast(tagged.schema[n].dataType).alias(n) for n in held))
    rows = tagged.union(opened)
    both = rows.mapInArrow(_deal(bounds), rows.withColumn("part", F.lit(0)).schema).repartition("part").sortWithinPartitions("part", "full", "is_url")
    schema = spark.createDataFrame([], tagged.select(*held, "path", "rule", "verdict").schema).schema
    done = both.mapInArrow(_sweep([*held, "path"]), schema)
    new = [free_name(pages, n) for n in ("host", "path", "rule", "verdict")]
    return done.select(*names, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).toDF(*pages.columns, *new)
