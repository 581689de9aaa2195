"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's rows are dealt to blocks of about equal words by a hash.  A source whose target
is q times its size draws all its blocks floor(q) times and then as many blocks as the rest
needs, each time in another order; of the last block only rows that fit are drawn.  So quotas
are exact numbers of blocks.  A tree splits them among the output shards: the root's vector of
quotas is divided in two by a multivariate-hypergeometric draw, and so on down to the shards.
Each shard then takes the next blocks of each source's order (disjoint from the other shards')
and shuffles its rows.

The driver sees one row per source and the tree of counts.  There are at most ``MAX_BLOCKS``
blocks and one more per source, so the block table may be broadcast; rows with text move once,
to their shards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.tables import free_name, word_count, written

MAX_BLOCKS = 100_000
LEAST_BLOCK_WORDS = 10_000
SHARD_WORDS = 8_000_000
NO_SOURCE = "-"


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of all sizes by weight; none above ``cap`` times its size, the excess reshared by weight."""
    limit = [Fraction(cap) * s for s in sizes]
    share = [Fraction(0)] * len(sizes)
    free, left = list(range(len(sizes))), Fraction(sum(sizes))
    while free:
        total = sum(Fraction(weights[i]) for i in free)
        above = [i for i in free if left * Fraction(weights[i]) > limit[i] * total]
        for i in above or free:
            share[i] = limit[i] if above else left * Fraction(weights[i]) / total
        if not above:
            break
        left -= sum(limit[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return [float(s) for s in share]


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns sum to the quotas, shards are equal but for one block."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(sum(quotas))
    edges = [total * i // shards for i in range(shards + 1)]
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        low, high, here = todo.pop()
        if high - low == 1:
            out[low] = here
            continue
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(here, edges[middle] - edges[low], method="marginals")
        todo += [(low, middle, left), (middle, high, here - left)]
    return out


@dataclass
class Source:
    """What the mix knows of one source."""

    key: str
    size: int
    target: float
    blocks: int
    steps: list[int]  # of each pass's order, prime to the number of blocks
    offsets: list[int]
    passes: int = 0
    rest: float = 0.0
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the shards in the draw order


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit(NO_SOURCE)).otherwise(F.concat(F.lit("="), source.cast("string")))


def _sources(rows: DataFrame, weights: Sequence[float], cap: float, seed: int) -> list[Source]:
    found = {r[0]: int(r[1]) for r in rows.groupBy("skey").agg(F.sum("size")).collect()}
    keys = sorted(found, key=lambda k: (k == NO_SOURCE, k))
    sizes = [found[k] for k in keys]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(keys))], cap)
    words = max(LEAST_BLOCK_WORDS, sum(sizes) // MAX_BLOCKS)
    out = []
    for i, (key, size, target) in enumerate(zip(keys, sizes, wanted, strict=True)):
        blocks = max(1, size // words)
        rng = np.random.Generator(np.random.PCG64([seed, i, blocks]))
        steps = []
        passes = int(target // size) if size else 0
        for _ in range(passes + 1):
            step = int(rng.integers(1, blocks + 1))
            while gcd(step, blocks) != 1:
                step += 1
            steps.append(step)
        out.append(Source(key, size, target, blocks, steps, [int(x) for x in rng.integers(0, blocks, passes + 1)], passes, target - passes * size))
    return out


def _places(sources: dict[str, Source], last_only: bool):
    """Place of each block in each pass of its source (last_only: in the last, partial one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for skey, rows in batch.groupby("skey"):
                s = sources[skey]
                for p in range(s.passes if last_only else 0, s.passes + (1 if last_only else 0)):
                    place = (rows["block"].to_numpy() * s.steps[p] + s.offsets[p]) % s.blocks
                    yield pd.DataFrame({"skey": skey, "block": rows["block"], "words": rows["words"], "pass": p, "place": place + p * s.blocks})
    return run


def _fit(sources: dict[str, Source]):
    """Rows of a source's last block, long ones first, that fit what is left of its target."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "r", "did"], ascending=[False, True, True], kind="stable")
        left = float(rows["left"].iloc[0])
        taken = np.zeros(len(rows), dtype=bool)
        sizes = rows["size"].to_numpy()
        for i, size in enumerate(sizes):
            if 0 < size <= left:
                taken[i], left = True, left - size
        rest = np.flatnonzero(~taken & (sizes > 0))
        if len(rest):
            least = rest[np.argmin(sizes[rest])]
            if sizes[least] - left < left:
                taken[least] = True
        return rows.loc[taken, ["skey", "did", "r"]].drop_duplicates()
    return run


@dataclass
class Plan:
    sources: list[Source]
    seed: int
    drawn: DataFrame  # skey, block, draws array<struct<shard, pass, whole>>
    fitted: DataFrame  # skey, did, r of the rows drawn from partly drawn blocks


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return [_source_key(F.col(source_col)).alias("skey"), did.alias("did"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("r")]


def _block(sources: list[Source]) -> Column:
    """Block of a row; sources are few, so their block numbers are a map."""
    blocks = F.create_map(*(F.lit(x) for s in sources for x in (s.key, s.blocks)))
    return F.pmod(F.xxhash64(F.lit(1), F.col("r")), blocks[F.col("skey")].cast("long"))


def _plan(rows: DataFrame, weights: Sequence[float], cap: float, shards: int | None, seed: int) -> Plan:
    """rows: skey, did, r, size."""
    spark = rows.sparkSession
    sources = _sources(rows, weights, cap, seed)
    by_key = {s.key: s for s in sources}
    if not sources:
        none = spark.createDataFrame([], "skey string, block long, draws array<struct<shard:int,pass:int,whole:boolean>>")
        return Plan([], seed, none, rows.select("skey", "did", "r"))
    rows = rows.withColumn("block", _block(sources))
    blocks = written(rows.groupBy("skey", "block").agg(F.sum("size").alias("words")), "blocks")
    place = "skey string, block long, words long, pass int, place long"
    # an Arrow table becomes rows in the JVM; a list of rows would start Python workers of another kind beside the ones there are
    rest = spark.createDataFrame(pa.table({"skey": pa.array([s.key for s in sources], pa.string()), "rest": pa.array([s.rest for s in sources], pa.float64())}))
    # at most MAX_BLOCKS rows and a few: their running sums need no more than one window per source
    partial = (blocks.mapInPandas(_places(by_key, True), place).join(F.broadcast(rest), "skey")
               .withColumn("before", F.expr("sum(words) OVER (PARTITION BY skey ORDER BY place) - words")).where("before < rest AND words > 0")
               .withColumn("whole", F.expr("before + words <= rest")))
    partial = written(partial, "partial")
    last = {r[0]: int(r[1]) for r in partial.groupBy("skey").agg(F.max("place")).collect()}
    quotas = [last[s.key] + 1 if s.key in last else s.passes * s.blocks for s in sources]
    wanted = sum(s.target for s in sources)
    leaves = splitting_tree(quotas, shards or max(1, round(wanted / SHARD_WORDS)), seed)
    for i, s in enumerate(sources):
        s.ends = np.cumsum(leaves[:, i])
    left = partial.where("NOT whole").select("skey", "block", (F.col("rest") - F.col("before")).alias("left"))
    fitted = written(rows.join(F.broadcast(left), ["skey", "block"]).groupBy("skey").applyInPandas(_fit(by_key), "skey string, did long, r long"), "fitted")

    def to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["shard"] = [int(np.searchsorted(by_key[k].ends, p, side="right")) for k, p in zip(batch["skey"], batch["place"], strict=True)]
            yield batch[["skey", "block", "pass", "whole", "shard"]]

    columns = ["skey", "block", "place", "pass", "whole"]
    drawn = blocks.mapInPandas(_places(by_key, False), place).withColumn("whole", F.lit(True)).select(columns).union(partial.select(columns))
    drawn = (drawn.mapInPandas(to_shards, "skey string, block long, pass int, whole boolean, shard int").groupBy("skey", "block")
             .agg(F.sort_array(F.collect_list(F.struct("shard", "pass", "whole"))).alias("draws")))
    return Plan(sources, seed, written(drawn, "drawn"), fitted)


def _with_draws(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows with skey, did, r get draws, the (shard, pass) of each time they are drawn."""
    if not plan.sources:
        return rows.withColumn("draws", F.lit(None).cast("array<struct<shard:int,pass:int,whole:boolean>>"))
    fits = plan.fitted.withColumn("fits", F.lit(True))
    known = (rows.withColumn("block", _block(plan.sources)).join(F.broadcast(plan.drawn), ["skey", "block"], "left")
             .join(F.broadcast(fits), ["skey", "did", "r"], "left"))
    return known.withColumn("draws", F.filter("draws", lambda d: d["whole"] | F.col("fits"))).drop("block", "fits")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
             cap: float = 3, shards: int | None = None, seed: int = 1) -> DataFrame:
    """One row per document: its id, size (words; null: 0), source_size, target, taken, draws.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words; a
    target stops at ``cap`` times its source's size.  taken is size times the number of draws,
    each with its shard and pass.  Repeated rows share their fate.  No source is drawn beyond
    the next whole multiple of its size, so no document is taken more than ``cap`` times (whole
    ``cap``).  The same input and seed give the same plan whatever the partitions.
    """
    rows = written(docs.select(*_keyed(docs, id_col, text_col, source_col, seed), word_count(F.col(text_col)).alias("size")), "sizes")
    plan = _plan(rows, weights, cap, shards, seed)
    done = _with_draws(rows, plan)
    of = F.create_map(*(F.lit(x) for s in plan.sources for x in (s.key, s.target))) if plan.sources else F.create_map(F.lit(""), F.lit(0.0))
    sizes = F.create_map(*(F.lit(x) for s in plan.sources for x in (s.key, s.size))) if plan.sources else F.create_map(F.lit(""), F.lit(0))
    return done.select(F.when(F.col("did") != -(1 << 63), F.col("did")).alias(id_col), "size", sizes[F.col("skey")].cast("long").alias("source_size"),
                       of[F.col("skey")].cast("double").alias("target"), (F.col("size") * F.greatest(F.coalesce(F.size("draws"), F.lit(0)), F.lit(0))).alias("taken"),
                       F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"))).alias("draws"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
        cap: float = 3, shards: int | None = None, seed: int = 1) -> DataFrame:
    """The mixed rows: the input's columns with shard and pass, a row as often as it is drawn, each shard shuffled."""
    sized = written(docs.select(*_keyed(docs, id_col, text_col, source_col, seed), word_count(F.col(text_col)).alias("size")), "sizes")
    plan = _plan(sized, weights, cap, shards, seed)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *_keyed(docs, id_col, text_col, source_col, seed))
    drawn = _with_draws(rows, plan).select(*names, "r", F.explode("draws").alias("draw")).select(*names, "r", "draw.shard", "draw.pass")
    new = [free_name(docs, n) for n in ("shard", "pass")]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)  # a shard may span several, in order
    return (drawn.withColumn("order", F.xxhash64(F.lit(seed), "r", "pass")).repartitionByRange(parts, "shard", "order").sortWithinPartitions("shard", "order")
            .select(*names, "shard", "pass").toDF(*docs.columns, *new))
