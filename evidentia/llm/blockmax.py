"""Exact top-k inner products of integer vectors by block-at-a-time pruning.

A dimension is a term and a vector a document.  Documents are put in an order that brings
similar ones together and cut into ranges of ``BLOCK`` documents.  A block keeps, per term, its
largest and smallest weight, and its forward index (the rows' weights).  A query's bound for a
block is the sum over terms of its weight times the maximum (the minimum where the weight is
negative).  Per query, blocks are scored from the highest bound down, through their forward
indexes, until the bound falls below the k-th score.

Blocks are grouped to shards and queries to groups, both of bounded size; each pair of a shard
and a query group is one unit of work that returns k rows per query, merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.tables import written
from evidentia.operators.ranking import top_k

BLOCK = 128
SHARD_BLOCKS = 128
QUERY_GROUP = 512
_EXACT = float(1 << 53)

def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of consecutive vectors in the order that they come in."""
    ids: list[int] = []
    rows: list[np.ndarray] = []
    whole = BLOCK * SHARD_BLOCKS
    for batch in batches:
        ids += batch["id"].tolist()
        rows += [np.asarray(w, dtype=np.int64) for w in batch["weights"]]
        while len(ids) >= whole:
            yield _shard(ids[:whole], rows[:whole])
            ids, rows = ids[whole:], rows[whole:]
    if ids:
        yield _shard(ids, rows)


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max([1, *(len(r) for r in rows)])), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _shard(ids: list[int], rows: list[np.ndarray]) -> pd.DataFrame:
    weights = _matrix(rows)
    return pd.DataFrame({"shard": [ids[0]], "ids": [np.array(ids, dtype=np.int64).tobytes()], "weights": [weights.tobytes()], "width": [weights.shape[1]]})


def search_shard(ids: np.ndarray, weights: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, score) of the k best candidates of each query, ties to smaller ids."""
    width = max(weights.shape[1], queries.shape[1])
    weights = np.pad(weights, ((0, 0), (0, width - weights.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    begins = np.arange(0, len(ids), BLOCK)
    most, least = np.maximum.reduceat(weights, begins), np.minimum.reduceat(weights, begins)
    reach = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(weights.astype(float)).max(initial=0)) * width
    # sums below 2**53 are exact in double precision; beyond, Python's whole numbers
    kind = np.float64 if reach < _EXACT else object
    weights, queries, most, least = (x.astype(kind) for x in (weights, queries, most, least))
    bounds = np.maximum(queries, 0).dot(most.T) + np.minimum(queries, 0).dot(least.T)
    out = []
    for q in range(len(query_ids)):
        order = np.argsort(-bounds[q], kind="stable")
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        at, step = 0, 2
        while at < len(order):
            if len(best) >= k:
                order_left = order[at:at + step]
                todo = order_left[bounds[q][order_left] >= best[-1]]
                if not len(todo):
                    break
            else:
                todo = order[at:at + step]
            at += step
            step = min(16, step * 2)
            rows = np.concatenate([np.arange(begins[b], min(begins[b] + BLOCK, len(ids))) for b in todo])
            rows = rows[ids[rows] != query_ids[q]]
            scores = np.concatenate([best, weights[rows].dot(queries[q])])
            names = np.concatenate([best_ids, ids[rows]])
            keep = np.lexsort((names, -scores))[:k]
            best_ids, best = names[keep], scores[keep]
        out += [(int(query_ids[q]), int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]
    return out


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(right):
            query_ids = right["query_id"].to_numpy(dtype=np.int64)
            queries = _matrix([np.asarray(w, dtype=np.int64) for w in right["weights"]])
            for ids, weights, width in zip(left["ids"], left["weights"], left["width"], strict=True):
                out += search_shard(np.frombuffer(ids, dtype=np.int64), np.frombuffer(weights, dtype=np.int64).reshape(-1, width), query_ids, queries, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products, ties to smaller ids.

    Both inputs have (id long, weights array<long>), whole and non-null; ids are unique.
    A query never meets the candidate with its own id.  Missing weights count as 0.
    """
    halves = F.array_join(F.transform("weights", lambda w: F.when(w < 0, "0").otherwise("1")), "")
    largest = F.array_position(F.transform("weights", F.abs), F.array_max(F.transform("weights", F.abs)))
    ordered = (vectors.select("id", "weights", F.concat(F.lpad(F.coalesce(largest, F.lit(0)).cast("string"), 6, "0"), halves).alias("near"))
               .repartitionByRange("near", "id").sortWithinPartitions("near", "id").select("id", "weights"))
    shards = written(ordered.mapInPandas(_blocks, "shard long, ids binary, weights binary, width int"), "blockmax")
    count = queries.count()
    groups = max(1, -(-count // QUERY_GROUP))
    asked = queries.select(F.col("id").alias("query_id"), "weights", F.pmod(F.xxhash64("id"), F.lit(groups).cast("long")).alias("grp"))
    held = shards.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    # every pair of a shard and a query group is work to do; the queries of a group go to each shard
    sent = asked.join(held.select(F.col("shard").alias("place"), "grp"), "grp").toDF("part", "query_id", "weights", "place")
    found = held.groupBy("shard", "grp").cogroup(sent.groupBy("place", "part")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
