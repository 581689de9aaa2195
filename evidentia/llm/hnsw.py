"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors of one length are dealt to shards of about ``SHARD_BYTES`` by a hash of their id.  In a shard, equal
vectors are one node (a graph of thousands of equal points would fall apart), and a row gets
an extra component that makes all lengths equal, so the largest inner product is the nearest
point.  A layer is one flat array of neighbour numbers, -1 where there is none.  Points are
inserted in small batches, searched for together; neighbours are chosen for diversity.

The index is a written table with one row per shard.  Every query meets every shard, as any may
hold its nearest: a shard's row is sent once for each group of ``QUERY_GROUP`` queries, decoded
once, and the queries stream past it.  Only as many nodes as the result needs, by their distances
in single precision, get exact products; the shards' best are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import written
from evidentia.operators.ranking import top_k
from evidentia.session import broadcast_if_small

#: Bytes of the vectors of one shard (16,384 rows of 64 dimensions).
SHARD_BYTES = 8 << 20
LINKS = 16  # per layer; twice that on the lowest
BUILD_WIDTH = 64
BATCH = 512
#: Queries that share one copy of a shard's index, and those searched for together.
QUERY_GROUP = 65_536
LOT = 512
#: Distances of unit vectors this near to each other may stand in the wrong order in single precision.
ROUNDING = 1e-4


def _search_layer(points, links, queries, entries, width):
    """The ``width`` nearest nodes found for each query, as (nodes, distances), nearest first; -1 and inf where fewer."""
    rows = np.arange(len(queries))[:, None]
    count = len(queries)
    seen = np.zeros((count, len(points) + 1), dtype=bool)  # the last column stands for -1
    seen[:, -1] = True
    nodes = np.full((count, width), -1, dtype=np.int64)
    far = np.full((count, width), np.inf, dtype=np.float32)
    done = np.ones((count, width), dtype=bool)
    nodes[:, 0] = entries
    far[:, 0] = 1 - np.einsum("qd,qd->q", queries, points[entries])
    done[:, 0] = False
    seen[np.arange(count), entries] = True
    active = np.arange(count)
    while len(active):
        waiting = np.where(done[active], np.inf, far[active])
        pick = np.argsort(waiting, axis=1)[:, :2]  # the two nearest not yet expanded
        ok = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        active, pick, ok = active[ok[:, 0]], pick[ok[:, 0]], ok[ok[:, 0]]
        if not len(active):
            break
        done[active[:, None], pick] = True
        near = np.where(ok[:, :, None], links[nodes[active[:, None], pick]], -1).reshape(len(active), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        new = 1 - np.einsum("qd,qnd->qn", queries[active], points[near])
        new[near < 0] = np.inf
        all_far = np.concatenate([far[active], new], axis=1)
        keep = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        far[active] = np.take_along_axis(all_far, keep, axis=1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], axis=1), keep, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], near < 0], axis=1), keep, axis=1)
    del rows
    return nodes, far


def _choose(points, center, nodes, far, limit):
    """Diverse neighbours: a node is taken if it is nearer to the centre than to any taken one; nearest of the rest fill up."""
    count, width = nodes.shape
    taken = np.full((count, limit), -1, dtype=np.int64)
    number = np.zeros(count, dtype=np.int64)
    rest = np.zeros((count, width), dtype=bool)
    for j in range(width):
        node = nodes[:, j]
        valid = (node >= 0) & (number < limit)
        if not valid.any():
            continue
        at = np.flatnonzero(valid)
        others = taken[at]
        between = 1 - np.einsum("qd,qnd->qn", points[node[at]], points[others])
        between[others < 0] = np.inf
        good = far[at, j] < between.min(axis=1)
        rest[at[~good], j] = True
        at = at[good]
        taken[at, number[at]] = node[at]
        number[at] += 1
    for j in range(width):
        at = np.flatnonzero(rest[:, j] & (number < limit))
        taken[at, number[at]] = nodes[at, j]
        number[at] += 1
    return taken


class Graph:
    """Flat neighbour arrays of one shard: layers[l] is (nodes, links), all nodes numbered alike."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], top: int):
        self.points, self.layers, self.top = points, layers, top

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 0) -> Graph:
        n = len(points)
        level = np.floor(-np.log(np.random.Generator(np.random.PCG64(seed)).random(n)) / np.log(LINKS)).astype(np.int64)
        level[0] = max(level.max(initial=0), 1)  # the first point is in every layer: the entry
        layers = [np.full((n, LINKS * (2 if i == 0 else 1)), -1, dtype=np.int64) for i in range(int(level[0]) + 1)]
        graph, at = cls(points, layers, 0), 1
        while at < n:
            end = min(n, at + max(1, min(BATCH, at)))
            graph._insert(np.arange(at, end), level)
            at = end
        return graph

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        points = self.points
        entries = np.zeros(len(new), dtype=np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            links = self.layers[layer]
            here = level[new] >= layer
            width = BUILD_WIDTH if here.any() else 1
            nodes, far = _search_layer(points, links, points[new], entries, width)
            entries = nodes[:, 0]
            if not here.any():
                continue
            own = new[here]
            between = 1 - points[own] @ points[own].T  # points of one batch may be neighbours too
            np.fill_diagonal(between, np.inf)
            all_far = np.concatenate([far[here], between.astype(np.float32)], axis=1)
            all_nodes = np.concatenate([nodes[here], np.broadcast_to(own, (len(own), len(own)))], axis=1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :BUILD_WIDTH]
            all_far, all_nodes = np.take_along_axis(all_far, keep, axis=1), np.take_along_axis(all_nodes, keep, axis=1)
            all_nodes[~np.isfinite(all_far)] = -1
            chosen = _choose(points, own, all_nodes, all_far, LINKS)
            links[own, :LINKS] = chosen
            source, target = np.repeat(own, LINKS), chosen.ravel()
            source, target = source[target >= 0], target[target >= 0]
            self._link_back(links, source, target)

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        points, limit = self.points, links.shape[1]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), limit + int(count.max())), -1, dtype=np.int64)
        wide[:, :limit] = links[nodes]
        wide[np.repeat(np.arange(len(nodes)), count), limit + np.arange(len(target)) - np.repeat(begin, count)] = source
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        size = (wide >= 0).sum(axis=1)
        small = size <= limit
        fits = np.sort(wide[small], axis=1)[:, ::-1][:, :limit]
        links[nodes[small], :fits.shape[1]] = fits
        big = ~small
        if big.any():
            far = 1 - np.einsum("qd,qnd->qn", points[nodes[big]], points[wide[big]])
            far[wide[big] < 0] = np.inf
            keep = np.argsort(far, axis=1, kind="stable")
            links[nodes[big]] = _choose(points, nodes[big], np.take_along_axis(wide[big], keep, axis=1), np.take_along_axis(far, keep, axis=1), limit)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes near each query and their distances, nearest first; -1 and inf where fewer."""
        entries = np.full(len(queries), self.top, dtype=np.int64)
        for links in self.layers[:0:-1]:
            entries = _search_layer(self.points, links, queries, entries, 1)[0][:, 0]
        return _search_layer(self.points, self.layers[0], queries, entries, min(width, len(self.points)))


def _even_lengths(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors scaled to at most length 1 with a component that makes it exactly 1."""
    scale = float(np.sqrt((vectors ** 2).sum(axis=1).max(initial=0))) or 1.0
    inner = vectors / scale
    rest = np.sqrt(np.maximum(0, 1 - (inner ** 2).sum(axis=1)))
    return np.concatenate([inner, rest[:, None]], axis=1).astype(np.float32), scale


def _index(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("id")
    vectors = np.stack(shard["vector"].to_numpy()).astype(np.float64)
    distinct, member = np.unique(vectors, axis=0, return_inverse=True)
    shuffled = np.random.Generator(np.random.PCG64(len(distinct))).permutation(len(distinct))
    place = np.empty_like(shuffled)
    place[shuffled] = np.arange(len(shuffled))
    distinct, member = distinct[shuffled], place[member.ravel()]
    graph = Graph.build(_even_lengths(distinct)[0])
    return pd.DataFrame({
        "dim": [shard["dim"].iloc[0]], "shard": [shard["shard"].iloc[0]], "width": [vectors.shape[1]], "nodes": [len(distinct)], "vectors": [distinct.tobytes()],
        "ids": [shard["id"].to_numpy(dtype=np.int64).tobytes()], "member": [member.astype(np.int32).tobytes()],
        "links": [[x.astype(np.int32).tobytes() for x in graph.layers]],
    })


HELD = ["width", "nodes", "vectors", "ids", "member", "links"]
INDEX = "dim int, shard long, width int, nodes int, vectors binary, ids binary, member binary, links array<binary>"


def _search_shard(row: dict, names: np.ndarray, queries: np.ndarray, k: int, width: int, kept: dict) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Ids of the queries, ids and exact scores of the best k found for each in the shard; ``kept`` holds the decoded shard."""
    if not kept:
        vectors = np.frombuffer(row["vectors"]).reshape(row["nodes"], row["width"])
        layers = [np.frombuffer(x, dtype=np.int32).reshape(row["nodes"], -1).astype(np.int64) for x in row["links"]]
        member = np.frombuffer(row["member"], dtype=np.int32)
        order = np.argsort(member, kind="stable")  # ids of a node stand together, ascending
        kept.update(vectors=vectors, graph=Graph(_even_lengths(vectors)[0], layers, 0), ids=np.frombuffer(row["ids"], dtype=np.int64)[order],
                    begin=np.searchsorted(member[order], np.arange(row["nodes"] + 1)))
    vectors, ids, begin = kept["vectors"], kept["ids"], kept["begin"]
    length = np.sqrt((queries ** 2).sum(axis=1))
    asked = np.concatenate([queries / np.where(length, length, 1)[:, None], np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    found, far = kept["graph"].search(asked, max(width, k + 1))
    out: tuple[list, list, list] = ([], [], [])
    for name, query, nodes, away in zip(names, queries, found, far, strict=True):
        # the k + 1 nearest in single precision, and all whose order it cannot tell
        nodes = nodes[(nodes >= 0) & (away <= away[min(k, len(away) - 1)] + ROUNDING)]
        score = np.array([float(np.dot(vectors[n], query)) for n in nodes])
        got = np.concatenate([ids[begin[n]:min(begin[n] + k + 1, begin[n + 1])] for n in nodes])
        exact = np.repeat(score, [min(k + 1, begin[n + 1] - begin[n]) for n in nodes])
        got, exact = got[got != name], exact[got != name]
        best = np.lexsort((got, -exact))[:k]
        for part, values in zip(out, (np.full(len(best), name), got[best], exact[best]), strict=True):
            part.append(values)
    return out


def _search(k: int, width: int):
    """Streams rows that are sorted by shard, the index row first: a shard is decoded once, its queries come in small lots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("hnsw")
        row, place, kept = None, None, {}
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "grp")), strict=True))
            held = np.flatnonzero(batch.column("nodes").is_valid().to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                if at in held:
                    row, place, kept = {c: batch.column(c)[at].as_py() for c in HELD}, places[at], {}
                    at += 1
                    continue
                end = int(min([batch.num_rows, at + LOT, *held[held > at][:1]]))
                if row is None or places[at] != place:
                    raise ValueError("queries of a shard without its index row")
                lot = batch.slice(at, end - at)
                vectors = lot.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(end - at, -1)
                parts = [np.concatenate(x) for x in _search_shard(row, lot.column("id").to_numpy(), vectors, k, width, kept)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["query_id", "vec_id", "score"])
                at = end
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, width: int = 240) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products found for each query.

    Both inputs have (id long, vector array<double>): unique ids, no nulls.  A query never meets
    its own id, nor vectors of another length, with which it has no product; empty vectors take
    no part.  Equal scores go to smaller ids.  ``width`` is how many nodes a search keeps in
    view; every vector is in the index, and no result is cut below k.
    """
    vectors, queries = (df.select("id", "vector", F.size("vector").alias("dim")).where("dim > 0") for df in (vectors, queries))
    size = F.greatest(F.lit(1.0), F.lit(SHARD_BYTES) / (8 * F.col("dim")))
    shards = vectors.groupBy("dim").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / size)).cast("long").alias("shards"))
    groups = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).cast("long").alias("groups"))
    plan = written(shards.join(groups, "dim", "left"), "hnsw-plan")
    few = broadcast_if_small(plan)
    dealt = vectors.join(few, "dim").select("id", "vector", "dim", F.pmod(F.xxhash64("id"), F.col("shards")).alias("shard"))
    index = written(dealt.groupBy("dim", "shard").applyInPandas(_index, INDEX), "hnsw")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    # every pair of a shard and a query group is work to do; the index row of the shard comes first
    held = index.join(few.where("groups > 0"), "dim").select("dim", "shard", each("groups").alias("grp"), *(F.col(c) for c in HELD))
    asked = queries.join(few, "dim").select("dim", each("shards").alias("shard"), F.pmod(F.xxhash64("id"), F.col("groups")).alias("grp"), "id", "vector")
    both = held.unionByName(asked, allowMissingColumns=True).repartition("dim", "shard", "grp").sortWithinPartitions("dim", "shard", "grp", F.col("nodes").desc_nulls_last())
    found = both.mapInArrow(_search(k, width), "query_id long, vec_id long, score double")
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
