"""N-gram Jaccard join: documents whose shingle sets are alike, as connected components.

Documents with equal sets are one class.  All shingles have one global order: first by how
common they are (levels of 65,536 hashed buckets counted over all documents), then by hash.
Two sets of the asked similarity share a shingle among the first few of each (the prefix), and
the inverted index holds those with their positions.  Relations between sets and lists are used
to skip work, never to leave out a pair:

* *Index lists are skipped in blocks.*  A long list is sorted by set size and position and cut
  into blocks; two blocks meet only if the largest overlap that their sizes and positions allow
  reaches the threshold, and if they hold different components.
* *Answers are derived.*  Every set first meets one pivot, the leader of most of its lists; the
  overlaps found are kept.  Two sets with one pivot can share no more than their overlaps with it
  allow.  In long lists, sets that the pivot did not answer meet one of the pivot's own answers.
  Pairs that may still link, also by the parity bitmaps of their sets, make clusters.  Only in
  these are the sets themselves brought together, each once for a pair of blocks: one set's
  overlaps with the other block are counted in full, and those of the others follow from it by
  the few shingles in which they differ from that set.

Only links between different components are looked for after the first ones, so a group of any
number of like sets is never expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.neardup import shingles
from evidentia.llm.tables import components, written
from evidentia.session import broadcast_if_small

BUCKETS = 1 << 16
#: Bits of a set's bitmap, in which every shingle flips one bit: at least half as many as shingles, a power of
#: two, no fewer than LEAST_BITS.  The bits in which two bitmaps differ are no more than the shingles in which
#: the sets differ; a wider bitmap is folded to a narrower one by exclusive or.
LEAST_BITS = 256
WIDE = 4096  # bits of the bitmaps made where the sets themselves are at hand
#: Entries of a list whose pairs are tried in a join; entries of a block of a longer list; pairs per
#: entry of two blocks that are listed (of more, their sets are made one cluster instead).
SMALL = 32
BLOCK = 512
DENSE = 4
MOST_IDS = 2_000_000  # ids that are sent to every task
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (W.mix(hashes ^ _SALT) >> np.uint64(48)).astype(np.int64)


def _counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("setjoin")
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                w = W.words(piece.column("text"), lower=True)
                h = w.hashes()
                n = len(h) - size + 1
                if n > 0:
                    total += np.bincount(_bucket(W.rolling(h, size)[w.doc[:n] == w.doc[size - 1:]]), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])
    return run


def common_levels(texts: DataFrame, size: int) -> np.ndarray:
    """Of each bucket of shingles, how many times more often it occurs than the mean one: 0 to 15, as a power of two."""
    found = texts.mapInArrow(_counts(size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    count = np.zeros(BUCKETS)
    for r in found.collect():  # one row per bucket, a fixed number
        count[r.bucket] = r.n
    return np.clip(np.floor(np.log2(np.maximum(count, 1) / max(count.mean(), 16.0))), 0, 15).astype(np.uint8)


def least_overlap(n, percent: int):
    """How many of its n shingles a set shares at least with any set that it links with."""
    return -(-n * percent // 100)


ROWS = "id long, n long, digest binary, prefix array<long>, bits binary"


def bitmaps(hashes: np.ndarray, owner: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """The parity bitmaps of sets that lie one after another, as rows of 64-bit words."""
    flips = np.bincount(owner * bits + (W.mix(hashes + _SALT) % np.uint64(bits)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little").view("<u8")


def _widths(n: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64))


def own_bitmaps(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each set's bitmap of its own width."""
    out: list[bytes] = [b""] * len(n)
    width = _widths(n)
    for bits in np.unique(width):
        here = np.flatnonzero(width == bits)
        mine = np.isin(owner, here)
        for row, made in zip(here, bitmaps(hashes[mine], np.searchsorted(here, owner[mine]), len(here), int(bits)), strict=True):
            out[row] = made.tobytes()
    return out


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, words), axis=1)


def differing_bits(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits each left and right bitmap differ, of the narrower one's width; 0 where one is four times as wide or more."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    sizes = [np.array([len(x) // 8 for x in side]) for side in (left, right)]
    for a in np.unique(sizes[0]):
        rows = np.flatnonzero(sizes[0] == a)
        one = np.frombuffer(b"".join(left[i] for i in rows), dtype="<u8").reshape(len(rows), a)
        for b in np.unique(sizes[1]):
            if max(a, b) <= 2 * min(a, b):
                columns = np.flatnonzero(sizes[1] == b)
                two = _folded(np.frombuffer(b"".join(right[i] for i in columns), dtype="<u8").reshape(len(columns), b), min(a, b))
                folded = _folded(one, min(a, b))
                for i, row in zip(rows, folded, strict=True):
                    out[i, columns] = np.bitwise_count(two ^ row).sum(axis=1, dtype=np.int64)
    return out


def _rows(size: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("setjoin")
        level = np.frombuffer(shared.value, dtype=np.uint8).astype(np.uint64)
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                rows = piece.num_rows
                hashes, begin = shingles(W.words(piece.column("text"), lower=True), rows, size)
                n = np.diff(begin)
                owner = np.repeat(np.arange(rows), n)
                order = np.lexsort(((level[_bucket(hashes)] << np.uint64(60)) | (hashes >> np.uint64(4)), owner))
                length = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                chosen = order[np.arange(len(order)) - begin[owner] < length[owner]]
                raw = hashes.tobytes()
                digest = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None for a, b in zip(begin, begin[1:], strict=False)]
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[chosen].view(np.int64)))
                bits = own_bitmaps(hashes, owner, n)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), prefix, pa.array(bits, pa.binary())],
                                                 names=["id", "n", "digest", "prefix", "bits"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("setjoin")
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                hashes, begin = shingles(W.words(piece.column("text"), lower=True), piece.num_rows, size)
                raw = hashes.tobytes()
                sets = [raw[8 * a:8 * b] for a, b in zip(begin, begin[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sets, pa.binary())], names=["cid", "hashes"])
    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.turn_to("setjoin")
    for batch in batches:
        shared, sizes = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.int64)
        for i, (a, b) in enumerate(zip(batch.column("hu"), batch.column("hv"), strict=True)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared[i], sizes[0, i], sizes[1, i] = (both[1:] == both[:-1]).sum(), len(a), len(b)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(shared), pa.array(sizes[0]), pa.array(sizes[1])], names=["u", "v", "shared", "nu", "nv"])


def _sets_of(texts: DataFrame, ids: DataFrame, size: int, repeated: bool, name: str) -> DataFrame:
    """(cid, hashes) of the given cids, written.  Where these are few, no text moves."""
    few = broadcast_if_small(ids.select("cid").distinct(), MOST_IDS)
    sets = texts.join(few, F.col("id") == F.col("cid"), "left_semi").mapInArrow(_sets(size), "cid long, hashes binary").where("octet_length(hashes) > 0")
    return written(sets.distinct() if repeated else sets, f"set-{name}-sets")


def _by_bitmaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("setjoin")
        for batch in batches:
            u, v = batch.column("bu").to_pylist(), batch.column("bv").to_pylist()
            differ = np.fromiter((differing_bits([a], [b])[0, 0] for a, b in zip(u, v, strict=True)), dtype=np.int64, count=batch.num_rows)
            sizes = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            good = pa.array(_enough((sizes - differ) // 2, sizes, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("u", "v")], names=["u", "v"])
    return run


def _near(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that may link by the bitmaps of their sets."""
    a, b = (facts.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in ("u", "v"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(_by_bitmaps(percent), "u long, v long").distinct()


def _measured(pairs: DataFrame, facts: DataFrame, texts: DataFrame, size: int, percent: int, repeated: bool, name: str) -> DataFrame:
    """(u, v, shared, nu, nv) of the pairs that may link: how many shingles their sets share, and the sizes."""
    near = written(_near(broadcast_if_small(written(pairs, f"set-{name}-pairs")), facts, percent), f"set-{name}-near")
    of = [near.select(F.col(c).alias("cid")) for c in ("u", "v")]
    sets = _sets_of(texts, of[0].union(of[1]), size, repeated, name)
    pivots = sets.join(broadcast_if_small(of[1].distinct(), MOST_IDS), "cid", "left_semi")
    both = sets.toDF("u", "hu").join(broadcast_if_small(near), "u").join(pivots.toDF("v", "hv"), "v").select("u", "v", "hu", "hv")
    return written(both.mapInArrow(_overlaps, "u long, v long, shared long, nu long, nv long"), f"set-{name}")


def _enough(shared, sizes, percent: int):
    """Whether an overlap reaches the threshold for sets with this sum of sizes."""
    return shared * (100 + percent) >= percent * sizes


def _may_link(n, at, m, other, percent: int):
    """Whether sets of n and m shingles can link if their first common shingle has these positions."""
    return _enough(F.least(n - at, m - other), n + m, percent)


def _without(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The values that are not among the others; both are sorted."""
    if not len(others):
        return values
    return values[others[np.minimum(np.searchsorted(others, values), len(others) - 1)] != values]


class Answers:
    """How many elements sets (sorted, distinct) share with each of some right sets.

    The right sets are one index, element to sets.  The first answer reads the lists of all the
    set's elements.  A later one starts from the answer of a set already asked, and reads only the
    lists of the elements that the two sets do not share, if these are fewer.
    """

    def __init__(self, right: list[np.ndarray]):
        flat, row = np.concatenate(right), np.repeat(np.arange(len(right)), [len(x) for x in right])
        order = np.argsort(flat, kind="stable")
        self.elements, self.sets, self.count = flat[order], row[order], len(right)
        self.known: list[tuple[np.ndarray, np.ndarray]] = []

    def _lists(self, elements: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.elements, elements, side=side) for side in ("left", "right"))
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.sets[at], minlength=self.count)

    def of(self, asked: np.ndarray, like: int | None = None) -> np.ndarray:
        """The answer of one more set, from that of the set asked as number ``like``."""
        answer = None
        if like is not None:
            base, shared = self.known[like]
            gone, new = _without(base, asked), _without(asked, base)
            if len(gone) + len(new) < len(asked):
                answer = shared - self._lists(gone) + self._lists(new)
        if answer is None:
            answer = self._lists(asked)
        self.known.append((asked, answer))
        return answer


def _sides(rows: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The columns of the left and the right block of a unit; a block that meets itself came once."""
    side = rows.column("side").to_numpy()
    left, right = ({c: rows.column(c).to_numpy()[side == s] for c in rows.column_names if c != "side"} for s in (0, 1))
    return left, right if len(right["cid"]) else left


def _need(left: dict, right: dict, percent: int) -> np.ndarray:
    """Which pairs of two blocks stand in different components and may link, by all that is known without their sets."""
    across = lambda column: (left[column][:, None], right[column][None, :])
    (n, m), (at, by), (u, v) = across("n"), across("pos"), across("component")
    need = (u != v) & _enough(np.minimum(n - at, m - by), n + m, percent)
    (pivot, pivot_), (known, known_), (shared, shared_) = across("pivot"), across("known"), across("shared")
    bound = np.minimum(shared, shared_) + np.minimum(n - shared, m - shared_)
    need &= ~(known & known_ & (pivot == pivot_)) | _enough(bound, n + m, percent)
    if left is right:
        need &= np.triu(np.ones(need.shape, dtype=bool), 1)
    rows, columns = np.flatnonzero(need.any(axis=1)), np.flatnonzero(need.any(axis=0))
    if len(rows):
        part = np.ix_(rows, columns)
        sizes = (n + m)[part]
        need[part] &= _enough((sizes - differing_bits(*([side["bits"][i] for i in at] for side, at in ((left, rows), (right, columns))))) // 2, sizes, percent)
    return need


def _block_pairs(percent: int):
    """The pairs of a unit that may link; of very many, pairs of all their sets with one of them."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = _sides(rows)
        need = _need(left, right, percent)
        x, y = np.nonzero(need)
        u, v = left["cid"][x], right["cid"][y]
        if len(x) > DENSE * sum(need.shape):
            v = np.unique(np.concatenate([u, v]))
            u = np.full(len(v), v[0])
        return pa.Table.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], names=["u", "v"])
    return run


def _block_links(percent: int):
    """Links between components among the sets of two blocks; of several that join the same components, one."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = _sides(rows)
        need = _need(left, right, percent)
        found: list[tuple[int, int]] = []
        if need.any():
            keep_l, keep_r = np.flatnonzero(need.any(axis=1)), np.flatnonzero(need.any(axis=0))
            left, right = ({c: values[keep] for c, values in side.items()} for side, keep in ((left, keep_l), (right, keep_r)))
            need = need[np.ix_(keep_l, keep_r)]
            sets, others = ([np.frombuffer(x, np.uint64) for x in side["hashes"]] for side in (left, right))
            wide, wide_ = (bitmaps(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]), len(x), WIDE) for x in (sets, others))
            ours, theirs = left["component"].copy(), right["component"].copy()
            answers, asked = Answers(others), np.zeros(0, dtype=np.int64)
            for x in np.argsort(-need.sum(axis=1), kind="stable"):
                size = left["n"][x] + right["n"]
                open_ = np.flatnonzero(need[x] & (theirs != ours[x]))
                differ = np.bitwise_count(wide_[open_] ^ wide[x]).sum(axis=1, dtype=np.int64)
                open_ = open_[_enough((size[open_] - differ) // 2, size[open_], percent)]
                if not len(open_):
                    continue
                like = int(np.bitwise_count(wide[asked] ^ wide[x]).sum(axis=1).argmin()) if len(asked) else None
                shared = answers.of(sets[x], like)
                asked = np.append(asked, x)
                for y in open_[_enough(shared[open_], size[open_], percent)]:
                    if theirs[y] != ours[x]:
                        found.append((int(left["cid"][x]), int(right["cid"][y])))
                        joined, into = theirs[y], ours[x]
                        ours[ours == joined], theirs[theirs == joined] = into, into
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
    return run


ENTRY = ["key", "cid", "n", "pos", "component", "main", "pivot", "known", "shared", "bits"]


def _units(entries: DataFrame, percent: int, name: str) -> DataFrame:
    """The rows of all pairs of blocks of one list that have to meet: key, i, j, side, and the entry.

    A block has at most BLOCK neighbours of a list by size and position, those outside of the list's
    main component first; blocks within one component never meet.
    """
    ranges = entries.withColumn("in_main", F.col("component") == F.col("main")).repartitionByRange("key", "in_main", "n", "pos", "cid")
    ranges = written(ranges.withColumn("range", F.spark_partition_id().cast("long")), f"set-{name}-ranges")
    place = F.row_number().over(Window.partitionBy("key", "range").orderBy("in_main", "n", "pos", "cid")) - 1
    blocks = written(ranges.withColumn("block", F.col("range") * (1 << 32) + F.floor(place / BLOCK)).drop("range", "main", "in_main"), f"set-{name}-blocks")
    outline = blocks.groupBy("key", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("component").alias("low"), F.max("component").alias("high"))
    a, b = outline.alias("a"), outline.alias("b")
    sizes = _enough(F.least("a.rest", "b.rest"), F.col("a.least") + F.col("b.least"), percent)
    sizes &= (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    alike = (F.col("a.low") == F.col("b.high")) & (F.col("a.high") == F.col("b.low"))
    units = written(a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & sizes & ~alike)
                    .select(F.col("a.key").alias("key"), F.col("a.block").alias("i"), F.col("b.block").alias("j")), f"set-{name}-units")
    columns = ["key", "i", "j", *(c for c in ENTRY if c not in ("key", "main"))]
    left = blocks.join(units.withColumn("block", F.col("i")), ["key", "block"]).select(*columns, F.lit(0).alias("side"))
    right = blocks.join(units.where("i <> j").withColumn("block", F.col("j")), ["key", "block"]).select(*columns, F.lit(1).alias("side"))
    return left.union(right)


def _entries(rows: DataFrame, key: str, facts: DataFrame, told: DataFrame) -> DataFrame:
    """Rows (key, cid, n, pos, component, main) with all that is known of their sets."""
    zero = F.lit(0).cast("long")
    full = rows.join(told, "cid", "left").join(facts, ["cid", "n"])
    return full.select(F.col(key).alias("key"), "cid", "n", "pos", "component", "main", F.coalesce("pivot", zero).alias("pivot"),
                       F.col("pivot").isNotNull().alias("known"), F.coalesce("shared", zero).alias("shared"), "bits")


def _by_votes(offers: DataFrame) -> DataFrame:
    """(u, v): of the sets offered to each set (cid, pivot), the one offered most often."""
    return (offers.groupBy("cid", "pivot").agg(F.count(F.lit(1)).alias("votes"))
            .groupBy("cid").agg(F.max(F.struct("votes", F.xxhash64("pivot").alias("h"), "pivot")).alias("top"))
            .select(F.col("cid").alias("u"), F.col("top.pivot").alias("v")))


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(_enough(F.col("shared"), F.col("nu") + F.col("nv"), percent)).select("u", "v").distinct()


def _placed(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of the lists that hold several components, with their own and their leader's."""
    inside = lists.join(groups.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    split = (inside.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.when(F.col("cid") == F.col("leader"), F.col("component"))).alias("main"))
             .where("low <> high").select("token", "main"))
    return inside.join(split, "token")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) of every row, the id under its own name.

    A document's set is its distinct shingles of ``size`` words, A-Z in lower case; fewer words
    make one shingle.  Two documents link when ``100 * shared >= percent * union``; component_id
    is the smallest id reachable.  Null texts and texts without words have no shingles and link
    with nothing; a row without an id has no component.  Rows of one id are one document: it has
    the links of each of its texts, and takes the smallest of their components.  Other columns
    are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    spark = docs.sparkSession
    texts = docs.select(docs[docs.columns.index(id_col)].cast("long").alias("id"), docs[docs.columns.index(text_col)].cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(common_levels(texts.select("text"), size).tobytes())
    rows = written(texts.mapInArrow(_rows(size, percent, levels), ROWS), "set-rows")
    known = rows.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("id").alias("cid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "set-classes")
    facts = classes.select("cid", "n", "bits")

    entries = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    first = F.min(F.struct(F.xxhash64("cid").alias("h"), F.col("cid").alias("leader"), F.col("n").alias("m"), F.col("pos").alias("lead")))
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("entries"), first.alias("f")).where("entries > 1").select("token", "entries", "f.leader", "f.m", "f.lead")
    lists = written(entries.join(shared, "token"), "set-lists")

    fits = _may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("lead"), percent)
    repeated = not known.groupBy("id", "digest").count().where("count > 1").isEmpty()
    pivots = _by_votes(lists.where(F.col("cid") != F.col("leader")).where(fits).select("cid", F.col("leader").alias("pivot")))
    answers = _measured(pivots, facts, texts, size, percent, repeated, "answers")
    links = written(_linked(answers, percent), "set-links")
    groups = components(links, "set-groups")

    # of an id with several texts there are several answers, which bound nothing
    # of an id with several texts there are several answers, which bound nothing
    told = (answers.groupBy("u").agg(F.max("shared").alias("shared"), F.max("v").alias("pivot"), F.count(F.lit(1)).alias("times")).where("times = 1")
            .select(F.col("u").alias("cid"), "shared", "pivot"))

    open_ = written(_placed(lists, groups), "set-open")
    hot = open_.where(F.col("entries") > SMALL)
    if not hot.isEmpty():
        # what the pivot did not answer meets one of the pivot's own answers
        second = (hot.where((F.col("component") == F.col("main")) & (F.col("cid") != F.col("leader"))).groupBy("token")
                  .agg(F.min(F.struct(F.xxhash64("cid").alias("h"), F.col("cid").alias("pivot"), F.col("n").alias("k"), F.col("pos").alias("by"))).alias("s"))
                  .select("token", "s.pivot", "s.k", "s.by"))
        offers = hot.where("component <> main").join(second, "token").where(_may_link(F.col("n"), F.col("pos"), F.col("k"), F.col("by"), percent))
        links = links.union(_linked(_measured(_by_votes(offers.select("cid", "pivot")), facts, texts, size, percent, repeated, "second"), percent))
        groups = components(links, "set-groups2")
        open_ = written(_placed(lists, groups), "set-left")

    few = open_.where(F.col("entries") <= SMALL).join(told, "cid", "left")
    a, b = few.where("component <> main").alias("a"), few.alias("b")
    bound = F.least("a.shared", "b.shared") + F.least(F.col("a.n") - F.col("a.shared"), F.col("b.n") - F.col("b.shared"))
    met = F.coalesce(F.col("a.pivot") == F.col("b.pivot"), F.lit(False)) & ~_enough(bound, F.col("a.n") + F.col("b.n"), percent)
    met |= F.coalesce(F.col("a.pivot") == F.col("b.cid"), F.lit(False)) | F.coalesce(F.col("b.pivot") == F.col("a.cid"), F.lit(False))
    pairs = (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component"))
                    & ((F.col("b.component") == F.col("b.main")) | (F.col("a.cid") < F.col("b.cid")))
                    & _may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent) & ~met)
             .select(F.least("a.cid", "b.cid").alias("u"), F.greatest("a.cid", "b.cid").alias("v")).distinct())
    near = _near(broadcast_if_small(written(pairs, "set-rest-pairs")), facts, percent)
    hot = open_.where(F.col("entries") > SMALL)
    if not hot.isEmpty():
        near = near.union(_units(_entries(hot, "token", facts, told), percent, "lists").groupBy("key", "i", "j").applyInArrow(_block_pairs(percent), "u long, v long"))
    near = written(near, "set-near")
    if not near.isEmpty():
        cluster = components(near, "set-clusters").select(F.col("id").alias("cid"), F.col("component").alias("cluster"))
        inside = cluster.join(groups.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        main = (inside.groupBy("cluster").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "component")).alias("s"), F.min("component").alias("low"), F.max("component").alias("high"))
                .where("low <> high").select("cluster", F.col("s.component").alias("main")))
        members = inside.join(main, "cluster").join(classes.select("cid", "n"), "cid").withColumn("pos", F.lit(0))
        members = written(members, "set-members")
        sets = _sets_of(texts, members, size, repeated, "clusters")
        units = _units(_entries(members, "cluster", facts, told), percent, "clusters").join(sets, "cid")
        found = units.groupBy("key", "i", "j").applyInArrow(_block_links(percent), "u long, v long")
        groups = components(links.union(written(found, "set-more")), "set-groups3")

    whole = (known.select("id", "digest").join(classes.select("digest", "cid"), "digest")
             .join(groups.select(F.col("id").alias("cid"), "component"), "cid", "left")
             .groupBy("id").agg(F.min(F.coalesce("component", "cid")).alias("component")))
    return rows.select("id", "n").join(whole, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
