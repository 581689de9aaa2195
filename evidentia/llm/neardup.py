"""MinHash near-dedup with odd sketches.

Documents with equal shingle sets are one class.  Each class gets ``BANDS * ROWS`` MinHash
samples; they are banded for candidates, and folded into an odd sketch, a bitmap in which
sample i with value v flips bit hash(i, v).  Flips of shared samples cancel in the XOR of two
sketches, so its population count estimates how many samples differ, most precisely where
similarity is high.  A candidate goes on only if sizes and sketches allow the threshold; then
the link is confirmed on the full shingle sets.

A band's bucket is never expanded into all its pairs.  First each class meets one leader
(the member with the least hash in most of its buckets).  Confirmed links make components.
Only candidates that stand in different components are looked at again.  In a bucket of at
most ``SMALL`` classes, members outside the leader's component meet the bucket in a join whose
condition is the sketch test.  Classes of larger buckets are brought together once, as
families (buckets that share classes), and every two blocks of a family are one bounded unit of
work that compares full sets by counting shared shingles and returns only links that join
components.  Every pair that shares a bucket and passes the sketch test is thus confirmed,
refuted, or inside one component: no link between components is lost, no partner is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import components, written
from evidentia.operators.ranking import ranged_row_number

BANDS, ROWS = 20, 4
SKETCH_WORDS = 4  # 64-bit words of an odd sketch
#: XOR bits that a linked pair stays below, by the least similarity in percent.  Exceeded at 0.85 with
#: odds of 6 in 10**8 (12 of 80 samples differ on average), at 0.80 of 1.2 in 10**8 (16 differ).
SKETCH_BITS = {85: 54, 80: 64}
#: Classes of a bucket whose candidates are listed as pairs; classes and shingles of a family's block.
SMALL = 32
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 400_000

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: W.Words, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and where each row begins."""
    h = w.hashes()
    count = np.diff(w.first)
    n = len(h) - size + 1
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        inside = np.flatnonzero(w.doc[:n] == w.doc[size - 1:])
        hashes, owner = W.rolling(h, size)[inside], w.doc[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = w.first[short]
        hashes = np.concatenate([hashes, W.Prefix(h).range(begin, begin + count[short])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(rows + 1))


def samples(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash samples (rows by BANDS * ROWS) of non-empty sets that lie one after another."""
    out = np.empty((len(begins), BANDS * ROWS), dtype=np.uint64)
    work = np.empty_like(hashes)
    for i in range(BANDS * ROWS):
        np.bitwise_xor(hashes, _XOR[i], out=work)
        np.multiply(work, _ODD[i], out=work)
        out[:, i] = np.minimum.reduceat(work, begins)
    return out


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    bits = SKETCH_WORDS * 64
    flips = W.mix(mins + _XOR[None, :]) % np.uint64(bits)
    sketch = np.zeros((len(mins), SKETCH_WORDS), dtype=np.uint64)
    row = np.arange(len(mins))
    for i in range(mins.shape[1]):
        sketch[row, flips[:, i] >> np.uint64(6)] ^= np.uint64(1) << (flips[:, i] & np.uint64(63))
    return sketch


SIGNATURE = "id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("neardup")
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                rows = piece.num_rows
                hashes, begin = shingles(W.words(piece.column("text"), lower=True), rows, size)
                count = np.diff(begin)
                some = np.flatnonzero(count)
                digest: list = [None] * rows
                bands: list = [None] * rows
                sketch = np.zeros((rows, SKETCH_WORDS), dtype=np.uint64)
                if len(some):
                    mins = samples(hashes, begin[some])
                    sketch[some] = odd_sketch(mins)
                    keys = np.zeros((len(some), BANDS), dtype=np.uint64)
                    for j in range(ROWS):
                        keys = W.mix(keys ^ mins[:, j::ROWS][:, :BANDS] + np.uint64(j))
                    keys = (keys + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    raw = hashes.tobytes()
                    for at, r in enumerate(some):
                        digest[r] = hashlib.blake2b(raw[8 * begin[r]:8 * begin[r + 1]], digest_size=16).digest()
                        bands[r] = keys[at]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(count.astype(np.int64)), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                    + [pa.array(sketch[:, i].copy().view(np.int64)) for i in range(SKETCH_WORDS)],
                    names=["id", "n_shingles", "digest", "bands"] + [f"s{i}" for i in range(SKETCH_WORDS)])
    return run


def _confirm(size: int, percent: int):
    """Keeps the pairs whose full shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("neardup")
        for batch in batches:
            rows = batch.num_rows
            good = np.zeros(rows, dtype=bool)
            held: dict[str, tuple] = {}
            for at in range(0, rows, 500):
                part = batch.slice(at, 500)
                for name in ("text_u", "text_v"):
                    column = part.column(name).dictionary_encode()
                    hashes, begin = shingles(W.words(column.dictionary, lower=True), len(column.dictionary), size)
                    held[name] = (column.indices.to_numpy(), hashes, begin)
                (iu, hu, bu), (iv, hv, bv) = held["text_u"], held["text_v"]
                for r in range(part.num_rows):
                    a, b = hu[bu[iu[r]]:bu[iu[r] + 1]], hv[bv[iv[r]]:bv[iv[r] + 1]]
                    both = np.concatenate([a, b])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good[at + r] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (batch.column("u"), batch.column("v"))], names=["u", "v"])
    return run


def _sketch_bits(percent: int) -> int:
    return SKETCH_BITS[85 if percent >= 85 else 80]


def _possible(percent: int):
    """What sizes and sketches of two classes (a., b.) must satisfy for a link."""
    flips = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    small, large = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    return (small * 100 >= large * percent) & (flips <= _sketch_bits(percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row, the id under its own name.

    Two documents are linked if ``100 * shared >= percent * union`` of their distinct shingles of
    ``size`` lower-cased (A-Z) words.  ``percent`` is 80 or more.  component_id is the smallest id
    reachable; kept marks it.  Rows with no words are linked with nothing; rows of one id are
    one document; a row with a null id has no component and is kept.
    """
    if percent < 80:
        raise ValueError("bands and sketches are laid out for similarities of 0.8 or more")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(_signatures(size), SIGNATURE), "signatures")
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]

    # classes of equal sets; all their members have the same samples, so any member's values serve
    classes = written(
        rows.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
        .agg(F.min("id").alias("cid"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in sketch)), "classes")
    entries = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = (entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("least"))
              .where("n > 1").select("band", "key", "n", F.col("least.cid").alias("leader")))
    buckets = written(entries.join(shared, ["band", "key"]), "buckets")

    best = (buckets.where("cid <> leader").groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("votes"))
            .groupBy("cid").agg(F.max(F.struct("votes", F.xxhash64("leader").alias("h"), "leader")).alias("top"))
            .select(F.col("cid").alias("u"), F.col("top.leader").alias("v")))
    facts = classes.select("cid", "n_shingles", *sketch)
    first = (best.join(facts.alias("a"), F.col("u") == F.col("a.cid")).join(facts.alias("b"), F.col("v") == F.col("b.cid"))
             .where(_possible(percent)).select("u", "v"))
    links = written(_confirmed(first, texts, size, percent), "links")
    groups = components(links, "groups")

    inside = buckets.join(groups, F.col("cid") == F.col("id"), "left").select("band", "key", "n", "cid", "leader", F.coalesce("component", "cid").alias("component"))
    split = inside.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "key")
    open_ = written(inside.join(split, ["band", "key"]), "open")
    few = open_.where(F.col("n") <= SMALL).join(facts, "cid")
    lead = few.where("cid = leader").select("band", "key", F.col("component").alias("main"))
    rest = few.join(lead, ["band", "key"])
    a, b = rest.where("component <> main").alias("a"), rest.alias("b")
    again = (a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component"))
                    & ((F.col("b.component") == F.col("b.main")) | (F.col("a.cid") < F.col("b.cid"))) & _possible(percent))
             .select(F.least("a.cid", "b.cid").alias("u"), F.greatest("a.cid", "b.cid").alias("v")).distinct())
    again = written(again, "again")
    more = [_confirmed(again, texts, size, percent)] if not again.isEmpty() else []
    many = open_.where(F.col("n") > SMALL)
    if not many.isEmpty():
        more.append(_by_blocks(many, classes, texts, size, percent))
    if more:
        links = links.union(written(more[0].union(more[1]) if len(more) > 1 else more[0], "links2"))
        groups = components(links, "groups2")
    member = rows.where("id IS NOT NULL AND digest IS NOT NULL").select("id", "digest")
    whole = (member.join(classes.select("digest", "cid"), "digest")
             .join(groups.select(F.col("id").alias("cid"), "component"), "cid", "left")
             .groupBy("id").agg(F.min(F.coalesce("component", "cid")).alias("component")))
    done = rows.select("id", "n_shingles").join(whole, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    of = texts.where("id IS NOT NULL")
    both = (pairs.join(of.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
            .join(of.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v"))
    return both.mapInArrow(_confirm(size, percent), "u long, v long").distinct()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("neardup")
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                hashes, begin = shingles(W.words(piece.column("text"), lower=True), piece.num_rows, size)
                raw = hashes.tobytes()
                sets = pa.array([raw[8 * begin[i]:8 * begin[i + 1]] for i in range(piece.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("cid"), sets], names=["cid", "hashes"])
    return run


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, from products of 0/1 matrices a few thousand shingles wide."""
    def placed(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        hit = vocabulary[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(vocabulary):
        return counts
    (lr, lc), (rr, rc) = placed(left, vocabulary), placed(right, vocabulary)
    wide = 4096
    for at in range(0, len(vocabulary), wide):
        a, b = (np.zeros((n, wide), dtype=np.float32) for n in (len(left), len(right)))
        for matrix, row, column in ((a, lr, lc), (b, rr, rc)):
            low, high = np.searchsorted(column, [at, at + wide])
            matrix[row[low:high], column[low:high] - at] = 1
        counts += a @ b.T
    return counts


def _block_links(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            lc, rc = left["component"].to_numpy(), right["component"].to_numpy()
            ln, rn = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
            need = (lc[:, None] != rc[None, :]) & (100 * np.minimum(ln[:, None], rn[None, :]) >= percent * np.maximum(ln[:, None], rn[None, :]))
            if i == j:
                need = np.triu(need, 1)
            flips = np.zeros(need.shape, dtype=np.int64)
            for s in range(SKETCH_WORDS):
                flips += np.bitwise_count(left[f"s{s}"].to_numpy().view(np.uint64)[:, None] ^ right[f"s{s}"].to_numpy().view(np.uint64)[None, :])
            need &= flips <= _sketch_bits(percent)
            lb, rb = np.stack(left["bands"].to_numpy()), np.stack(right["bands"].to_numpy())
            together = np.zeros(need.shape, dtype=bool)
            for band in range(BANDS):
                together |= lb[:, band, None] == rb[None, :, band]
            need &= together
            if need.any():
                sets = [[np.frombuffer(x, dtype=np.uint64) for x in side["hashes"]] for side in (left, right)]
                shared = _shared_counts(*sets).astype(np.int64)
                good = need & (100 * shared >= percent * (ln[:, None] + rn[None, :] - shared))
                parent: dict[int, int] = {}

                def root(x: int) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                li, ri = left["cid"].to_numpy(), right["cid"].to_numpy()
                for x, y in zip(*np.nonzero(good), strict=True):  # links that join components suffice
                    a, b = root(int(lc[x])), root(int(rc[y]))
                    if a != b:
                        parent[a] = b
                        out.append((int(li[x]), int(ri[y])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _by_blocks(many: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join components among the classes of large buckets."""
    family = components(many.select(F.col("cid").alias("u"), F.col("leader").alias("v")), "families").select(F.col("id").alias("cid"), F.col("component").alias("family"))
    known = many.select("cid", "component").distinct().join(family, "cid").join(classes.drop("digest").dropDuplicates(["cid"]), "cid")
    sets = (texts.join(family.select("cid"), F.col("id") == F.col("cid"), "inner").select("cid", "text").mapInArrow(_sets(size), "cid long, hashes binary")
            .dropDuplicates(["cid"]))
    sizes = known.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = known.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
    rows = written(dealt.join(sets, "cid"), "blocks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return rows.groupBy("family", "i", "j").applyInPandas(_block_links(percent), "u long, v long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input without the rows whose group has a smaller id.

    Rows with one id and one text are one document, of which the row with the least hash over all
    columns stays.  Different texts under one id are documents of their own: each is grouped by its
    own text, and stays unless its group has a smaller id, or the same id and a smaller hash of the text.
    Null texts count as empty ones here; rows with a null id stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = docs.toDF(*names)
    named = rows.where(F.col(key).isNotNull())
    if not named.groupBy(key).count().where("count > 1").isEmpty():
        # numbers in the order of (id, text) stand for the ids, so the smallest number is the smallest id
        own = F.sha2(F.coalesce(text, F.lit("")), 256)
        one = named.groupBy(F.col(key).alias("k"), own.alias("h")).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
        numbered = ranged_row_number(written(one, "one-row"), [], [F.col("k"), F.col("h")], "number")
        named = written(numbered.select("row.*", F.col("number").cast("long").alias("number")), "numbered")
        kept = near_duplicates(named, "number", text, **options).where("kept").select(F.col("number").alias("kept_number"))
        named = named.join(kept, F.col("number") == F.col("kept_number"), "left_semi").select(names)
    else:
        kept = near_duplicates(named, key, text, **options).where("kept").select(F.col(key).alias("kept_id"))
        named = named.join(kept, F.col(key) == F.col("kept_id"), "left_semi")
    return named.union(rows.where(F.col(key).isNull())).toDF(*docs.columns)
