"""Substring dedup: words covered by a passage that also stands elsewhere are removed.

Repeated-phrase automata.  Every window of ``window`` words names an anchor, its least 8-word
run by hash, so equal windows name equal anchors wherever they stand; consecutive windows
with one anchor are one row of the anchor table (about one row per 14 words).  Anchors that
stand in one place only leave with a count.  The rest is confirmed:

* the passages are gathered by anchor in bounded shards, windows that recur are confirmed on
  their exact words, joined to maximal phrases, compiled to an Aho-Corasick automaton (one
  character per word of the shard), and the shard's passages are streamed through it to locate
  every occurrence;
* if the anchor has more places than a shard may hold, its windows are counted one by one under
  two 64-bit hashes.

An anchor or window with a large share of all rows is never one task: the few there can be are
counted with partial sums and named in the filter that reads their rows.

No step keeps a list that grows with the copies of a passage; lists are per document.
Repeated rows count as places of their own, null ids and null texts are ordinary rows (no words).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import free_name, written

ANCHOR_WORDS = 8
#: Places of an anchor that one shard may hold, and words of one automaton's shard.
SHARD_PLACES = 1000
SHARD_WORDS = 60_000
#: At most so many anchors are taken out as hot: those with more than this part of all rows.
HOT_ANCHORS = 2000
SHARED, LARGE = 0, 1
_NO_ID = -(1 << 63)


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two values that name a row by its content: the id and a hash of the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(F.col(text_col))


def window_anchors(g: np.ndarray, span: int) -> np.ndarray:
    """Position of the least value among each run of ``span`` values, the first of equal ones."""
    value, at, width = g, np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        n = len(value) - step
        right = value[step:] < value[:n]
        at = np.where(right, at[step:], at[:n])
        value = np.where(right, value[step:], value[:n])
        width += step
    return at


def _runs(w: W.Words, window: int):
    """(row, first window, number of windows, anchor hash) of each run of windows with one anchor."""
    h = w.hashes()
    k = min(ANCHOR_WORDS, window)
    g = W.rolling(h, k)
    n = len(h) - window + 1
    if n <= 0:
        return None
    at = window_anchors(g, window - k + 1)
    whole = np.flatnonzero(w.doc[:n] == w.doc[window - 1:])  # windows inside one row
    if not len(whole):
        return None
    anchor = at[whole]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(whole)))
    start = whole[begin]
    row = w.doc[start]
    return row, start - w.first[row], count, g[anchor[begin]].view(np.int64)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("repeats")
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                found = _runs(W.words(piece.column("text")), window)
                if found is None:
                    continue
                row, first, count, anchor = found
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor), piece.column("did").take(pa.array(row)),
                    piece.column("th").take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                ], names=["h", "did", "th", "first", "n"])
    return run


PASSAGE = "h long, h2 long, kind int, did long, th long, first int, n int, passage string"


def _passages(window: int, schema: pa.Schema):
    """Words around anchors; windows one by one, hashed twice, around large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("repeats")
        for batch in batches:
            out: list[tuple] = []
            texts, runs = batch.column("text"), batch.column("runs")
            dids, ths = batch.column("did").to_pylist(), batch.column("th").to_pylist()
            for i in range(batch.num_rows):
                todo = runs[i].as_py()
                split = (texts[i].as_py() or "").encode().split()
                if any(r["kind"] == LARGE for r in todo):
                    h = W.words(texts.slice(i, 1)).hashes()
                    one, two = W.Prefix(h), W.Prefix(h, 0x5851F42D4C957F2D)
                for r in todo:
                    first, n = r["first"], r["n"]
                    if r["kind"] == LARGE:
                        at = np.arange(first, first + n)
                        a, b = one.range(at, at + window).view(np.int64), two.range(at, at + window).view(np.int64)
                        out += [(int(x), int(y), LARGE, dids[i], ths[i], int(s), 1, None) for x, y, s in zip(a, b, at, strict=True)]
                    else:
                        passage = b" ".join(split[first:first + n + window - 1]).decode()
                        out.append((r["h"], 0, SHARED, dids[i], ths[i], first, n, passage))
                if len(out) > 20_000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Shard:
    """Passages of some anchors: one character per distinct word, so a window is a slice of a string."""

    def __init__(self, window: int):
        self.window, self.places, self.texts, self.letters, self.size = window, [], [], {}, 0

    def add(self, place: tuple, passage: str) -> None:
        letters = self.letters
        text = []
        for word in passage.encode().split():
            code = letters.get(word)
            if code is None:
                code = letters[word] = chr(len(letters) + (1 if len(letters) < 0xD7FF else 0x801))  # no surrogates
            text.append(code)
        self.places.append(place)
        self.texts.append("".join(text))
        self.size += len(text)

    def found(self) -> Iterator[tuple]:
        """(did, th, first, n) of every occurrence of a confirmed phrase."""
        import ahocorasick

        width = self.window
        count = Counter(t[i:i + width] for t in self.texts for i in range(len(t) - width + 1))
        automaton = ahocorasick.Automaton()
        for t in self.texts:
            begin = None
            for i in range(len(t) - width + 2):
                twice = i <= len(t) - width and count[t[i:i + width]] > 1
                if twice and begin is None:
                    begin = i
                elif not twice and begin is not None:
                    phrase, begin = t[begin:i + width - 1], None
                    automaton.add_word(phrase, len(phrase))
        if not len(automaton):
            return
        automaton.make_automaton()
        for place, t in zip(self.places, self.texts, strict=True):
            covered = np.zeros(len(t) + 1, dtype=np.int32)
            for end, length in automaton.iter(t):
                covered[end - length + 1] += 1
                covered[end - width + 2] -= 1  # starts of the phrase's windows
            starts = np.flatnonzero(np.cumsum(covered) > 0)
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > 1) + 1
                for part in np.split(starts, breaks):
                    yield place[0], place[1], place[2] + int(part[0]), len(part)


LOCATED = "did long, th long, first int, n int"


def _locate(window: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("repeats")
        shard, last = Shard(window), None
        for batch in batches:
            for h, did, th, first, passage in zip(*(batch.column(c).to_pylist() for c in ("h", "did", "th", "first", "passage")), strict=True):
                if h != last and shard.size > SHARD_WORDS:
                    if rows := list(shard.found()):
                        yield _batch(rows, schema)
                    shard = Shard(window)
                last = h
                shard.add((did, th, first), passage)
        if rows := list(shard.found()):
            yield _batch(rows, schema)
    return run


def _remove(window: int, text_name: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("repeats")
        names = schema.names[:-3]
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            texts, located = batch.column(text_name), batch.column("located").to_pylist()
            total, removed, kept = [], [], []
            for text, more in zip(texts, located, strict=True):
                split = (text.as_py() or "").encode().split()
                spans = [(r["first"], r["n"]) for r in more or ()]
                total.append(len(split))
                if not spans:
                    removed.append(0)
                    kept.append(b" ".join(split).decode())
                    continue
                change = np.zeros(len(split) + 1, dtype=np.int32)
                at = np.array(spans)
                np.add.at(change, at[:, 0], 1)
                np.add.at(change, at[:, 0] + at[:, 1] + window - 1, -1)
                keep = np.cumsum(change[:-1]) == 0
                removed.append(int((~keep).sum()))
                edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
                kept.append(b" ".join(b" ".join(split[a:b]) for a, b in edges.reshape(-1, 2)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)
    return run


def _with_kind(anchors: DataFrame) -> DataFrame:
    """Anchor rows that stand in two places or more, with how to treat them.

    The few anchors that have a large share of all rows are named by a count (their number is
    bounded by the share) and decided where their rows are read; all others are decided by a
    window over the anchor's rows.
    """
    least_rows = max(SHARD_PLACES, anchors.count() // HOT_ANCHORS)
    hot = [r["h"] for r in anchors.groupBy("h").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > least_rows).collect()]
    columns = ["h", "did", "th", "first", "n"]
    named = F.col("h").isin(hot)
    rest = (anchors.where(~named).withColumn("places", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("places > 1")
            .select(*columns, F.when(F.col("places") <= SHARD_PLACES, SHARED).otherwise(LARGE).alias("kind")))
    return anchors.where(named).select(*columns, F.lit(LARGE).alias("kind")).union(rest)


def _twice(windows: DataFrame) -> DataFrame:
    """Rows of windows (h, h2) that stand in two places or more; hot ones are named by a count, others found by a window."""
    least_rows = max(SHARD_PLACES, windows.count() // HOT_ANCHORS)
    hot = windows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > least_rows).collect()
    named = F.col("h").isin([r["h"] for r in hot]) & F.col("h2").isin([r["h2"] for r in hot])
    rest = windows.where(~named).withColumn("places", F.count(F.lit(1)).over(Window.partitionBy("h", "h2"))).where("places > 1").drop("places")
    return windows.where(named).union(rest)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """The input rows and columns with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a window of ``window`` consecutive words over it also starts at another
    place of the table, the same document included; windows are judged on the input.  New
    columns whose names are taken get an underscore.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if window < 2:
        raise ValueError("a window has two words at least")
    did, th = _key(id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    base = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)),
                       did.alias("did"), th.alias("th"))
    text_name = names[docs.columns.index(text_col)]
    anchors = written(
        docs.select(F.col(text_col).alias("text"), did.alias("did"), th.alias("th"))
        .mapInArrow(_anchor_rows(window), "h long, did long, th long, first int, n int"), "anchors")
    kinds = _with_kind(anchors)
    runs = (kinds.groupBy("did", "th")
            .agg(F.collect_list(F.struct("first", "n", "kind", F.when(F.col("kind") == SHARED, F.col("h")).alias("h"))).alias("runs")))
    around = base.select(F.col(text_name).alias("text"), "did", "th").join(runs.hint("shuffle_hash"), ["did", "th"])
    empty = docs.sparkSession.createDataFrame([], PASSAGE)
    passages = around.mapInArrow(_passages(window, to_arrow_schema(empty.schema)), PASSAGE)
    passages = written(passages, "passages")
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], LOCATED).schema)
    by_words = (passages.where(F.col("kind") == SHARED).select("h", "did", "th", "first", "passage")
                .repartition("h").sortWithinPartitions("h").mapInArrow(_locate(window, schema), LOCATED))
    large = passages.where(F.col("kind") == LARGE)
    by_count = _twice(large).select("did", "th", "first", "n")
    located = by_words.union(by_count).groupBy("did", "th").agg(F.collect_list(F.struct("first", "n")).alias("located"))

    whole = base.join(located.hint("shuffle_hash"), ["did", "th"], "left")
    new = [free_name(docs, n) for n in ("n_words", "n_removed", "kept_text")]
    out = docs.sparkSession.createDataFrame([], base.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string"))
    done = whole.select(*names, "located").mapInArrow(_remove(window, text_name, to_arrow_schema(out.schema)), out.schema)
    return done.toDF(*docs.columns, *new)
