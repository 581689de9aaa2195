"""Language identification with a linear-chain conditional random field over words.

A word's features are its affixes (first and last one to three bytes), its byte 2- and 3-grams,
and its entry in a lexicon of words seen in training; weights of hashed features add up to a
score per language.  Learned transitions say how likely the language changes from one word to
the next.  Forward-backward gives every word's distribution, so text that switches languages
is labelled word by word; a document's language is the one with most expected words.

The field is fitted on the driver on spans of a bounded sample of labelled rows (``ROWS_PER_LANGUAGE``
rows of each language, ``SPANS_PER_ROW`` spans of ``SPAN_WORDS`` words spread over each).  Training
sequences join spans of one or of several languages, which is what transitions are learned
from.  The fitted weights have a fixed size and go to the workers in a broadcast.
Prediction is one pass without a shuffle; sequences are cut to segments that are worked in
parallel and joined by their transfer matrices, with the same result as one long chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import free_name

ROWS_PER_LANGUAGE = 400
SPANS_PER_ROW, SPAN_WORDS = 8, 24
BUCKETS = 1 << 15
LEXICON = 20_000
SEGMENT = 32
UNDETERMINED = "und"
_SALT = np.uint64(0x632BE59BD9B4E019)


def _features(w: W.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each affix and n-gram of the picked words."""
    starts, ends = w.starts[pick], w.ends[pick]
    size = ends - starts
    data = np.append(w.data, np.zeros(3, np.uint8)).astype(np.uint64)
    words, codes = [], []
    which = np.repeat(np.arange(len(pick)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    last = np.repeat(ends, size)
    one, two, three = data[at], data[at + 1], data[at + 2]
    for n in (2, 3):
        ok = at + n <= last
        code = one | two << np.uint64(8) | (three << np.uint64(16) if n == 3 else np.uint64(0))
        words.append(which[ok])
        codes.append(code[ok] | np.uint64(n) << np.uint64(32))
    for n in (1, 2, 3):
        ok = np.flatnonzero(size >= n)
        for kind, begin in ((8, starts[ok]), (16, ends[ok] - n)):
            code = np.zeros(len(ok), dtype=np.uint64)
            for j in range(n):
                code |= data[begin + j] << np.uint64(8 * j)
            words.append(ok)
            codes.append(code | np.uint64(n + kind) << np.uint64(32))
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    return np.concatenate(words), (W.mix(code * _SALT) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Crf:
    languages: list[str]
    lexicon: np.ndarray  # sorted word hashes
    weights: np.ndarray  # BUCKETS + len(lexicon) + 1 rows, the last one the bias
    moves: np.ndarray  # score of going from language to language

    def feature_rows(self, w: W.Words, hashes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, bucket = _features(w, pick)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes[pick]), len(self.lexicon) - 1)
            known = np.flatnonzero(self.lexicon[at] == hashes[pick])
            word, bucket = np.concatenate([word, known]), np.concatenate([bucket, BUCKETS + at[known]])
        return word, bucket

    def scores(self, w: W.Words, hashes: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Score of each language for the picked words; features of a word count by their mean."""
        word, bucket = self.feature_rows(w, hashes, pick)
        out = np.empty((len(pick), len(self.languages)))
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(word, weights=self.weights[bucket, j], minlength=len(pick)) + self.weights[-1, j]
        return out

    def expected(self, w: W.Words) -> np.ndarray:
        """Expected number of words of each language in every row (words with letters; all words where none has one)."""
        rows, n, k = len(w.first) - 1, len(w.starts), len(self.languages)
        total = np.zeros((rows, k))
        if not n:
            return total
        hashes = w.hashes()
        distinct, pick, back = np.unique(hashes, return_index=True, return_inverse=True)
        own = self.scores(w, hashes, pick)
        factor = np.exp(np.maximum(own - own.max(axis=1, keepdims=True), -60))[back]
        letter = np.zeros(len(w.data) + 1, dtype=np.int64)
        np.cumsum((w.data >= 0x80) | (((w.data | 32) >= 97) & ((w.data | 32) <= 122)), out=letter[1:])
        weight = (letter[w.ends] > letter[w.starts]).astype(float)
        none = np.add.reduceat(np.append(weight, 0), np.minimum(w.first[:-1], n))
        none = np.where(np.diff(w.first) > 0, none, 1) == 0
        weight[none[w.doc]] = 1
        marginal = self._marginals(factor, w.first)
        for j in range(k):
            total[:, j] = np.bincount(w.doc, weights=marginal[:, j] * weight, minlength=rows)
        return total

    def _marginals(self, factor: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's distribution by forward-backward; ``first`` is where each row begins."""
        move, k = np.exp(self.moves), len(self.languages)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        parts = -(-sizes[full] // SEGMENT)
        row_of = np.repeat(np.arange(len(full)), parts)
        number = np.arange(len(row_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[full][row_of] + number * SEGMENT
        length = np.minimum(SEGMENT, first[full + 1][row_of] - begin)
        order = np.argsort(-length, kind="stable")  # long segments first: those still going on are a leading slice
        begin, length = begin[order], length[order]
        going = [int(np.searchsorted(-length, -t, side="left")) for t in range(SEGMENT)]  # longer than t
        head = number[order] == 0
        # transfer matrix of each segment: from the language before it to the one at its end
        transfer = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
        for t in range(SEGMENT):
            m = going[t]
            if not m:
                break
            step = transfer[:m] @ move if t else np.where(head[:m, None, None], transfer[:m], move[None])
            step *= factor[begin[:m] + t][:, None, :]
            transfer[:m] = step / step.max(axis=(1, 2), keepdims=True)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        ends = np.cumsum(parts)
        starts = ends - parts
        into, out = np.ones((len(begin), k)), np.ones((len(begin), k))
        most = int(parts.max(initial=0))
        by_parts = np.argsort(-parts, kind="stable")
        count = [int(np.searchsorted(-parts[by_parts], -s, side="left")) for s in range(most)]  # rows with more than s segments
        state = np.full((len(full), k), 1.0 / k)
        for s in range(most):
            rows = by_parts[:count[s]]
            at = place[starts[rows] + s]
            into[at] = state[rows]
            new = np.einsum("ni,nij->nj", state[rows], transfer[at])
            state[rows] = new / new.sum(axis=1, keepdims=True)
        state = np.ones((len(full), k))
        for s in range(most):
            rows = by_parts[:count[s]]
            at = place[ends[rows] - 1 - s]
            out[at] = state[rows]
            new = np.einsum("nij,nj->ni", transfer[at], state[rows])
            state[rows] = new / new.sum(axis=1, keepdims=True)
        # inside the segments, with what comes from both sides
        forward = np.empty((SEGMENT, len(begin), k))
        now = into
        for t in range(SEGMENT):
            m = going[t]
            if not m:
                break
            now = (now[:m] @ move if t else np.where(head[:m, None], now[:m], now[:m] @ move)) * factor[begin[:m] + t]
            now = now / now.sum(axis=1, keepdims=True)
            forward[t, :m] = now
        result = np.empty_like(factor)
        back = out.copy()
        for t in range(SEGMENT - 1, -1, -1):
            m = going[t]
            if not m:
                continue
            both = forward[t, :m] * back[:m]
            result[begin[:m] + t] = both / both.sum(axis=1, keepdims=True)
            if t:
                new = (back[:m] * factor[begin[:m] + t]) @ move.T
                back[:m] = new / new.sum(axis=1, keepdims=True)
        return result


def fit(spans: list[tuple[str, str]], seed: int = 5, steps: int = 240, batch: int = 48, parts: int = 6, rate: float = 0.4) -> Crf:
    """Fits the field to (language, text) spans by AdaGrad on the exact likelihood gradient.

    Training sequences have ``parts`` spans; half of them switch languages between spans.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    spans = sorted(spans)
    languages = sorted({lang for lang, _ in spans})
    w = W.words(pa.array([t for _, t in spans], pa.string()))
    hashes = w.hashes()
    distinct, times = np.unique(hashes, return_counts=True)
    often = np.flatnonzero(times >= 3)
    lexicon = np.sort(distinct[often[np.argsort(-times[often], kind="stable")[:LEXICON]]])
    k = len(languages)
    crf = Crf(languages, lexicon, np.zeros((BUCKETS + len(lexicon) + 1, k)), np.zeros((k, k)))
    if k < 2 or not len(hashes):
        return crf
    label = np.array([languages.index(lang) for lang, _ in spans])
    _, pick, word_of = np.unique(hashes, return_index=True, return_inverse=True)
    word, bucket = crf.feature_rows(w, hashes, pick)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order].astype(np.int32)
    begin = np.searchsorted(word, np.arange(len(pick) + 1))
    del word, order
    of_label = [np.flatnonzero((label == j) & (np.diff(w.first) > 0)) for j in range(k)]
    usable = [j for j in range(k) if len(of_label[j])]
    sum_w, sum_m = np.full_like(crf.weights, 1e-8), np.full((k, k), 1e-8)
    for step in range(steps):
        sequences = []
        for b in range(batch):
            langs = rng.choice(usable, parts) if b % 2 else np.full(parts, rng.choice(usable))
            chosen = [rng.choice(of_label[j]) for j in langs]
            sequences.append(np.concatenate([np.arange(w.first[c], w.first[c + 1]) for c in chosen]))
        longest = max(map(len, sequences))
        at = np.full((batch, longest), -1)
        for b, s in enumerate(sequences):
            at[b, :len(s)] = s
        there = at >= 0
        flat = at[there]
        truth = np.where(there, label[w.doc[np.maximum(at, 0)]], 0)
        kinds = word_of[flat]
        lengths = begin[kinds + 1] - begin[kinds]
        feature = np.concatenate([bucket[begin[i]:begin[i + 1]] for i in kinds])
        owner = np.repeat(np.arange(len(flat)), lengths)
        own = np.stack([np.bincount(owner, weights=crf.weights[feature, j], minlength=len(flat)) for j in range(k)], axis=1) + crf.weights[-1]
        factor = np.ones((batch, longest, k))
        factor[there] = np.exp(np.maximum(own - own.max(axis=1, keepdims=True), -60))
        move = np.exp(crf.moves)
        alpha, beta = np.empty_like(factor), np.ones_like(factor)
        alpha[:, 0] = factor[:, 0] / factor[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            new = np.where(there[:, t, None], (alpha[:, t - 1] @ move) * factor[:, t], alpha[:, t - 1])
            alpha[:, t] = new / new.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            new = np.where(there[:, t + 1, None], (beta[:, t + 1] * factor[:, t + 1]) @ move.T, beta[:, t + 1])
            beta[:, t] = new / new.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * move[None, None] * (beta[:, 1:] * factor[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        pair *= there[:, 1:, None, None]
        change = gamma[there].copy()
        change[np.arange(len(flat)), truth[there]] -= 1
        grad = np.stack([np.bincount(feature, weights=change[owner, j], minlength=len(crf.weights)) for j in range(k)], axis=1)
        grad[-1] = change.sum(axis=0)
        grad = grad / batch + 1e-4 * crf.weights
        sum_w += grad ** 2
        crf.weights -= rate * grad / np.sqrt(sum_w)
        moves = pair.sum(axis=(0, 1))
        np.subtract.at(moves, (truth[:, :-1][there[:, 1:]], truth[:, 1:][there[:, 1:]]), 1)
        moves /= batch
        sum_m += moves ** 2
        crf.moves -= rate * moves / np.sqrt(sum_m)
    return crf


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of words spread evenly over each text."""
    for batch in batches:
        lang, text = [], []
        for name, whole in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            split = whole.encode().split()
            pieces = max(1, min(SPANS_PER_ROW, len(split) // SPAN_WORDS))
            for i in range(pieces):
                at = len(split) * i // pieces
                lang.append(name)
                text.append(b" ".join(split[at:at + SPAN_WORDS]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.string())], names=["lang", "text"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Crf:
    """Fits the field to at most ``rows`` rows of each language, the least by a hash of id and text."""
    has = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = has.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    share = {r[0]: min(1.0, 3.0 * rows / r[1]) for r in has.groupBy(lang_col).count().collect()}
    if not share:
        return Crf([], np.zeros(0, np.uint64), np.zeros((BUCKETS + 1, 0)), np.zeros((0, 0)))
    limit = F.create_map(*(F.lit(x) for name, part in share.items() for x in (name, part)))
    near = keyed.where(F.pmod("h", F.lit(1 << 30)) < limit[F.col("lang")] * (1 << 30)).where(_has_letter(F.col("text")))
    least = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= rows)
    spans = least.select("lang", "text").mapInArrow(_spans, "lang string, text string").collect()
    return fit([(r[0], r[1]) for r in spans])


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_words (expected words of each language) to every row.

    The language with most expected words wins, ties to the first by name; its share is the
    score.  Texts that are null or without a letter, and all texts where nothing was learned, get
    ``und`` and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]  # sent once: a second copy would double the batches in both processes
    plain = docs.select(*(docs[i].alias(n) for i, n in enumerate(names))).withColumn("letter", _has_letter(F.col(text)))
    schema = plain.drop("letter").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "lang_words": F.lit(None).cast("array<double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("langid")
        field = shared.value
        for batch in batches:
            for piece in W.pieces(batch, text):
                w = W.words(piece.column(text))
                found = field.expected(w) if field.languages else np.zeros((piece.num_rows, 1))
                total = found.sum(axis=1)
                ok = piece.column("letter").to_numpy(zero_copy_only=False) & (total > 0)
                best = found.argmax(axis=1)
                score = np.where(ok, found[np.arange(len(found)), best] / np.where(total > 0, total, 1), 0)
                lang = [field.languages[b] if o else UNDETERMINED for b, o in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(list(found), pa.list_(pa.float64()))],
                    names=schema.names)

    new = [free_name(docs, n) for n in ("lang_pred", "score", "lang_words")]
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *new)


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for ids whose CRC-32 as text falls in the fold that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
