"""Byte-level BPE encoding and decoding with the vocabulary file of a public tokenizer.

Contiguous rank array: a short word is a list of part boundaries (here the ids between them) and
a list of the ranks of adjacent pairs.  The least rank is looked for by scanning, its boundary
is deleted, and the two neighbouring ranks are refreshed.  Scanning is quadratic in the length,
so a word of more than ``SCAN_BYTES`` bytes goes through a heap instead, with equal results.

The driver reads the file and broadcasts it (a vocabulary has a fixed size); each worker keeps a
bounded cache of encoded words.  Rows never meet: there is no shuffle.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import free_name

SCAN_BYTES = 300
CACHE_WORDS = 150_000
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: end fixed value
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Cache(dict):
    """Encoded words; at most twice ``CACHE_WORDS`` of them, those used lately."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        done = self.old.get(word)
        if done is None:
            ids = self.encode(word)
            done = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= SCAN_BYTES:
            self[word] = done
        return done

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class Bpe:
    """Both directions, or with ``encoder=False`` only what decoding needs."""

    def __init__(self, source: str, encoder: bool = True):
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        vocab = model["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.added = added
        self.token = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for text, i in vocab.items():
            self.token[i] = bytes(of_letter[c] for c in text) if all(c in of_letter for c in text) else text.encode()
        for text, i in added.items():
            self.token[i] = text.encode()
        if encoder:
            self._encoder(model, vocab, letters, added)

    def _encoder(self, model: dict, vocab: dict[str, int], letters: list[str], added: dict[str, int]) -> None:
        import regex

        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.words = regex.compile(SPLIT).findall
        longest = sorted(added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in longest) + ")") if added else None
        self.cache = Cache(self.word)

    def word(self, word: str) -> list[int]:
        ids = [self.byte_ids[b] for b in word.encode()]
        if len(ids) > SCAN_BYTES:
            return self._long(ids)
        get = self.pairs.get
        none = (NO_RANK, 0)
        ranks = [get(a << 32 | b, none)[0] for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = get(ids[at] << 32 | ids[at + 1])[1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], none)[0]
            if at < len(ranks):
                ranks[at] = get(ids[at] << 32 | ids[at + 1], none)[0]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(hit[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (hit := get(a << 32 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a part of this pair has gone
            ids[i], ids[j] = get(a << 32 | b)[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (hit[0], i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (hit := get(ids[p] << 32 | ids[i])):
                heapq.heappush(heap, (hit[0], p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        get = self.cache.__getitem__
        if self.specials is None or not any(t in text for t in self.added):
            done = b"".join(map(get, self.words(text)))
        else:
            done = b"".join(struct.pack("<I", self.added[part]) if part in self.added else b"".join(map(get, self.words(part)))
                            for part in self.specials.split(text))
        self.cache.trim()
        return done

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", errors="replace")


_loaded: dict[tuple[int, bool], Bpe] = {}


def _bpe(shared, encoder: bool) -> Bpe:
    W.turn_to("bpe", _loaded.clear)
    source = shared.value
    key = (hash(source), encoder)
    if key not in _loaded:
        _loaded[key] = Bpe(source, encoder)
    return _loaded[key]


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with_arrow_columns(df: DataFrame, new: list[tuple[str, str]], column: str, work) -> DataFrame:
    """Adds (name, type) columns that ``work(batch, name)`` computes from Arrow slices and one column of theirs; the others pass through as they are."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.select(*(df[i].alias(n) for i, n in enumerate(names)))
    source = names[df.columns.index(column)]
    outputs = [f"output{i}" for i in range(len(new))]
    schema = plain.withColumns({n: F.lit(None).cast(kind) for n, (_, kind) in zip(outputs, new, strict=True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, made in work(batch, source):
                yield pa.RecordBatch.from_arrays([rows.column(n) for n in names] + made, names=[*names, *outputs])

    return plain.mapInArrow(run, schema).toDF(*df.columns, *(free_name(df, name) for name, _ in new))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Adds the token ids of every text (null: empty) as array<int>.

    Strings of added tokens in a text become those tokens; nothing is added, cut or padded.
    With ``decoded_col`` the ids are decoded again in the same pass and that text is added too.
    """
    shared = _shared(df, path)

    def work(batch: pa.RecordBatch, name: str):
        bpe = _bpe(shared, True)
        for piece in W.pieces(batch, name):
            done = [bpe.encode(t) if t else b"" for t in piece.column(name).to_pylist()]
            ends = np.cumsum([0] + [len(d) // 4 for d in done]).astype(np.int32)
            values = np.frombuffer(b"".join(done), dtype="<u4").astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            if decoded_col is not None:
                made.append(_texts(bpe, values, ends))
            yield piece, made

    new = [(ids_col, "array<int>")] + ([(decoded_col, "string")] if decoded_col is not None else [])
    return _with_arrow_columns(df, new, text_col, work)


def _texts(bpe: Bpe, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([bpe.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of every id list (null: empty), special tokens included; broken UTF-8 becomes U+FFFD."""
    shared = _shared(df, path)

    def work(batch: pa.RecordBatch, name: str):
        bpe = _bpe(shared, False)
        step = 500
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            column = piece.column(name).fill_null([])
            yield piece, [_texts(bpe, column.values.to_numpy(), column.offsets.to_numpy())]

    return _with_arrow_columns(df, [(text_col, "string")], ids_col, work)
