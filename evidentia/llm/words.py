"""Words of Arrow text columns as numpy arrays: boundaries, hashes, rolling hashes.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; on UTF-8 this is the run
``[^\\x20\\x09-\\x0D]+`` of characters.  Batches are worked through in pieces of about a megabyte
of text, so memory does not follow the batch size; one longer text makes one longer piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


_kept: dict[str, Callable[[], None]] = {}


def turn_to(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called where an operator begins a task: drops what other operators have kept in this worker.

    Workers serve one stage after another; without this, the caches of a finished stage
    would stand beside the working memory of the next.  ``release`` drops the owner's own.
    """
    for other in [k for k in _kept if k != owner]:
        _kept.pop(other)()
    if release is not None:
        _kept[owner] = release


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        base, inverse = np.full(size, _MULT), np.full(size, _INVERSE)
        base[0] = inverse[0] = 1
        _powers, _inverse_powers = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return _powers[:n], _inverse_powers[:n]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word, into data
    ends: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # first word of each row, and the number of words

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        at, stop = int(self.starts[0]), int(self.ends[-1])
        data = self.data[at:stop]
        begins = self.starts - at
        span = np.diff(np.append(begins, len(data)))
        inside = np.arange(len(data), dtype=np.int64) - np.repeat(begins, span)
        table, _ = powers(int(span.max()) + 1)
        values = _BYTE[data] * table[inside]
        values[_SPACE[data]] = 0
        return mix(np.add.reduceat(values, begins))


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string column; null counts as empty; ``lower`` folds A-Z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    if len(data):
        edge = np.ones(len(data) + 1, dtype=bool)  # a word may begin here
        edge[1:-1] = space[:-1]
        edge[offsets] = True
        starts = np.flatnonzero(~space & edge[:-1])
        stop = np.ones(len(data), dtype=bool)  # a word may end here
        stop[:-1] = space[1:] | edge[1:-1]
        ends = np.flatnonzero(~space & stop) + 1
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, doc, first)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have about a megabyte together."""
    n = batch.num_rows
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (rows are not told apart here)."""
    n = max(0, len(hashes) - k + 1)
    table, _ = powers(k)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += hashes[j:j + n] * table[j]
    return mix(total)


class Prefix:
    """Hashes of arbitrary word ranges from one prefix sum."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        table, self.inverse = powers(len(hashes) + 1)
        own = mix(hashes ^ np.uint64(salt)) if salt else hashes
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(own * table[:len(hashes)], out=self.sums[1:])

    def range(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
