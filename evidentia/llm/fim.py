"""Fill-in-the-middle: every text cut in three and reordered between marks, and put back again.

Displacement scatter.  A batch of texts is one byte array.  A scan finds the code points, so a
cut after k of them is a byte place.  Every part (prefix, middle, suffix) of every text moves as
one block, so a difference array, written at the parts' first bytes only, becomes each byte's
shift by a cumulative sum, and one numpy scatter lays out all outputs of the batch.  Restoring
reads the marks of the outputs, builds the same kind of difference array over the restored
bytes, and gathers.

Cuts and forms are drawn from the sha256 of ``seed:id``, so they depend on the row alone.

Defined cases: a null text is an empty one, which stays plain; a null id draws as the empty
string; rows with one id draw alike; texts holding a mark stay plain, so marks in an output are
always the operator's.  All columns of the input pass through, new ones take free names.
Batches are worked through in pieces of about a megabyte; a longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import free_name

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKS = (b"<P>", b"<M>", b"<S>")  # of prefix, middle, suffix
MARK = 3
#: Parts in the order in which a form writes them.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins among them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    if valid is None or valid.all():
        return made
    return made.take(pa.array(np.arange(len(valid)), mask=~valid))


def _marks_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, part) of every mark that lies inside one row."""
    part = np.full(256, -1, dtype=np.int64)
    for number, mark in enumerate(MARKS):
        part[mark[1]] = number
    if len(data) < MARK:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.flatnonzero((data[:-2] == MARKS[0][0]) & (data[2:] == MARKS[0][2]) & (part[data[1:-1]] >= 0))
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + MARK <= offsets[row + 1]
    at, row = at[inside], row[inside]
    return at, row, part[data[at + 1]]


def _shifts(size: int, begin: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Each byte's shift, from the first bytes of blocks in ascending order and the blocks' shifts; empty blocks take no effect."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, begin, np.diff(shift, prepend=0))
    return np.cumsum(change[:-1])


def scatter(texts: pa.Array, draws: np.ndarray, rate: int, spm: int) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """The outputs of a piece, and per row: code points, form, and code points of prefix and middle.

    ``draws`` has four unsigned numbers per row: two cuts, whether to cut, and which form.
    """
    data, offsets = _bytes(texts)
    rows = len(offsets) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    first = np.searchsorted(lead, offsets)
    chars = np.diff(first)
    cuts = draws[:, :2] % (chars[:, None] + 1)
    low, high = cuts.min(axis=1), cuts.max(axis=1)
    marked = np.zeros(rows, dtype=bool)
    marked[_marks_at(data, offsets)[1]] = True
    plain = (chars == 0) | marked | (draws[:, 2] % 100 >= rate)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < spm, SPM, PSM))

    place = np.append(lead, len(data))
    begin = np.stack([offsets[:-1], place[first[:-1] + low], place[first[:-1] + high]], axis=1)  # of prefix, middle, suffix
    length = np.diff(begin, axis=1, append=offsets[1:, None])
    out = np.concatenate([[0], np.cumsum(np.diff(offsets) + MARK * len(MARKS) * ~plain)])
    target = begin - offsets[:-1, None] + out[:-1, None]  # plain texts keep their order
    for kind, order in ORDER.items():
        here = np.flatnonzero(form == kind)
        at = out[here]
        for part in order:
            target[here, part] = at + MARK
            at = at + MARK + length[here, part]
    shift = _shifts(len(data), begin.ravel(), (target - begin).ravel())
    made = np.empty(out[-1], dtype=np.uint8)
    made[np.arange(len(data)) + shift] = data
    for part, mark in enumerate(MARKS):
        at = target[~plain, part] - MARK
        for k, byte in enumerate(mark):
            made[at + k] = byte
    return _strings(made, out), {"chars": chars, "form": form, "low": low, "high": high}


def gather(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts behind outputs of the given forms; null where marks do not stand as the form writes them."""
    data, offsets = _bytes(outputs)
    rows = len(offsets) - 1
    at, row, part = _marks_at(data, offsets)
    count = np.bincount(row, minlength=rows)
    whole = (count == len(MARKS)) & (form != PLAIN)
    at, part = (x[whole[row]].reshape(-1, len(MARKS)) for x in (at, part))
    wanted = np.array([ORDER[f] for f in form[whole]], dtype=np.int64).reshape(-1, len(MARKS))
    good = (part == wanted).all(axis=1) & (at[:, 0] == offsets[:-1][whole])
    whole[np.flatnonzero(whole)[~good]] = False
    at, wanted = at[good], wanted[good]
    stop = np.concatenate([at[:, 1:], offsets[1:][whole][:, None]], axis=1)
    source, length = np.zeros((rows, len(MARKS)), np.int64), np.zeros((rows, len(MARKS)), np.int64)
    of = np.flatnonzero(whole)[:, None]
    source[of, wanted], length[of, wanted] = at + MARK, stop - at - MARK
    alone = form == PLAIN
    source[alone] = np.stack([offsets[:-1], offsets[1:], offsets[1:]], axis=1)[alone]
    length[alone, PREFIX] = np.diff(offsets)[alone]
    out = np.concatenate([[0], np.cumsum(length.sum(axis=1))])
    target = out[:-1, None] + np.cumsum(length, axis=1) - length
    shift = _shifts(int(out[-1]), target.ravel(), (source - target).ravel())
    return _strings(data[np.arange(int(out[-1])) + shift], out, alone | whole)


def _passed(df: DataFrame, **inputs) -> tuple[DataFrame, list[str]]:
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.select(*(df[i].alias(n) for i, n in enumerate(names)), *(c.alias(n) for n, c in inputs.items())), names


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = 90, spm: int = 20,
              restored_col: str | None = None) -> DataFrame:
    """Adds n_chars, form, prefix_chars, middle_chars and output, under free names in this order.

    ``rate`` percent of the texts are cut, of these ``spm`` percent with the suffix first.  With
    ``restored_col`` the outputs are read back in the same pass, and that text is added too.
    """
    key, text = docs[docs.columns.index(id_col)], docs[docs.columns.index(text_col)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    rows, names = _passed(docs, text=text, digest=digest)
    new = ["n_chars", "form", "prefix_chars", "middle_chars", "output"] + ([restored_col] if restored_col else [])
    kinds = ["long", "string", "long", "long", "string", "string"]
    outputs = [f"o{i}" for i in range(len(new))]
    schema = rows.select(*names).withColumns({o: F.lit(None).cast(kind) for o, kind in zip(outputs, kinds, strict=False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("fim")
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                drawn = np.frombuffer(b"".join(bytes.fromhex(d[:32]) for d in piece.column("digest").to_pylist()), dtype=">u4")
                made, about = scatter(piece.column("text"), drawn.reshape(-1, 4).astype(np.int64), rate, spm)
                cut = about["form"] != PLAIN
                columns = [pa.array(about["chars"]), pa.array(FORMS[about["form"]], pa.string()), pa.array(about["low"], mask=~cut),
                           pa.array(about["high"] - about["low"], mask=~cut), made]
                if restored_col:
                    columns.append(gather(made, about["form"]))
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + columns, names=[*names, *outputs])

    return rows.mapInArrow(run, schema).toDF(*docs.columns, *(free_name(docs, name) for name in new))


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """Adds the exact text behind each output.  A null output counts as empty, a null form as plain; null where the marks do not fit the form."""
    form = F.coalesce(F.array_position(F.array(*map(F.lit, FORMS.tolist())), outputs[outputs.columns.index(form_col)]), F.lit(1)) - 1
    rows, names = _passed(outputs, text=outputs[outputs.columns.index(output_col)], kind=F.greatest(form, F.lit(0)))
    schema = rows.select(*names).withColumn("restored", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("fim")
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                back = gather(piece.column("text"), piece.column("kind").to_numpy())
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [back], names=[*names, "restored"])

    return rows.mapInArrow(run, schema).toDF(*outputs.columns, free_name(outputs, restored_col))
