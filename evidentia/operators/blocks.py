"""Blocks of the indexes as arrays: packed from the texts or chunks of a block, and searched where they lie."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get the code itself, wherever this package lies

#: First bytes that needles are looked up by, as one number.
HEAD = 8
#: Rows of (needle, place) that are united at once.
AT_ONCE = 4_000_000
#: Terms and queries that are scored at once.
SLAB_TERMS, SLAB_QUERIES = 4096, 256

PLACE = pa.struct([("slot", pa.int32()), ("grp", pa.int32()), ("bits", pa.int64())])
RUN = pa.struct([("run", pa.string()), ("found", pa.list_(PLACE))])


#: Line ends as they stand in a text, and the pieces of a block that are numbered at once.
BREAKS = ("\r\n", *"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
PIECES_AT_ONCE = 1_000_000


def _packed(repo, block: int, files: list, pieces: pa.ChunkedArray, slots: np.ndarray, sizes: np.ndarray, repo_type: pa.DataType) -> pa.RecordBatch:
    """The row of a block from the pieces of its texts in order: runs, and a line end wherever a line ends.

    ``slots`` and ``sizes`` say of each text which file it is and how many of the pieces are its own.
    """
    pieces = pieces.unify_dictionaries().combine_chunks()
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.chunk(0) if pieces.num_chunks else pa.array([], pa.string()).dictionary_encode()
    is_end = pc.is_in(pieces.dictionary, pa.array(BREAKS)).to_numpy(zero_copy_only=False)
    code = pieces.indices.to_numpy().astype(np.int64)
    ends = is_end[code]
    before = np.cumsum(ends) - ends
    first = np.concatenate([before, [0]])[np.minimum(np.cumsum(sizes) - sizes, len(before))]
    line = (before - np.repeat(first, sizes))[~ends]
    place = np.repeat(slots, sizes)[~ends] << 32 | line >> 6
    code = (np.cumsum(~is_end) - 1)[code[~ends]]
    # pieces come in the order of their places, where no file stands in the block twice
    order = np.argsort(code, kind="stable") if (place[1:] >= place[:-1]).all() else np.lexsort((place, code))
    code, place = code[order], place[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(code), 1), bool), (code[1:] != code[:-1]) | (place[1:] != place[:-1])]))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (line[order] & 63).astype(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)
    code, place = code[starts], place[starts]
    runs = pieces.dictionary.filter(pa.array(~is_end))
    places = pa.StructArray.from_arrays([pa.array((place >> 32).astype(np.int32)), pa.array((place & 0xFFFFFFFF).astype(np.int32)), pa.array(bits.view(np.int64))], fields=list(PLACE))
    found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(runs)))]).astype(np.int32)), places)
    run = pa.StructArray.from_arrays([runs, found], fields=list(RUN))
    return pa.RecordBatch.from_arrays([
        pa.array([repo], repo_type), pa.array([block], pa.int64()), pa.array([files], pa.list_(pa.string())),
        pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), run)], ["repo", "block", "files", "runs"])


def _pieces(pattern: str, line_break: str) -> Callable[[str], list[str]]:
    """The runs of a text in order, and a line end after each line.

    Runs of one class of characters are found together with the line ends, in one pass; a text
    with a line end that the class holds, and any other pattern, is split into lines first.
    """
    compiled = re.compile(pattern)
    split = re.compile(line_break).split
    found = compiled.findall if not compiled.groups else lambda line: [m[0] for m in compiled.finditer(line)]
    at_once = re.compile(f"{line_break}|{pattern}").findall if re.fullmatch(r"\[[^\[\]]+\]\+", pattern) else None
    inside = [c for c in BREAKS[1:] if compiled.search(c)]

    def by_line(text: str) -> list[str]:
        out = []
        for line in split(text):
            out += found(line)
            out.append("\n")
        return out

    return lambda text: by_line(text) if at_once is None or any(c in text for c in inside) else at_once(text)


def packer(pattern: str, line_break: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per block from (repo, block, slot, file, content) in the order of block and slot: its files, and where each run stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = _pieces(pattern, line_break)
        at, files, kind = None, [], pa.string()
        words, coded, slots, sizes = [], [], [], []

        def encode() -> None:
            coded.append(pa.array(words, pa.string()).dictionary_encode())
            words.clear()

        def packed() -> pa.RecordBatch:
            encode()
            return _packed(*at, files, pa.chunked_array(coded), np.array(slots, np.int64), np.array(sizes, np.int64), kind)

        for batch in batches:
            kind = batch.schema.field("repo").type
            for repo, block, slot, file, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "block", "slot", "file", "content")), strict=True):
                if (repo, block) != at:
                    if at is not None:
                        yield packed()
                    at, files = (repo, block), []
                    coded.clear(), slots.clear(), sizes.clear()
                if slot == len(files):
                    files.append(file)
                own = pieces_of(content) if content else []
                words += own
                slots.append(slot)
                sizes.append(len(own))
                if len(words) > PIECES_AT_ONCE:
                    encode()
        if at is not None:
            yield packed()

    return run


class _Needles:
    """The needles and queries of one repository."""

    def __init__(self, rows: list[tuple]):
        needles = {n: i for i, n in enumerate(dict.fromkeys(r[1] for r in rows))}
        self.heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.longer: dict[int, list[tuple[int, bytes]]] = {}
        heads: dict[int, list[tuple[int, int]]] = {}
        for needle, i in needles.items():
            data = needle.encode()
            code = int.from_bytes(data[:HEAD], "little")
            if len(data) >= HEAD:
                self.longer.setdefault(code, []).append((i, data))
            else:
                heads.setdefault(len(data), []).append((code, i))
        if self.longer:
            heads[HEAD] = [(code, 0) for code in self.longer]
        for length, codes in heads.items():
            codes.sort()
            self.heads[length] = np.array([c for c, _ in codes], np.uint64), np.array([i for _, i in codes], np.int64)
        self.terms: dict[object, list[tuple[int, int]]] = {}
        self.slabs, open_slab = [], {}
        weights: dict[object, dict[int, float]] = {}
        for query, needle, weight, term_no in rows:
            self.terms.setdefault(query, []).append((needles[needle], term_no))
            of = weights.setdefault(query, {})
            of[needles[needle]] = of.get(needles[needle], 0.0) + weight
        filled = 0
        for query, of in weights.items():
            if open_slab and (len(open_slab) == SLAB_QUERIES or filled + len(of) > SLAB_TERMS):
                self.slabs.append(self._slab(open_slab))
                open_slab, filled = {}, 0
            open_slab[query] = of
            filled += len(of)
        self.slabs.append(self._slab(open_slab))


    @staticmethod
    def _slab(queries: dict) -> tuple[list, np.ndarray, np.ndarray]:
        used = np.unique(np.fromiter((i for of in queries.values() for i in of), np.int64))
        weights = np.zeros((len(used), len(queries)))
        for column, of in enumerate(queries.values()):
            weights[np.searchsorted(used, np.fromiter(of, np.int64, len(of))), column] = list(of.values())
        return list(queries), used, weights

    def inside(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a needle and a run that it stands in, by needle.

        The eight bytes at each place of the runs are one number, which is looked up among the heads of the needles of each length.
        """
        runs = runs.cast(pa.string())
        ends = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset:runs.offset + len(runs) + 1].astype(np.int64)
        text = np.frombuffer(runs.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends -= ends[0]
        size = len(text)
        run = np.repeat(np.arange(len(runs)), np.diff(ends))
        left = ends[run + 1] - np.arange(size)  # bytes to the end of the run
        padded = np.concatenate([text, np.zeros(HEAD, np.uint8)])
        head = np.zeros(size, np.uint64)
        found_needles, found_runs = [], []
        for length in range(1, HEAD + 1):
            head |= padded[length - 1:length - 1 + size].astype(np.uint64) << np.uint64(8 * (length - 1))
            codes = self.heads.get(length)
            if codes is None:
                continue
            values, needles = codes
            where = np.searchsorted(values, head)
            hits = np.flatnonzero((values[np.minimum(where, len(values) - 1)] == head) & (left >= length))
            if length < HEAD:
                found_needles.append(needles[where[hits]])
                found_runs.append(run[hits])
                continue
            whole = text.tobytes()
            pairs = [(no, run[i]) for i in hits for no, needle in self.longer[int(head[i])] if len(needle) <= left[i] and whole.startswith(needle, i)]
            found_needles.append(np.array([x[0] for x in pairs], np.int64))
            found_runs.append(np.array([x[1] for x in pairs], np.int64))
        pairs = np.unique(np.concatenate(found_needles) * max(len(runs), 1) + np.concatenate(found_runs)) if found_needles else np.zeros(0, np.int64)
        return pairs // max(len(runs), 1), pairs % max(len(runs), 1)


def _united(needles: _Needles, runs: pa.StructArray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, n, first, last) by ``key`` = needle * slots + slot: how many lines of a file hold a needle, the first and the last of them."""
    none = (np.zeros(0, np.int64),) * 4
    needle, run = needles.inside(runs.field("run"))
    if not len(needle):
        return none
    found = runs.field("found")
    offsets, place = found.offsets.to_numpy().astype(np.int64), found.values
    slot, grp = (place.field(c).to_numpy().astype(np.int64) for c in ("slot", "grp"))
    bits = place.field("bits").to_numpy().view(np.uint64)
    groups = int(grp.max()) + 1
    sizes = offsets[run + 1] - offsets[run]
    ends = np.cumsum(sizes)
    parts, low = [], 0
    while low < len(needle):  # whole needles, as many as are united at once
        high = max(int(np.searchsorted(ends, ends[low] - sizes[low] + AT_ONCE, "right")), low + 1)
        high = len(needle) if high >= len(needle) else int(np.searchsorted(needle, needle[high - 1], "right"))
        size = sizes[low:high]
        entry = np.repeat(offsets[run[low:high]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = (np.repeat(needle[low:high], size) * slots + slot[entry]) * groups + grp[entry]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lines = np.bitwise_or.reduceat(bits[entry[order]], starts)
        key = key[starts]
        smeared = lines.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            smeared |= smeared >> np.uint64(shift)
        base = key % groups * 64
        first = base + np.bitwise_count((lines & (~lines + np.uint64(1))) - np.uint64(1)) + 1
        last = base + np.bitwise_count(smeared)
        key //= groups
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(np.bitwise_count(lines).astype(np.int64), starts)
        parts.append((key[starts], n, first[starts], last[np.concatenate([starts[1:], [len(key)]]) - 1]))
        low = high
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def searcher(terms: list[tuple], k: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` files of each query in the blocks of a task, by score, then file.

    ``terms`` are (query_id, repo, term, needle, weight, term_no), weights above 0.  Lines are counted by needle and file, and
    the counts of a block meet the weights of its repository's queries as matrices.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_repo: dict[object, list[tuple]] = {}
        spelled: dict[object, list[tuple[str, int]]] = {}
        for query, repo, term, needle, weight, term_no in terms:
            spelled.setdefault(query, []).append((term, term_no))
            if needle:
                by_repo.setdefault(repo, []).append((query, needle, weight, term_no))
        asked = {repo: _Needles(rows) for repo, rows in by_repo.items()}
        best: dict[object, list[tuple]] = {}
        least: dict[object, float] = {}

        def keep(query, rows: list[tuple]) -> None:
            kept = best[query] = sorted([*best.get(query, ()), *rows], key=lambda x: x[:4])[:k]
            if len(kept) == k:
                least[query] = -kept[-1][0]

        for batch in batches:
            runs_of = batch.column(batch.schema.get_field_index("runs"))
            for row, (repo, files) in enumerate(zip(batch.column("repo").to_pylist(), batch.column("files").to_pylist(), strict=True)):
                needles = asked.get(repo)
                if needles is None or not files:
                    continue
                low, high = runs_of.offsets[row].as_py(), runs_of.offsets[row + 1].as_py()
                slots = len(files)
                key, n, first, last = _united(needles, pa.concat_arrays([runs_of.values.slice(low, high - low)]), slots)
                if not len(key):
                    continue
                needle, slot = key // slots, key % slots
                for queries, used, weights in needles.slabs:
                    at = np.searchsorted(used, needle)
                    here = np.flatnonzero(used[np.minimum(at, len(used) - 1)] == needle)
                    counts = np.zeros((slots, len(used)))
                    counts[slot[here], at[here]] = n[here]
                    scores = counts @ weights
                    bar = np.fromiter((least.get(q, 0.0) for q in queries), float, len(queries))
                    better = (scores > 0) & (scores >= bar)
                    for column in np.flatnonzero(better.any(axis=0)):
                        near = np.flatnonzero(better[:, column])
                        near = near[np.lexsort((near, -scores[near, column]))][:k]
                        query, rows = queries[column], []
                        own = np.array([t[0] for t in needles.terms[query]], np.int64)
                        for s in near:
                            where = np.minimum(np.searchsorted(key, own * slots + s), len(key) - 1)
                            met = key[where] == own * slots + s
                            numbers = {no for (_, no), m in zip(needles.terms[query], met, strict=True) if m}
                            file = files[s]
                            rows.append((-float(scores[s, column]), file is not None, file or "", int(first[where[met]].min()), int(last[where[met]].max()), repo, numbers))
                        keep(query, rows)
        out = [(query, repo, file if named else None, -score, start, end, [t for t, no in sorted(spelled[query]) if no in numbers])
               for query, rows in best.items() for score, named, file, start, end, repo, numbers in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _needle_lines(needles: _Needles, runs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(needle, row) of every line that a needle stands in, by both, and the slot and number of each row: a row per line, in groups of 64."""
    needle, run = needles.inside(runs.field("run"))
    found = runs.field("found")
    offsets, place = found.offsets.to_numpy().astype(np.int64), found.values
    slot, grp = (place.field(c).to_numpy().astype(np.int64) for c in ("slot", "grp"))
    bits = place.field("bits").to_numpy().view(np.uint64)
    # groups of lines in which a run stands, numbered in the order of slot and line
    spots, spot = np.unique(slot << 32 | grp, return_inverse=True)
    sizes = offsets[run + 1] - offsets[run]
    ends = np.cumsum(sizes)
    parts, low = [], 0
    while low < len(needle):  # whole needles, as many as are united at once
        high = max(int(np.searchsorted(ends, ends[low] - sizes[low] + AT_ONCE // 8, "right")), low + 1)
        high = len(needle) if high >= len(needle) else int(np.searchsorted(needle, needle[high - 1], "right"))
        size = sizes[low:high]
        entry = np.repeat(offsets[run[low:high]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = np.repeat(needle[low:high], size) * len(spots) + spot[entry]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lines = np.bitwise_or.reduceat(bits[entry[order]], starts)
        key = key[starts]
        at, bit = np.nonzero(np.unpackbits(lines.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        parts.append((key[at] // len(spots), key[at] % len(spots) * 64 + bit))
        low = high
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2
    rows = np.arange(len(spots) * 64)
    return *joined, spots[rows >> 6] >> 32, (spots[rows >> 6] & 0xFFFFFFFF) * 64 + (rows & 63) + 1


def line_searcher(terms: list[tuple], k: int, sets: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` lines of each query in each block, by score, then file, then line, with the bits of their terms.

    ``terms`` are (query_id, repo, needle, weight, and ``sets`` numbers of bits), weights above 0.  The lines of a needle
    meet its queries as a matrix, as large as ``AT_ONCE`` allows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_repo: dict[object, list[tuple]] = {}
        for no, (query, repo, needle, weight, *_) in enumerate(terms):
            if needle:
                by_repo.setdefault(repo, []).append((query, needle, weight, no))
        asked = {repo: _Needles(rows) for repo, rows in by_repo.items()}
        for batch in batches:
            runs_of = batch.column("runs")
            for row, (repo, block, files) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("repo", "block", "files")), strict=True)):
                needles = asked.get(repo)
                if needles is None or not files:
                    continue
                low, high = runs_of.offsets[row].as_py(), runs_of.offsets[row + 1].as_py()
                needle, line, slot, number = _needle_lines(needles, pa.concat_arrays([runs_of.values.slice(low, high - low)]))
                out = []
                for queries, used, weights in needles.slabs:
                    step = max(1, AT_ONCE // max(len(slot), 1))
                    for first in range(0, len(queries), step):
                        part = weights[:, first:first + step]
                        scores = np.zeros((part.shape[1], len(slot)))
                        starts = np.searchsorted(needle, np.concatenate([used, used + 1]))
                        for i in np.flatnonzero((starts[:len(used)] < starts[len(used):]) & part.any(axis=1)):
                            lines = line[starts[i]:starts[len(used) + i]]
                            for column in np.flatnonzero(part[i]):
                                scores[column, lines] += part[i, column]
                        for column, query in enumerate(queries[first:first + step]):
                            near = np.flatnonzero(scores[column])
                            if len(near) > k:  # rows are in the order of file and line
                                bar = np.partition(scores[column, near], len(near) - k)[len(near) - k]
                                near = near[scores[column, near] >= bar]
                            near = near[np.argsort(-scores[column, near], kind="stable")][:k]
                            own = needles.terms[query]
                            key = np.array([t[0] for t in own], np.int64)
                            low_at, high_at = np.searchsorted(needle, key), np.searchsorted(needle, key + 1)
                            for r in near:
                                bits = [0] * sets
                                for (_, no), a, b in zip(own, low_at, high_at, strict=True):
                                    at = a + np.searchsorted(line[a:b], r)
                                    if at < b and line[at] == r:
                                        bits = [x | y for x, y in zip(bits, terms[no][4:], strict=True)]
                                out.append((query, repo, block, files[slot[r]], int(number[r]), float(scores[column, r]), *bits))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def to_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of an inverted index from chunks (repo, block, chunk_id, file, start_line, end_line, tokens) in the order of their block.

    A chunk's row is given back as its ``place``, with its ``slot`` in the block from 1; after a block's chunks comes a row per token:
    the slots that hold it, their lengths, and the shortest of them.
    """
    names, place = ["repo", "block", "token", "slots", "lens", "shortest", "place"], ["chunk_id", "file", "start_line", "end_line", "tokens"]
    lists = pa.list_(pa.int32())

    def listed(repo: object, block: int, kinds: list, tokens: list) -> pa.RecordBatch:
        words = pa.chunked_array(tokens).combine_chunks()
        coded = words.values.dictionary_encode()
        sizes = np.diff(words.offsets.to_numpy())
        # tokens in order, so that neighbours share their beginnings in the file
        by_name = pc.sort_indices(coded.dictionary)
        at = np.empty(len(by_name), np.int64)
        at[by_name.to_numpy()] = np.arange(len(by_name))
        code = at[coded.indices.to_numpy()]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        slot, lens = (np.repeat(x, sizes)[order].astype(np.int32) for x in (np.arange(1, len(sizes) + 1), sizes))
        offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
        n = len(starts)
        return pa.RecordBatch.from_arrays([
            pa.array([repo] * n, kinds[0]), pa.array(np.full(n, block, np.int64)), coded.dictionary.take(by_name),
            pa.ListArray.from_arrays(offsets, pa.array(slot)), pa.ListArray.from_arrays(offsets, pa.array(lens)), pa.array(np.minimum.reduceat(lens, starts)),
            pa.nulls(n, kinds[2])], names)

    at, tokens, kinds, filled = None, [], [], 0
    for batch in batches:
        shape = [pa.field("slot", pa.int32()), *[pa.field(c, batch.schema.field(c).type) for c in place]]
        kinds = [batch.schema.field("repo").type, pa.int64(), pa.struct(shape)]
        repos, blocks = batch.column("repo").to_pylist(), batch.column("block").to_pylist()
        low = 0
        for high in range(1, batch.num_rows + 1):
            if high < batch.num_rows and (repos[high], blocks[high]) == (repos[low], blocks[low]):
                continue
            if at != (repos[low], blocks[low]):
                if at is not None:
                    yield listed(*at, kinds, tokens)
                at, tokens, filled = (repos[low], blocks[low]), [], 0
            n = high - low
            part = batch.slice(low, n)
            # a copy, so that its offsets begin at 0
            tokens.append(pa.concat_arrays([part.column("tokens")]))
            yield pa.RecordBatch.from_arrays([
                part.column("repo"), part.column("block"), pa.nulls(n, pa.string()), pa.nulls(n, lists), pa.nulls(n, lists), pa.nulls(n, pa.int32()),
                pa.StructArray.from_arrays([pa.array(np.arange(filled + 1, filled + n + 1, dtype=np.int32)), *[part.column(c) for c in place]], fields=shape)], names)
            filled += n
            low = high
    if at is not None:
        yield listed(*at, kinds, tokens)
