"""Text operators against brute-force versions on small fixtures."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import neardup, repeats
from evidentia.llm import words as W

DOCS = "doc_id long, text string"


def split(text):
    return (text or "").encode().split()


def brute_repeats(rows, window):
    count = Counter()
    for _, text in rows:
        w = split(text)
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for doc_id, text in rows:
        w = split(text)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                keep[i:i + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()
        out[(doc_id, len(w), keep.count(False), kept)] += 1
    return out


def copied_texts(seed, count=60):
    """Texts over few words with passages copied among them, some with a changed word."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice(["", "x", "é", "ß"])
    passages = [[word() for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(count):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            low = rng.randint(0, 20)
            p = p[low:rng.randint(low + 1, len(p))]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(parts))
            parts[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t ", "\u00a0x "]).join(parts)))
    return rows + [(900, None), (901, ""), (902, " \n "), (None, rows[3][1]), (3, rows[3][1]), (904, "z " * 300), (905, "q " * 34)]


@pytest.mark.parametrize("limits", [{}, {"SHARD_PLACES": 2}, {"SHARD_PLACES": 1, "HOT_ANCHORS": 10_000}, {"HOT_ANCHORS": 10**9}])
def test_repeats_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    for seed in (1, 2):
        rows = copied_texts(seed)
        done = repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), window=12)
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect())
        assert got == brute_repeats(rows, 12)


def test_repeats_keep_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", 7, "x"), (2, None, None, None)], "doc_id long, text string, n_words int, H string")
    done = repeats.remove_repeats(docs, window=3)
    assert done.columns == ["doc_id", "text", "n_words", "H", "n_words_", "n_removed", "kept_text"]
    assert {tuple(r) for r in done.collect()} == {(1, "a b c a b c", 7, "x", 6, 6, ""), (2, None, None, None, 0, 0, "")}
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_shard_of_many_words_has_no_surrogates():
    shard = repeats.Shard(3)
    for i in range(0, 60_000, 6):
        shard.add((i, 0, 0), " ".join(f"w{j}" for j in range(i, i + 6)))
    shard.add((-1, 0, 0), "w57002 w57003 w57004")
    assert all(not 0xD800 <= ord(c) < 0xE000 for c in shard.letters.values()) and len(set(shard.letters.values())) == len(shard.letters)
    assert set(shard.found()) == {(-1, 0, 0, 1), (57_000, 0, 2, 1)}


def test_window_anchors_are_first_least():
    g = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    got = repeats.window_anchors(g, 13)
    assert got.tolist() == [i + int(np.argmin(g[i:i + 13])) for i in range(len(g) - 12)]


def brute_near(rows, percent=85, size=5):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for doc_id, text in rows:
        w = split((text or "").translate(table))
        sets[doc_id] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_texts(seed, copies=45):
    """Chains of edits around the threshold, copies with other case or spaces, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, number = [], 0
    for group in range(3):
        base = [word() for _ in range(120)]
        for i in range(copies if group == 0 else 8):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
            if i % 3 == 2:
                base = text
            rows.append((number, (" " if i % 2 else "\n").join(t.upper() if i % 5 == 0 else t for t in text)))
            number += 1
    tail = ["", None, "  ", "a b", "A  b", "a b c", "a b c d e", "a b c d e f", "É b", "é b"]
    return rows + [(number + i, t) for i, t in enumerate(tail)]


@pytest.mark.parametrize("limits", [{}, {"SMALL": 1}, {"SMALL": 1, "BLOCK_CLASSES": 7, "BLOCK_SHINGLES": 900}])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rows = near_texts(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 2), (2, "a b c d e f", 3), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2, 2, False), (5, 2, 2, False), (None, 2, None, True), (2, 2, 2, True), (7, 0, 7, True)], key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 2, 7}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, percent=50)


def test_keep_one_keeps_different_texts_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, 1), (5, long + " end", 2), (5, "something else of five words here", 3), (5, "something else of five words here", 4), (7, "alone in the world it is", 5),
            (8, None, 6), (8, None, 7), (8, "", 8), (None, long, 9), (None, long, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Number int").repartition(3)
    for _ in range(2):
        kept = neardup.keep_one(docs, percent=80)
        assert kept.columns == docs.columns
        got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
        assert got == sorted([("1", long), ("5", rows[2][1]), ("7", rows[4][1]), ("8", ""), ("None", long), ("None", long)])


def test_odd_sketch_counts_differing_samples():
    rng = np.random.default_rng(3)
    mins = rng.integers(0, 2**63, (2, neardup.BANDS * neardup.ROWS), dtype=np.uint64)
    mins[1, 5:] = mins[0, 5:]
    sketch = neardup.odd_sketch(mins)
    flips = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    assert 4 <= flips <= 10 and flips % 2 == 0


def test_words_and_hashes():
    texts = ["a bb\tccc", None, "", " \u00a0é  x\u2003y ", "bb"]
    w = W.words(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    assert [raw[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == [x for t in texts for x in split(t)]
    assert np.diff(w.first).tolist() == [len(split(t)) for t in texts]
    h = w.hashes()
    assert h[1] == h[-1] and len(set(h.tolist())) == len(h) - 1
    long = "x" * 100_000
    assert W.words(pa.array([long + " y"])).hashes()[0] == W.words(pa.array(["y " + long])).hashes()[1]
    sliced = W.words(pa.array(texts).slice(3, 2))
    assert np.diff(sliced.first).tolist() == [2, 1]


def test_counts_agree_with_spark(spark):
    from evidentia.llm.tables import word_count

    rows = copied_texts(9)
    got = spark.createDataFrame(rows, DOCS).select("text", word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(split(r.text)) for r in got)


def test_pipeline_stage_drops_near_copies_from_080(spark):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(20):  # 200 words, 196 shingles; a tail of k other words leaves 196 - k of 196 + k
        base = [word() for _ in range(200)]
        tail = 19 if i % 2 else 25  # similarity 0.823 or 0.774
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-tail] + [word() for _ in range(tail)]))]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    want = {i for i, (_, root) in brute_near(rows, percent=80).items() if i == root}
    assert got == want and got != {i for i, (_, root) in brute_near(rows).items() if i == root}
    assert len(got) == 30


def test_repeats_are_confirmed_on_words_where_hashes_collide(spark, monkeypatch):
    held = repeats.written

    def collide(df, name):
        return held(df.withColumns({c: F.lit(7).cast("long") for c in ("h", "content") if c in df.columns}) if name == "anchors" else df, name)

    monkeypatch.setattr(repeats, "written", collide)
    rows = [(i, " ".join(f"{c}{j}" for j in range(12))) for i, c in enumerate("abcde")] + [(9, "x a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11")]
    done = repeats.remove_repeats(spark.createDataFrame(rows, DOCS), window=12)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in done.collect()) == brute_repeats(rows, 12)
