"""Set similarity join against brute force, with limits that send small inputs through every path."""

import random

import numpy as np
import pytest

from evidentia.llm import setjoin

DOCS = "doc_id long, text string"


def shingle_set(text, size):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def brute_components(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, set()).add(shingle_set(text, size))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return sorted((repr(d), len(shingle_set(t, size)), repr(None if d is None else root(d))) for d, t in rows)


def like_texts(seed, families=5, count=24, words=90):
    """Families of texts: chains of edits, stars around one text, cuts, and a line common to many others."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmnop") + rng.choice(["", "x", "É"])
    rows, line = [], [word() for _ in range(12)]
    for family in range(families):
        base = [word() for _ in range(rng.randint(5, words))]
        last = base
        for i in range(count):
            now = list(last if family % 2 else base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                now[rng.randrange(len(now))] = word()
            if rng.random() < 0.2:
                now = now[:rng.randint(len(now) * 9 // 10, len(now))] or now
            last = now
            rows.append((len(rows) * 7 % 1009, " ".join(w.upper() if rng.random() < 0.1 else w for w in now)))
    for _ in range(20):
        rows.append((len(rows) * 7 % 1009, " ".join(line + [word() for _ in range(rng.randint(0, 4))])))
    return rows + [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "one two"), (2005, " \n\t"), (2006, "z " * 500), (2007, "z z z"), (None, rows[0][1])]


@pytest.mark.parametrize("limits", [{}, {"SMALL": 1, "BLOCK": 4, "DENSE": 0}, {"SMALL": 3, "BLOCK": 2}, {"SMALL": 10**6}, {"SMALL": 1, "BLOCK": 9, "DENSE": 1}])
@pytest.mark.parametrize("size, percent", [(3, 90), (2, 60)])
def test_components_equal_brute_force(spark, monkeypatch, limits, size, percent):
    for name, value in limits.items():
        monkeypatch.setattr(setjoin, name, value)
    rows = like_texts(size)
    got = setjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4), size=size, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got.collect()) == brute_components(rows, size, percent)


def test_repeated_rows_several_texts_of_one_id_and_other_columns(spark):
    rows = like_texts(9, families=2, count=10)
    rows += rows[:4] * 3 + [(rows[1][0], rows[-12][1])]  # rows repeated, and one id with two texts
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "DOC long, body string, cid int, n_shingles string")
    got = setjoin.jaccard_components(df, "DOC", "body").collect()
    want = brute_components(rows, 3, 90)
    assert sorted((repr(r.DOC), r.n_shingles, repr(r.component_id)) for r in got) == want
    assert setjoin.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_derived_overlaps_equal_counted_ones():
    rng = np.random.default_rng(5)
    for like in (0.02, 0.5, 1.0):
        base = rng.choice(20_000, 3000, replace=False)
        sets = []
        for _ in range(9):
            keep = base[rng.random(len(base)) > like]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 20_000, rng.integers(0, 200))])).astype(np.uint64))
        sets.append(np.zeros(0, np.uint64))
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        answers = setjoin.Answers(sets)
        got = [answers.of(x, None if i == 0 else int(rng.integers(0, i))).tolist() for i, x in enumerate(sets)]
        assert got == want
