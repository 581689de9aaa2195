"""Fill-in-the-middle and the Merkle manifest against brute-force versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import fim, merkle
from evidentia.llm import words as W

MARKS = ("<P>", "<M>", "<S>")


def brute_middle(key, text, rate, spm):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts(seed, count):
    rng = random.Random(seed)
    pieces = ["a", "é", "😀", "́", "<", "P", ">", "S>", "<M", " ", "\n", "<P", "\x00", "ß", " "]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(count)] + ["", None, "x", "<P>", "é" * 50_000]


@pytest.mark.parametrize("rate, spm", [(90, 20), (100, 100), (0, 50)])
def test_middles_equal_brute_force_and_come_back(spark, monkeypatch, rate, spm):
    monkeypatch.setattr(W, "PIECE_BYTES", 300)
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(odd_texts(1, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, OUTPUT int").repartition(3)
    done = fim.transform(df, rate=rate, spm=spm, restored_col="text")
    assert done.columns == ["doc_id", "text", "OUTPUT", "n_chars", "form", "prefix_chars", "middle_chars", "output_", "text_"]
    again = fim.restore(done, "output_")
    assert again.columns == [*done.columns, "restored"]
    got = again.collect()
    assert len(got) == len(rows)
    for r in got:
        key, text, _ = rows[r.OUTPUT]
        assert (r.n_chars, r.form, r.prefix_chars, r.middle_chars, r.output_) == brute_middle(key, text, rate, spm)
        assert r.text_ == r.restored == (text or "")


def test_outputs_whose_marks_do_not_fit_their_form_are_not_restored(spark):
    rows = [("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), ("x<P>a<S>b<M>", "psm"), ("<P><S><M>", "psm"), ("", "spm"), (None, "plain"), ("<P>a<S>b<M>c<M>", "psm"),
            ("<P>a", None), ("<P>a", "other"), ("<S>c<P>a<M>b", "spm")]
    df = spark.createDataFrame(rows, "output string, form string").coalesce(1)
    assert [r.restored for r in fim.restore(df).collect()] == [None, None, None, "", None, "", None, "<P>a", "<P>a", "abc"]
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scatter_of_sliced_columns():
    texts = pa.array(["skip", "abcé", None, "de"], pa.string()).slice(1)
    made, about = fim.scatter(texts, np.array([[1, 3, 0, 99], [5, 5, 0, 0], [0, 2, 0, 0]]), 90, 20)
    assert made.to_pylist() == ["<P>a<S>é<M>bc", "", "<S><P><M>de"] and about["chars"].tolist() == [4, 0, 2]
    assert fim.gather(made, about["form"]).to_pylist() == ["abcé", "", "de"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def brute_path(levels, at, fanout):
    path = []
    for nodes in levels[:-1]:
        run = at // fanout
        path.append(("".join(nodes[run * fanout:at]), "".join(nodes[at + 1:(run + 1) * fanout])))
        at = run
    return path


def brute_manifest(rows, fanout):
    groups = {}
    for r in rows:
        leaf = digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf))
    trees = {g: brute_tree([leaf for *_, leaf in sorted(found)], fanout) for g, found in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = brute_tree([trees[g][-1][0] for g in order], fanout) if order else []
    return sorted((repr(key if known else None), repr(g), leaf, trees[g][-1][0], top[-1][0], tuple(brute_path(trees[g], i, fanout) + brute_path(top, at, fanout)))
                  for at, g in enumerate(order) for i, (known, key, leaf) in enumerate(sorted(groups[g])))


@pytest.mark.parametrize("fanout, count, sources", [(2, 130, 9), (16, 400, 20), (3, 1, 1), (4, 0, 1), (5, 30, 0)])
def test_manifest_equals_brute_force(spark, fanout, count, sources):
    rng = random.Random(fanout)
    rows = []
    for i in range(count):
        source = "hot" if not sources or rng.random() < 0.4 else rng.choice([None, "", *(f"s{j}é" for j in range(sources))])
        rows.append((None if rng.random() < 0.05 else i, source, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", f"Ab é{rng.random()}"])))
    rows += rows[:3]  # repeated rows are leaves of their own
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    fields = [F.col(c) for c in df.columns]
    tampered = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_digest(*fields[:-1], F.upper("text")))
    done = merkle.manifest(df, fields, fanout=fanout, extra={"LEAF": tampered})
    assert done.columns == ["doc_id", "source", "leaf", "subroot", "root", "path", "LEAF_"]
    folded = merkle.fold(F.coalesce("LEAF_", "leaf"), F.col("path"))
    got = done.withColumn("folded", folded).withColumn("beside", merkle.siblings(F.col("path"))).collect()
    assert sorted((repr(r.doc_id), repr(r.source), r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.path)) for r in got) == brute_manifest(rows, fanout)
    for r in got:
        assert r.beside == "".join(p.before + p.after for p in r.path)
        assert (r.folded == r.root) == (r.LEAF_ is None or r.LEAF_ == r.leaf)
