"""Lines scored in their block against joins, and the rows that the BM25 index is made of."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import blocks, bm25, java, lexical


@pytest.mark.parametrize("small", [False, True])
def test_lines_scored_in_their_block_equal_joins(spark, monkeypatch, small):
    rng = random.Random(11)
    words = ["a", "alpha", "Alphabetical", "foo.bar()", "@Note", "n1", "\u00f1and\u00fa", "x\x1cy", "the", "OrderService"]
    text = lambda n: rng.choice(("\n", "\r\n")).join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(n))
    files = [("r" if i % 3 else "s", f"f{i:02d}", text(rng.choice((0, 1, 64, 65, 200)))) for i in range(24)] + [("r", "f01", "alpha\na"), ("r", None, "the a"), ("s", "none", None)]
    asked = [(1, "r", "alpha a OrderService @Note foo.bar()"), (2, "s", "the @Note Note lpha"), (2, "s", "the @Note Note lpha"), (3, "r", " ".join(f"t{i}" for i in range(70)) + " zz the"),
             (4, "t", "alpha"), (None, "r", "alpha"), (5, "r", "zzz")]
    df = spark.createDataFrame(files, "repo string, file string, content string")
    queries = spark.createDataFrame(asked, "query_id long, repo string, text string")
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 3000)
    if small:
        for name, value in (("AT_ONCE", 40), ("SLAB_TERMS", 3), ("SLAB_QUERIES", 1), ("PIECES_AT_ONCE", 7)):
            monkeypatch.setattr(blocks, name, value)
    index = lexical.build_lines(df)
    for k in (3, 1000):
        got = lexical.search_lines(df, queries, k, index=index)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "hashpartitioning(block" not in plan
        with monkeypatch.context() as m:
            m.setattr(lexical, "rows_if_small", lambda df: None)
            want = lexical.search_lines(df, queries, k, index=index).where("query_id IS NOT NULL")
        columns = ["query_id", "rank", "repo", "file", "line_no", "score", "terms"]
        order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
        assert got.count() > 0 and order(got.select(columns).collect()) == order(want.select(columns).collect())


def test_chunks_move_once_into_the_index(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 3)
    rows = [("r" if i % 3 else "s", f"c{i % 15}", f"f{i % 4}", i, i + 9, [f"t{i % 5}", f"u{i}", "all"][: i % 4]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "repo string, chunk_id string, file string, start_line long, end_line long, tokens array<string>")
    moved = []
    monkeypatch.setattr(bm25, "materialize", lambda df, name, real=bm25.materialize: (
        moved.append(df._jdf.queryExecution().optimizedPlan().toString().count("Repartition")) if name == "postings" else None, real(df, name))[1])
    index = bm25.build_postings(chunks)
    assert moved == [1]
    places = {(r.repo, r.block, r.slot): r for r in index.places.collect()}
    assert sorted((r.repo, r.chunk_id, r.file, r.start_line, r.end_line, r.tokens) for r in places.values()) == sorted(r for r in rows if r[5])
    got = sorted((p.repo, t.token, p.chunk_id, p.start_line, n) for t in index.rows.collect() for s, n in zip(t.slots, t.lens, strict=True) for p in [places[t.repo, t.block, s]])
    assert got == sorted((r[0], t, r[1], r[3], len(r[5])) for r in rows for t in r[5])
    assert all(t.shortest == min(t.lens) for t in index.rows.collect())


def test_block_ends_visit_braces_only(spark):
    text = 'a "{" // {\n/* {\n} */ {\n \'}\' "x\n }\n}\n}'
    lines = text.split("\n")
    df = spark.createDataFrame([(lines,)], "ls array<string>")
    found = df.select(*[java.block_end(F.col("ls"), F.lit(i)).alias(f"e{i}") for i in (0, 3, 6)])
    assert list(found.first()) == [4, 6, 6]
    spans = spark.createDataFrame([(["x"] * 3,), (["{", "{", "}"],)], "ls array<string>").select(java.block_end(F.col("ls"), F.lit(0)))
    assert [r[0] for r in spans.collect()] == [2, 2]
    assert tx.LINE_BREAK.count("|") == 1
