"""Stored indexes against brute force: BM25 blocks, inverted line runs, phrases, identifiers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import bm25, lexical, phrases, stored


def chunk_table(spark, seed=1, count=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(count):
        tokens = sorted({w for w in words if rng.random() < 1 / (1 + words.index(w) / 4)}) if i % 17 else []
        rows.append(("r" if i % 3 else "s", f"c{i:03d}", f"f{i % 40:02d}", i, i + 9, tokens))
    return spark.createDataFrame(rows, "repo string, chunk_id string, file string, start_line long, end_line long, tokens array<string>")


def brute_scores(chunks, queries):
    import math

    out = {}
    for repo in {c.repo for c in chunks}:
        own = [c for c in chunks if c.repo == repo and c.tokens]
        mean = sum(len(c.tokens) for c in own) / len(own)
        df = {}
        for c in own:
            for t in c.tokens:
                df[t] = df.get(t, 0) + 1
        raw = {t: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw)
        idf = {t: floor if v < 0 else v for t, v in raw.items()}
        for q, r, terms in queries:
            if r == repo:
                for c in own:
                    score = sum(idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(c.tokens) / mean)) for t in terms if t in c.tokens)
                    if score > 0:
                        out.setdefault(q, []).append((-round(score, 9), c.file, c.start_line, c.chunk_id, [t for t in terms if t in c.tokens]))
    return {q: sorted(rows) for q, rows in out.items()}


QUERIES = [(1, "r", ["w3", "w50", "w9"]), (2, "s", ["w0"]), (3, "r", ["none"]), (4, "s", ["w59", "w20", "w1", "w2"]), (5, "r", [f"w{i}" for i in range(60)])]


@pytest.mark.parametrize("block", [4, 1000])
def test_block_scores_equal_full_scoring(spark, monkeypatch, block):
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", block)
    chunks = chunk_table(spark)
    queries = spark.createDataFrame(QUERIES, "query_id long, repo string, terms array<string>")
    want = brute_scores(chunks.collect(), QUERIES)
    index = bm25.build_postings(chunks)
    for k in (1, 7, 1000):
        got = {}
        for r in bm25.bm25_search(chunks, queries, k, index=index).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((round(-r.score, 6), r.file, r.start_line, r.chunk_id, r.matched_terms))
        assert got == {q: [(round(s, 6), *rest) for s, *rest in rows[:k]] for q, rows in want.items()}
    assert bm25.all_scores(chunks, queries, index=index).count() == sum(map(len, want.values()))
    pairs = bm25.postings(index, bm25.query_terms(queries))
    assert pairs.count() == sum(len(row[4]) for rows in want.values() for row in rows)


def test_blocks_below_the_kth_score_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 5)
    rows = [("r", f"c{i:03d}", f"f{i:03d}", 1, 2, ["a"] + [f"x{i}_{j}" for j in range(3 if i % 50 == 0 else 60 + i % 37)]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "repo string, chunk_id string, file string, start_line long, end_line long, tokens array<string>")
    queries = spark.createDataFrame([(1, "r", ["a"])], "query_id long, repo string, terms array<string>")
    index, scored = bm25.build_postings(chunks), []
    full = bm25._Search.scores
    monkeypatch.setattr(bm25._Search, "scores", lambda self, chosen=None: (scored.append(full(self, chosen).count()), full(self, chosen))[1])
    last = []
    for k in (1, 8, 400):
        scored.clear()
        assert bm25.bm25_search(chunks, queries, k, index=index).count() == k
        last.append(scored[-1])
    assert last[0] < 60 and last[0] < last[1] < last[2] == 400


def test_searches_read_only_the_folders_of_their_keys(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(500)], "key string, n int")
    table = stored.Bucketed.write(rows, "key", 16, ["n"], ["key"], "keyed")
    keys = spark.createDataFrame([("k1",), ("k77",), ("other",)], "key string")
    found = table.of(keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and 0 < found.count() < 250
    assert sorted(r.n for r in found.join(keys, "key").collect()) == [1, 77]


def line_files():
    rng = random.Random(3)
    words = ["alpha", "beta9", "x", "Ab", "a" * 90, "foo_bar", "@Note", "é", "the"]
    return [("r" if i % 2 else "s", f"f{i}", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(n)))
            for i, n in enumerate((0, 1, 63, 64, 65, 130, 200, 7))]


def test_inverted_lines_equal_a_scan(spark):
    files = line_files()
    df = spark.createDataFrame(files, "repo string, file string, content string")
    asked = [(1, "r", ["alp", "x", "a" * 80, "ta9", "zzz"]), (2, "s", ["x", "9", "the"])]
    queries = spark.createDataFrame(asked, "query_id long, repo string, terms array<string>")
    want, lines = {}, set()
    for q, repo, terms in asked:
        for r, file, content in files:
            hits = [(no, t) for no, line in enumerate(content.split("\n"), 1) for t in terms if r == repo and t in line]
            lines |= {(r, file, no, t) for no, t in hits}
            if hits:
                want[(q, file)] = (len(hits), min(no for no, _ in hits), max(no for no, _ in hits), [t for t in terms if any(t == x for _, x in hits)])
    terms = lexical.normal_query_terms(queries)
    index = lexical.build_lines(df, lexical.NORMAL_RUN)
    for limit in (None, 1000):
        got = lexical.lexical_search(df, terms, 100, lexical.NORMAL_RUN, limit, index).collect()
        assert {(r.query_id, r.file): (r.score, r.start_line, r.end_line, sorted(r.matched_terms)) for r in got} == {k: (*v[:3], sorted(v[3])) for k, v in want.items()}
    assert {tuple(r) for r in lexical.needle_lines(index, terms).select("repo", "file", "line_no", "needle").collect()} == lines
    assert lexical.normal_query_terms(queries, 2, 64).count() == 4


def test_line_searches_move_index_rows_once(spark):
    df = spark.createDataFrame(line_files(), "repo string, file string, content string").withColumn("repo", F.lit("r"))
    index = lexical.build_lines(df, lexical.NORMAL_RUN)
    queries = spark.createDataFrame([(1, "r", ["alp", "x"]), (2, "r", ["the", "9"])], "query_id long, repo string, terms array<string>")
    totals = lexical.file_totals(index, lexical.normal_query_terms(queries))
    first = lexical.first_matching_lines(lexical.scored_lines(index, lexical.classified_terms(queries.select("query_id", "repo", F.array_join("terms", " ").alias("text")))), 2)
    for found in (totals, first):
        moved = re.findall(r"Exchange hashpartitioning\(([^)]*)", found._jdf.queryExecution().executedPlan().toString())
        by_block = [m for m in moved if m.startswith("block")]
        # index rows, the names of files, and the terms of each query; no row of a needle or a line
        assert len(by_block) == 2 and all("," not in m.rsplit(", ", 1)[0] for m in moved), moved
        assert found.count() > 0


def test_phrases_equal_a_search_of_every_text(spark):
    rng = random.Random(5)
    words = ["the", "of", "and", "a", "long1word", "Mid", "x9", "é", "end"]
    glue = [" ", " ", "  ", ", ", "-", "\n", "_"]
    texts = [("r", f"f{i}", "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    low = [t.lower() for *_, t in texts]
    terms = {"long1", "ong1wor", "e", "the of", "he of an", "of and a", "d a lo", "the the the of", "a, the", ", the", "the ", "--", "é", ", ", "zzz", "x9 x9 x9 x9 x9 x9", "_", "mid\nof", "THE OF"}
    for _ in range(120):  # pieces of the texts at random places
        t = rng.choice(low)
        if len(t) > 12:
            at = rng.randrange(len(t) - 10)
            terms.add(t[at:at + rng.randint(1, 40)])
    want = {(file, t.lower()) for (_, file, _), text in zip(texts, low, strict=True) for t in terms if t.lower() in text}
    df = spark.createDataFrame(texts + [("r", "none", None), ("r", "empty", "")], "repo string, file string, content string")
    got = phrases.holding(phrases.build(df), spark.createDataFrame([(t,) for t in terms] + [("",)], "term string"))
    rows = [(r.file, r.term) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_copied_identifiers_name_both_sources(spark):
    files = lambda rows: spark.createDataFrame(rows, "repo string, file string, content string")
    fresh = files([("n", "b.java", "OrderService x OrderService"), ("n", "a.java", "OrderService find"), ("n", "c", None)])
    known = files([("o", "z.java", "find OrderService String"), ("o", "y.java", "find")])
    allowed = spark.createDataFrame([("find",)], "identifier string")
    got = phrases.copied_identifiers(fresh, known, "[A-Za-z_]+", 2)
    assert {tuple(r) for r in got.collect()} == {("OrderService", "n/a.java", 2, "o/z.java", 1), ("find", "n/a.java", 1, "o/y.java", 2)}
    assert [r.identifier for r in phrases.copied_identifiers(fresh, known, "[A-Za-z_]+", 2, allowed).select(F.col("identifier")).collect()] == ["OrderService"]
