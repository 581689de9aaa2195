"""Tokens, windows, fusion, merge and metrics on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import bm25, corpus, fusion, irmetrics, java, lexical
from evidentia.operators.ranking import ranged_row_number, split_row_number


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [
    ("XMLParser", ["xml", "parser"]), ("createOrderInTransaction", ["create", "order", "in", "transaction"]),
    ("OrderOrderService", ["order", "service"]), ("aBC", ["bc"]), ("@", []),
    ("spring-boot-starter", ["spring", "boot", "starter"]),
])
def test_identifier_tokens(spark, text, want):
    assert one(spark, text, tx.identifier_tokens) == want


def test_chunk_tokens_keep_the_whole_identifier(spark):
    assert one(spark, "OrderService the foo_bar A", tx.chunk_tokens) == ["order", "service", "orderservice", "foo", "bar", "foo_bar"]


def test_normal_terms_and_discards(spark):
    df = spark.createDataFrame([(["the", "OrderService", "@", "order"],)], "t array<string>")
    row = df.select(tx.normal_terms(F.col("t")).alias("n"), tx.discarded_terms(F.col("t")).alias("d")).first()
    assert row["n"] == ["order", "service"] and row["d"] == 2
    many = spark.createDataFrame([([f"t{i:02d}" for i in range(60)],)], "t array<string>")
    row = many.select(tx.normal_terms(F.col("t"), 50).alias("n"), tx.discarded_terms(F.col("t"), 50).alias("d")).first()
    assert len(row["n"]) == 50 and row["d"] == 10
    row = many.select(tx.normal_terms(F.col("t")).alias("n"), tx.discarded_terms(F.col("t")).alias("d")).first()
    assert len(row["n"]) == 60 and row["d"] == 0


def test_lines_drop_only_the_final_end(spark):
    assert one(spark, "a\r\nb\x0bc\n\n", tx.lines_of) == ["a", "b", "c", ""]


def windows_by_cursor(n, size=40, overlap=5):
    out, cursor = [], 0
    while cursor < n:
        end = min(cursor + size, n)
        out.append((cursor + 1, end))
        if end >= n:
            break
        cursor = end - overlap
    return out


def test_windows_equal_the_cursor_loop(spark):
    rows = [("r", f"f{n:03d}.txt", "\n".join(["x"] * n)) for n in range(1, 160)]
    got = corpus.line_windows(spark.createDataFrame(rows, "repo string, file string, content string")).collect()
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append((r["start_line"], r["end_line"]))
    assert all(sorted(by_file[f"f{n:03d}.txt"]) == windows_by_cursor(n) for n in range(1, 160))


def test_bm25_hand_values(spark):
    chunks = spark.createDataFrame(
        [("r", "c1", "a", 1, 2, ["x", "y"]), ("r", "c2", "b", 1, 2, ["y"]), ("r", "c3", "c", 1, 2, ["z"]), ("r", "c4", "d", 1, 2, [])],
        "repo string, chunk_id string, file string, start_line long, end_line long, tokens array<string>")
    queries = spark.createDataFrame([(1, "r", ["x", "q"])], "query_id long, repo string, terms array<string>")
    import math

    idf = math.log(3 - 1 + 0.5) - math.log(1 + 0.5)
    want = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (4 / 3)))
    rows = bm25.bm25_search(chunks, queries).collect()
    assert [(r["chunk_id"], round(r["score"], 6), r["matched_terms"]) for r in rows] == [("c1", round(want, 6), ["x"])]


HITS = "query_id long, repo string, chunk_id string, file string, start_line long, end_line long, rank int, matched_terms array<string>"


def hits(spark, rows):
    return spark.createDataFrame([(1, "r", c, f, s, e, k, [c]) for c, f, s, e, k in rows], HITS)


def test_rrf_sources_and_weights(spark):
    a = hits(spark, [("A", "f", 1, 5, 1)])
    fused = fusion.rrf(fusion.union_channels({"baseline": a, "bm25": a})).collect()
    assert fused[0]["sources"] == ["baseline", "bm25"] and abs(fused[0]["score"] - 2 / 61) < 1e-9
    both = fusion.rrf(fusion.union_channels({"baseline": a, "symbol": hits(spark, [("S", "g", 1, 5, 1)])})).orderBy(F.desc("score")).collect()
    assert [r["chunk_id"] for r in both] == ["S", "A"]


def leader_loop(items):
    """Every hit in rank order takes in all later ones that overlap it."""
    out, used = [], set()
    for i, (s, e) in enumerate(items):
        if i in used:
            continue
        for j in range(i + 1, len(items)):
            if j in used:
                continue
            s2, e2 = items[j]
            inter = max(0, min(e, e2) - max(s, s2) + 1)
            if inter / min(e - s + 1, e2 - s2 + 1) < 0.5:
                continue
            used.add(j)
            if e2 - s2 > e - s:
                s, e = s2, e2
        out.append((s, e))
    return out


def test_merge_equals_the_leader_loop_on_random_hits(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for q in range(150):
        items = []
        for i in range(rng.randint(1, 9)):
            s = rng.randint(1, 30)
            items.append((s, s + rng.randint(0, 15)))
            rows.append((q, "r", f"c{i}", "f", items[-1][0], items[-1][1], 1.0 - i / 100, ["bm25"], {"bm25": i}, [f"t{i}"]))
        want[q] = sorted(leader_loop(items))
    df = spark.createDataFrame(rows, "query_id long, repo string, chunk_id string, file string, start_line long, end_line long, "
                               "score double, sources array<string>, source_ranks map<string,int>, matched_terms array<string>")
    got = {}
    for r in fusion.merge_overlaps(df).collect():
        got.setdefault(r["query_id"], []).append((r["start_line"], r["end_line"]))
    assert {q: sorted(v) for q, v in got.items()} == want


def test_ir_metrics_hand_values(spark):
    asked = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "query_id long, channel string")
    found = spark.createDataFrame([(1, "c", i + 1, f) for i, f in enumerate("ACBDE")], "query_id long, channel string, rank int, file string")
    expected = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "query_id long, file string")
    rows = {r["query_id"]: r for r in irmetrics.ir_metrics(asked, found, expected).collect()}
    assert (rows[1]["recall_1"], rows[1]["recall_3"], rows[1]["mrr_10"]) == (0.5, 1.0, 1.0)
    assert (rows[2]["recall_5"], rows[2]["first_relevant"]) == (0.0, -1)
    assert (rows[3]["recall_1"], rows[3]["mrr_10"]) == (1.0, 1.0)


def test_lexical_matches_any_substring(spark):
    files = spark.createDataFrame([("r", "a.java", "OrderService order\nx @Autowired y\nzz")], "repo string, file string, content string")
    queries = spark.createDataFrame([(1, "r", "OrderService @Autowired rder. z")], "query_id long, repo string, text string")
    rows = lexical.search_lines(files, queries).collect()
    assert [(r["line_no"], r["score"], r["terms"]) for r in rows] == [(2, 2.5, ["@Autowired"]), (1, 2.0, ["OrderService"])]


JAVA = '''package a;

@Service
public class Foo {
    String s = "{ \\" }";
    char c = '}';
    /* } */ // }
    public Foo(int x)
    {
        if (x > 0) { go(); }
    }

    @Bean
    // note
    String name
        (int y) { return "}"; }
}
enum Kind { A }
'''


def test_declarations_ignore_braces_in_literals_and_comments(spark):
    df = spark.createDataFrame([("r", "Foo.java", JAVA)], "repo string, file string, content string")
    got = {(r["kind"], r["name"], r["start_line"], r["end_line"]) for r in java.declarations(df).collect()}
    assert ("class", "Foo", 2, 17) in got and ("constructor", "Foo", 8, 11) in got
    assert ("method", "name", 12, 16) in got
    assert not any(k == "enum" for k, *_ in got)  # a one-line type is no chunk


def test_split_row_number_equals_plain_numbering(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 1000, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = split_row_number(df, ["k"], F.floor(F.col("t") / 100), [F.asc("t"), F.asc("i")], "n").collect()
    want, count = {}, {}
    for k, t, i in sorted(rows):
        count[k] = count.get(k, 0) + 1
        want[i] = count[k]
    assert {r["i"]: r["n"] for r in got} == want


def test_search_plan_has_no_python(spark, sf):
    from evidentia import plans

    for name in ("pl_bm25_search", "pl_lexical_search", "pl_hybrid_search", "pl_declarations"):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ranged_row_number_splits_one_hot_key(spark):
    rows = [("r", f"src/main/f{i * 7 % 1000:04d}") for i in range(1000)] + [("s", "a"), (None, "b")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = ranged_row_number(df, ["k"], [F.asc("t")], "n")
    assert sorted((r.n, r.t) for r in got.where("k = 'r'").collect()) == list(enumerate(sorted(t for k, t in rows if k == "r"), 1))
