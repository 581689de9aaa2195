"""What searches move, and in which order: index rows that no query asks for stay, terms are spelled for winners only."""

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import bm25, java, lexical


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_equals_replacing_characters(spark):
    texts = ["a-b_c", "", None, "Ärger 12\n- x\t", "---", "plain", "é1ü2 \U0001f600z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for allowed in ("A-Za-z0-9 ", "A-Za-z0-9 \n"):
        both = rows.select(tx.only(F.col("text"), allowed).alias("a"), F.regexp_replace("text", f"[^{allowed}]", "").alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]
        assert both[2].a is None and both[4].a == ""


def test_blanked_literals_keep_their_lines(spark):
    source = 'a("x\U0001f600y"); /* one\n\n two */ b(\'c\'); // end\nint d;'
    got = spark.createDataFrame([(source,)], "s string").select(java.strip_code(F.col("s"))).first()[0]
    assert got == 'a(' + " " * 5 + "); " + " " * 6 + "\n\n" + " " * 7 + " b(" + " " * 3 + "); " + " " * 6 + "\nint d;"


def line_rows(spark):
    files = [("r", f"f{i:02d}", "\n".join(f"w{j % 5} alpha{i % 3}" for j in range(i % 7 + 1))) for i in range(30)] + [("s", "f01", "w1 alpha1")]
    queries = [(1, "r", "w1 alpha1 w1"), (2, "r", "alpha"), (3, "s", "w1 w2"), (4, "r", "none")]
    return files, queries, spark.createDataFrame(files, "repo string, file string, content string"), spark.createDataFrame(queries, "query_id long, repo string, text string")


def brute_lines(files, queries):
    for q, repo, text in queries:
        for r, file, content in files:
            for no, line in enumerate(content.split("\n"), 1):
                terms = sorted(t for t in set(text.split()) if t in line)
                if r == repo and terms:
                    yield q, r, file, no, float(len(terms)), terms


def test_best_and_first_lines_equal_brute_force(spark):
    files, queries, f, q = line_rows(spark)
    index = lexical.build_lines(f)
    every = list(brute_lines(files, queries))
    best = [x for n in (1, 2, 3, 4) for x in sorted((x for x in every if x[0] == n), key=lambda x: (-x[4], x[2], x[3]))[:4]]
    got = lexical.search_lines(f, q, 4, index=index).orderBy("query_id", "rank").select("query_id", "repo", "file", "line_no", "score", "terms")
    assert [tuple(r) for r in got.collect()] == best
    first = {x[:5] for x in every if sum(y[0] == x[0] and y[2] == x[2] and y[3] < x[3] for y in every) < 2}
    cut = lexical.scored_lines(index, lexical.classified_terms(q), 2).select("query_id", "repo", "file", "line_no", "score")
    assert {tuple(r) for r in cut.collect()} == first


def test_terms_are_spelled_for_the_winners_only(spark):
    _, _, f, q = line_rows(spark)
    plan = plan_of(lexical.search_lines(f, q, 4, index=lexical.build_lines(f)))
    assert plan.index("_terms") < plan.index("Window")  # above the cut, as a plan is written top down


def test_unasked_index_rows_are_not_moved(spark):
    rows = [("r", f"c{i}", f"f{i}", 1, 9, [f"w{i % 9}", f"rare{i}"]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "repo string, chunk_id string, file string, start_line long, end_line long, tokens array<string>")
    queries = spark.createDataFrame([(1, "r", ["w1", "rare3"])], "query_id long, repo string, terms array<string>")
    index = bm25.build_postings(chunks)
    search = bm25._Search(index, queries)
    assert {r.token for r in search.rows.collect()} == {"w1", "rare3"}
    plan = plan_of(search.scores())
    assert plan.index("RepartitionByExpression") < plan.index("LeftSemi")


def test_derived_texts_and_line_counts_are_computed_once(spark, sf):
    from evidentia.plans import builds, repair

    log = builds.win_first_event(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert log.count("regexp_extract_all(text") == 1
    refs = repair.jn_edit_evidence(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert refs.count("split(text") == 4 * refs.count("Relation [")  # a count names its split four times; one count for each reading of the table
