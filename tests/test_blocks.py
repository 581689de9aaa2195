"""Blocks of the indexes as arrays: what they find, and that each index is read or made once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import blocks, java, lexical


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [False, True])
def test_files_scored_in_their_block_equal_joins(spark, monkeypatch, small):
    rng = random.Random(7)
    words = ["a", "alpha", "alphabetical", "alphabet99", "9", "ñandú", "ünïcödé-long", "x y", "the", "lphabetica"]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(n))
    files = [("r" if i % 3 else "s", f"f{i:02d}", text(rng.choice((0, 1, 64, 65, 140)))) for i in range(24)] + [("r", "f01", "alpha\na"), ("r", None, "the 9"), ("s", "none", None), (None, "f", "a")]
    terms = ["a", "alpha", "lphabetical", "alphabetic", "ú", "ïcödé-lon", "9", "he", "zzz", ""]
    asked = [(1, "r", terms), (2, "s", terms[::-1]), (2, "s", terms[::-1]), (3, "r", ["the", "a"]), (3, "s", ["the", "9"]), (4, "t", ["a"]), (None, "r", ["a"]), (5, "r", ["zzz"])]
    df = spark.createDataFrame(files, "repo string, file string, content string")
    queries = lexical.normal_query_terms(spark.createDataFrame(asked, "query_id long, repo string, terms array<string>"), 0)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 3000)
    if small:
        for name, value in (("AT_ONCE", 5), ("SLAB_TERMS", 3), ("SLAB_QUERIES", 1)):
            monkeypatch.setattr(blocks, name, value)
    index = lexical.build_lines(df)
    for k in (3, 100):
        got = lexical.lexical_search(df, queries, k, index=index)
        plan = plan_of(got)
        assert "MapInArrow" in plan and "block" not in "".join(re.findall(r"Exchange hashpartitioning\(([^)]*)", plan))
        with monkeypatch.context() as m:
            m.setattr(lexical, "rows_if_small", lambda df: None)
            want = lexical.lexical_search(df, queries, k, index=index)
        order = ["query_id", "rank"]
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert [tuple(r) for r in got.orderBy(order).collect()] == [tuple(r) for r in want.orderBy(order).collect()]


def test_line_ends_and_last_lines(spark):
    text = "a b\r\nc\x0bd e\n\nf\x85g\n"
    rows = spark.createDataFrame([("r", "f", text)], "repo string, file string, content string")
    lines = rows.select(tx.lines_of(F.col("content"))).first()[0]
    found = lexical.build_lines(rows).rows.collect()
    assert {r.run: [i + 1 for i in range(64) if r.found[0].bits >> i & 1] for r in found} == {
        w: [i + 1 for i, line in enumerate(lines) if w in line.split()] for w in "abcdefg"}


def test_code_is_searched_for_symbols_once(spark):
    code = "@Service\npublic class Alpha {\n\n  private int beta (int x) {\n  }\n  @Deprecated void\n gamma(\n) {}\n}\ninterface Delta\nenum\nEps {}\n@End"
    files = spark.createDataFrame([("r", "A.java", code), ("r", "B.java", ""), ("r", "C.java", None)], "repo string, file string, content string")
    want = {(kind, m[1], code[:m.start()].count("\n") + 1) for kind, p in java.SYMBOLS.items()
            for m in re.finditer(re.sub(r"^\(\?md\)", "(?m)", p), code)}
    assert {(r.kind, r.name, r.line) for r in java.symbol_table(files).collect()} == want
    symbols = spark.createDataFrame([(1, "r", 0, "Alpha"), (1, "r", 1, "beta")], "query_id long, repo string, symbol_no int, symbol string")
    found = java.symbol_search(files, symbols)
    assert java.SYMBOLS["interface"] not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.symbol, r.start_line, r.end_line) for r in found.orderBy("rank").collect()] == [("Alpha", 1 + 1, 9), ("beta", 3, 5)]


def test_proposed_code_is_stripped_once(spark):
    rows = spark.createDataFrame([("class A {}", "import a.B;\nclass A { B b; c.d.E e; C c; }\nclass C {}", [("class A {}", "class A { B b; c.d.E e; C c; D d; }")])],
                                 "o string, p string, c array<struct<old_code:string,new_code:string>>")
    checked = rows.select(java.import_check(F.col("o"), F.col("p"), F.col("c")).alias("x")).select("x.*")
    r = checked.first()
    assert (r.introduced, r.resolved, r.unresolved, r.status) == (["B", "C", "D", "E"], ["B", "C", "E"], ["D"], "fail")
    # its literals are cut out of the text once: a split and an extraction
    text = checked._jdf.queryExecution().analyzed().toString()
    assert text.count("regexp_extract_all(p#") == 1
