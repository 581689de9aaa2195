"""Contamination audits on many texts: what is computed once, and the results that must not change by it."""

import re

from pyspark.sql import functions as F

from evidentia.operators import integrity as ig, phrases
from evidentia.plans import audit


def test_trees_are_hashed_once_for_all_counts(spark, sf):
    plan = audit._novelty(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_copied_identifiers_of_few_known_ones(spark):
    fresh = spark.createDataFrame([("a", "f2", "alpha_one beta_two"), ("a", "f1", "alpha_one alpha_one x"), ("a", "f3", None)], "repo string, file string, content string")
    known = spark.createDataFrame([("b", "g1", "alpha_one gamma_x"), ("b", "g2", "alpha_one")], "repo string, file string, content string")
    done = phrases.copied_identifiers(fresh, known, audit.IDENTIFIER, 6)
    assert [tuple(r) for r in done.collect()] == [("alpha_one", "a/f1", 2, "b/g1", 2)]
    assert "LeftSemi" in done._jdf.queryExecution().optimizedPlan().toString()


def test_plain_patterns_hit_like_patterns(spark):
    texts = [("the solution hint is", ), ("replace it with a token and", ), ("replace\nwith", ), (None, ), ("the key and", )]
    column = spark.createDataFrame(texts, "t string").select("t", ig.pattern_hits(F.col("t"), audit._AUDIT_PATTERNS).alias("h"))
    for r in column.collect():
        assert r["h"] == [p for p in audit._AUDIT_PATTERNS if r["t"] is not None and re.search(p, r["t"])]
