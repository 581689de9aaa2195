"""Nothing is cut unless a limit is given; native diffs equal the standard library's."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from evidentia import session
from evidentia.operators import bm25, corpus, edits, intervals, java, lexical, semantic

FILES = "repo string, file string, content string"


def test_last_word_of_a_long_line_is_found(spark):
    text = " ".join(f"word{i}" for i in range(2500)) + " needleword"
    files = spark.createDataFrame([("r", "a.yml", text), ("r", "b.yml", "other text"), ("r", "c.yml", "more text here")], FILES)
    chunks = corpus.chunk_corpus(files)
    row = chunks.where("file = 'a.yml'").first()
    assert row.content == text and not row.truncated and row.tokens[-1] == "needleword"
    queries = spark.createDataFrame([(1, "r", ["needleword"])], "query_id long, repo string, terms array<string>")
    assert [r.file for r in bm25.bm25_search(chunks, queries).collect()] == ["a.yml"]
    cut = corpus.chunk_corpus(files, max_chars=4000, max_tokens=200).where("file = 'a.yml'").first()
    assert len(cut.content) == 4000 and len(cut.tokens) == 200 and cut.truncated


@pytest.mark.parametrize("limit", [None, 3])
def test_query_of_many_terms(spark, limit):
    terms = [f"t{i:03d}" for i in range(200)]
    lines = ["\n".join(terms[i:i + 40]) for i in range(0, 200, 40)]
    files = spark.createDataFrame([("r", f"f{i}.yml", t) for i, t in enumerate(lines)], FILES)
    queries = spark.createDataFrame([(1, "r", terms), (2, "r", terms[190:])], "query_id long, repo string, terms array<string>")
    found = lexical.lexical_search(files, lexical.normal_query_terms(queries), run_pattern=lexical.NORMAL_RUN, lines_per_file=limit).collect()
    got = {(r.query_id, r.file): (r.score, r.matched_terms) for r in found}
    per_file = 40 if limit is None else limit
    assert got[(1, "f4.yml")] == (per_file, terms[160:160 + per_file])
    assert got[(2, "f4.yml")] == (10 if limit is None else limit, terms[190:190 + min(10, per_file)])
    chunks = corpus.chunk_corpus(files)
    hits = {(r.query_id, r.file): r.matched_terms for r in bm25.bm25_search(chunks, queries, 10).collect()}
    assert hits[(1, "f0.yml")] == terms[:40] and hits[(2, "f4.yml")] == terms[190:]


def test_long_code_keeps_every_line(spark):
    body = "\n".join(f"        int v{i} = {i};" + " " * 100 for i in range(150))
    files = spark.createDataFrame([("r", "A.java", "class A {\n    void run() {\n" + body + "\n    }\n}\n")], FILES)
    chunks = java.declaration_chunks(files).where("chunk_type = 'method'").orderBy("start_line").collect()
    assert chunks[-1].end_line == 153 and all(b.start_line <= a.end_line + 1 for a, b in zip(chunks, chunks[1:], strict=False))


def test_fourth_candidate_gets_a_verdict(spark):
    refs = spark.createDataFrame([(1, i, 0, "src/main/java/A.java", 2, 3) for i in range(5)],
                                 "case_id long, candidate_index long, evidence_index long, file string, start_line long, end_line long")
    snippets = spark.createDataFrame([(1, "src/main/java/A.java", 1, 1, 9)], "case_id long, file string, rank long, start_line long, end_line long")
    verdicts = intervals.check_evidence(refs, snippets)
    assert {r.candidate_index for r in verdicts.collect()} == set(range(5))
    assert intervals.check_evidence(refs, snippets, max_candidates=3).count() == 3
    files = spark.createDataFrame([(1, "src/main/java/A.java", "\n".join("x" * 9000 for _ in range(4)))], "case_id long, file string, content string")
    late = refs.where("candidate_index = 4")
    assert edits.validated_evidence(late, snippets, files).count() == 1
    assert edits.validated_evidence(late, snippets, files, max_candidates=3).count() == 0
    assert edits.validated_evidence(late, snippets, files, max_chars=8000).count() == 0


def test_long_parts_are_whole(spark):
    parts = spark.createDataFrame([(1, 0, "summary", "a " * 3000 + "last")], "case_id long, part_no int, kind string, text string")
    assert semantic.case_texts(parts, "v22").first().texts[0].endswith("last")
    assert not semantic.case_texts(parts, "v22", max_part_chars=2000).first().texts[0].endswith("last")


def test_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class getConf:  # noqa: N801
                get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Session)


def test_written_tables_can_be_dropped(spark):
    stored = session.materialize(spark.range(3).toDF("x"), "numbers")
    assert stored.count() == 3
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    session.drop_tables(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_broadcast_needs_few_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.repeat(F.lit("y"), 1000)).alias("a"))
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(session.broadcast_if_small(wide))
    assert "broadcast" not in plan(session.broadcast_if_small(wide, max_bytes=5000))
    assert "broadcast" not in plan(session.broadcast_if_small(wide, max_rows=5))


def random_edits(rng, n):
    out, at = [], 1
    while at <= n and len(out) < 5:
        start = at + rng.randint(0, 9)
        end = start + rng.randint(0, 3)
        if end > n:
            break
        out.append((start, end))
        at = end + 1
    return out


def test_diffs_equal_the_standard_library(spark):
    rng, rows, want = random.Random(11), [], {}
    for case in range(150):
        lines = [f"line {case} {i}" for i in range(rng.randint(1, 40))]
        new = list(lines)
        for no, (start, end) in enumerate(reversed(random_edits(rng, len(lines)))):
            old = lines[start - 1:end]
            put = [*old[:rng.randint(0, 1)], *(f"new {case} {no} {j}" for j in range(rng.randint(0, 3))), *old[max(1, len(old) - rng.randint(0, 1)):]]
            put = put or ["x"]
            new[start - 1:end] = put
            rows.append((case, "f.java", no, start, end, "\n".join(put), lines))
        diff = "\n".join(difflib.unified_diff(lines, new, "a/f.java", "b/f.java", lineterm=""))
        want[case] = diff + "\n" if diff else ""
    df = spark.createDataFrame(rows, "case_id long, file string, edit_index int, start_line int, end_line int, new_code string, lines array<string>")
    grouped = df.groupBy("case_id", "file").agg(F.first("lines").alias("lines"), F.collect_list(F.struct("start_line", "end_line", "new_code")).alias("e"))
    got = {r.case_id: r.d for r in grouped.select("case_id", edits.unified_diff(F.col("file"), F.col("lines"), F.col("e")).alias("d")).collect()}
    assert {c: got[c] for c in got if got[c] != want[c]} == {} and len(got) > 100


@pytest.mark.parametrize("content,applied", [
    ("a\r\nb\r\nc\r\n", "a\r\nX\r\nY\r\nc\r\n"), ("a\rb\rc", "a\rX\rY\rc"), ("﻿a\nb\nc\n", "﻿a\nX\nY\nc\n"), ("a\nb\nc", "a\nX\nY\nc"),
])
def test_application_keeps_line_ends_and_marks(spark, content, applied):
    path = "src/main/java/A.java"
    given = spark.createDataFrame([(1, path, 0, 2, 2, "b", "X\nY"), (2, path, 0, 2, 2, "wrong", "X")],
                                  "case_id long, file string, edit_index long, start_line long, end_line long, old_code string, new_code string")
    files = spark.createDataFrame([(1, path, content), (2, path, content)], "case_id long, file string, content string")
    done = {r.case_id: r for r in edits.apply_edits(given, files).collect()}
    assert done[1].content == applied and done[1].diff == f"--- a/{path}\n+++ b/{path}\n@@ -1,3 +1,4 @@\n a\n-b\n+X\n+Y\n c\n"
    assert (done[2].status, done[2].error, done[2].content, done[2].diff) == ("rejected", "preflight_failed", None, None)
    audit = edits.edit_audit(edits.apply_edits(given, files)).collect()
    assert len(audit) == 1 and len(audit[0].old_code_sha256) == 64
