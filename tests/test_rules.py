"""Intervals, edits, logs, semantic rules, streams and sinks on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import edits as ed
from evidentia.operators import integrity, intervals, logs, semantic
from evidentia.operators import traces as tr
from evidentia.sources import files as fs
from evidentia.sources import records
from evidentia.streaming import jobs

RANGES = "case_id long, file string, start_line long, end_line long"


def test_interval_flags_equal_brute_force(spark):
    rng = random.Random(3)

    def some(n):
        out = []
        for _ in range(n):
            s = rng.randint(1, 40)
            out.append((rng.randint(1, 3), rng.choice("ab"), s, s + rng.randint(-2, 12)))
        return out

    probes, ranges = some(300), [r for r in some(60) if r[3] >= r[2]]
    p, r = spark.createDataFrame(probes, RANGES), spark.createDataFrame(ranges, RANGES)
    keys = ["case_id", "file"]
    got = intervals.with_enclosed(intervals.with_overlap(intervals.with_containment(p, r, keys), r, keys), r, keys).collect()
    assert len(got) == len(probes)
    for x in got:
        same = [q for q in ranges if q[0] == x["case_id"] and q[1] == x["file"]]
        s, e = x["start_line"], x["end_line"]
        assert x["contained"] == any(s >= q[2] and e <= q[3] for q in same)
        if e >= s:
            assert x["overlaps"] == any(s <= q[3] and q[2] <= e for q in same)
        assert x["encloses"] == any(q[2] >= s and q[3] <= e for q in same)


def test_apply_keeps_newlines_bom_and_order(spark):
    files = spark.createDataFrame(
        [(1, "src/main/java/A.java", "﻿a\r\nb\r\nc\r\n"), (2, "src/main/java/B.java", "x\ny")], "case_id long, file string, content string")
    edits = spark.createDataFrame(
        [(1, 0, "src/main/java/A.java", 1, 1, "a", "a1\na2"), (1, 1, "src\\main\\java\\A.java", 3, 3, "c\n", "C"),
         (2, 0, "src/main/java/B.java", 1, 1, "stale", "z")],
        "case_id long, edit_index long, file string, start_line long, end_line long, old_code string, new_code string")
    rows = {r["case_id"]: r for r in ed.apply_edits(edits, files).collect()}
    assert rows[1]["status"] == "applied" and rows[1]["content"] == "﻿a1\r\na2\r\nb\r\nC\r\n"
    assert rows[2]["status"] == "rejected" and rows[2]["edits"][0]["failure"] == "stale_patch"


@pytest.mark.parametrize("log,want", [
    ("[ERROR] Could not resolve dependencies", ("dependency_resolution_failure", "dependency_resolution")),
    ("[ERROR] /w/src/main/java/A.java:[1,2] cannot find symbol", ("main_compile_failure", "compile")),
    ("[ERROR] src/test/java/A.java:[1,2] cannot find symbol", ("test_compile_failure", "test_compile")),
    ("[ERROR] src/main/java/A.java:[1,2] 找不到符号", ("main_compile_failure", "compile")),
    ("maven-surefire-plugin crashed", ("surefire_start_failure", "surefire")),
    ("[ERROR] Failed to execute goal x", ("plugin_failure", "plugin")),
    ("BUILD FAILURE", ("unknown", "unknown")),
])
def test_log_classes(spark, log, want):
    run = spark.createDataFrame(
        [(1, log, "", True, False, 1, False, False, 0, 0, 0, 0, "")],
        "run_id long, stdout string, stderr string, executed boolean, timed_out boolean, exit_code int, surefire_report_found boolean, "
        "target_test_found boolean, tests int, failures int, errors int, skipped int, failure_text string")
    r = logs.classify_runs(run).first()
    assert (r["failure_category"], r["lifecycle_phase"]) == want


def test_semantic_normal_forms(spark):
    df = spark.createDataFrame([("WebhookNotificationSender requires webhook", "application-dev.yml doesn't match staging", "StorageProperties")], "a string, b string, c string")
    r = df.select(*[tx.semantic_v22(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(r) == ("webhook notification sender require webhook", "application dev yml do not match staging", "storage property")


def test_bounded_value_context_and_negation(spark):
    from evidentia.sources.records import SPEC_SCHEMA

    spec = {"schema_version": "v", "case_id": "c", "required_concepts": [
        {"name": "limit", "aliases": [], "bounded_patterns": [{"anchor_aliases": ["pool size"], "value_aliases": ["5"], "max_token_distance": 4}]}],
        "required_relations": [{"name": "uses", "variants": [{
            "left_aliases": ["client"], "relation_aliases": ["uses"], "right_aliases": ["pool"], "required_value_aliases": ["7"],
            "context_aliases": ["database"], "max_token_distance": 24, "value_max_token_distance": 8, "context_max_token_distance": 64}]}],
        "forbidden_relations": [{"name": "wrong", "variants": [{
            "left_aliases": ["client"], "relation_aliases": ["ignores"], "right_aliases": ["pool"], "required_value_aliases": [],
            "context_aliases": [], "max_token_distance": 24, "value_max_token_distance": 8, "context_max_token_distance": 64}]}]}
    import json

    specs = spark.createDataFrame([(json.dumps(spec),)], "j string").select(F.from_json("j", SPEC_SCHEMA).alias("s")).select("s.*")

    def hits(text, fix=""):
        parts = spark.createDataFrame([("c", 0, "summary", text), ("c", 1, "recommended_fix", fix)], "case_id string, part_no int, kind string, text string")
        rows = semantic.rule_hits(semantic.case_texts(parts, "v22"), semantic.rule_table(specs, "v22"), "v22").collect()
        return {r["name"]: r["hit"] for r in rows}

    good = hits("The database is slow. Client 7 uses the pool. Pool size is now 5.")
    assert good == {"limit": True, "uses": True, "wrong": False}
    assert hits("pool size 3 not 5")["limit"] is False  # another number stands between
    assert hits("Client 7 uses the pool.")["uses"] is False  # no context clause near
    assert hits("client ignores the pool")["wrong"] is True
    assert hits("if the client ignores the pool")["wrong"] is False
    assert hits("fine", "client ignores the pool")["wrong"] is False


def test_tree_hash_is_the_plain_digest(spark):
    import hashlib

    files = spark.createDataFrame([("1", "b", "x\r\ny"), ("1", "a", "z"), ("1", "target/c", "no")], "case_id string, file string, content string")
    want = hashlib.sha256(b"a\0z\0b\0x\ny\0").hexdigest()
    assert integrity.tree_hash(files, ["case_id"]).first()["tree_sha256"] == want


def test_read_repositories(spark, tmp_path):
    for name, body in {"r1/src/A.java": b"class A {}\r\n", "r1/target/B.java": b"x", "r1/.git/c.yml": b"x", "r1/bad.xml": b"\xff\xfe", "r1/a.txt": b"x", "r2/b.yml": b"k: v"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    rows = fs.read_repositories(spark, f"file:{tmp_path}").collect() or fs.read_repositories(spark, str(tmp_path)).collect()
    assert {(r["repo"], r["file"], r["content"]) for r in rows} == {("r1", "src/A.java", "class A {}\n"), ("r2", "b.yml", "k: v")}


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"case_id":"a","acceptable_files":["x"],"acceptable_change_concepts":["y"],"forbidden_files":["z"]}\n\n'
                                      '{"case_id":"a","acceptable_files":["x"],"acceptable_change_concepts":["y"],"forbidden_files":["z"]}\n{"case_id":"b","oops":1}\nnope\n')
    raw = records.read_jsonl(spark, str(tmp_path / "g.jsonl"))
    rows = records.strict_records(raw, records.GOLD_SCHEMA, "case_id", records.GOLD_FIELDS).orderBy("line_no").collect()
    assert [(r["line_no"], r["error"]) for r in rows] == [(1, "duplicate_key"), (3, "duplicate_key"), (4, "unknown_field:oops"), (5, "invalid_json")]


def test_trace_numbers_continue_over_batches(spark, tmp_path):
    rows = [(i % 3, "tool_call", f"2024-01-0{1 + i // 20} 00:00:{i % 20:02d}", i, "{}") for i in range(60)]
    schema = "task_id long, kind string, recorded_at timestamp, arrival long, payload string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for n in range(3):
        part = spark.createDataFrame(rows[n * 20:(n + 1) * 20], "task_id long, kind string, recorded_at string, arrival long, payload string")
        part.withColumn("recorded_at", F.to_timestamp("recorded_at")).coalesce(1).write.mode("append").parquet(src)
    tasks = spark.createDataFrame([(0,), (1,)], "task_id long")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.append_traces(stream, tasks, out, str(tmp_path / "cp"))
    got = spark.read.parquet(f"{out}/traces").collect()
    by_task = {}
    for r in got:
        by_task.setdefault(r["task_id"], []).append((r["seq"], r["arrival"]))
    assert set(by_task) == {0, 1} and all([s for s, _ in sorted(v)] == list(range(20)) for v in by_task.values())
    assert all([a for _, a in sorted(v)] == sorted(a for _, a in v) for v in by_task.values())
    assert spark.read.parquet(f"{out}/rejected").count() == 20


def test_interrupted_is_idempotent(spark):
    tasks = spark.createDataFrame([(1, "running", None, None), (2, "completed", None, None)], "task_id long, status string, finished_at timestamp, error_message string")
    tasks = tasks.withColumn("current_node", F.lit("n"))
    fixed, recovery = tr.mark_interrupted(tasks, F.current_timestamp())
    assert recovery.count() == 1 and tr.mark_interrupted(fixed, F.current_timestamp())[1].count() == 0


def test_invalid_status_fails(spark):
    bad = spark.createDataFrame([(1, "odd", "2024-01-01", 1, None, None)], "task_id long, status string, recorded_at string, arrival long, node string, error string")
    with pytest.raises(Exception, match="invalid status"):
        tr.task_status(bad).collect()
