"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from evidentia import plans  # noqa: E402
from evidentia.plans import derive  # noqa: E402
from evidentia.session import local_session  # noqa: E402

HEADLINE = [
    "win_line_windows", "fn_tok_chunk", "pl_chunk_corpus", "ag_bm25_stats", "pl_bm25_search", "pl_lexical_search",
    "pl_hybrid_search", "pl_symbol_search", "pl_declarations", "jn_evidence_containment", "pl_validate_proposal",
    "pl_build_log_class", "ag_tree_hash", "fn_redact_artifact", "pl_semantic_v22", "ag_trace_rollup", "jn_gold_leak",
]

INDEXES = {
    "index_text": lambda spark, sf_dir: (derive.posting_index(spark, sf_dir), derive.line_index(spark, sf_dir, "[a-z0-9]+")),
    "index_code_and_text": derive.mixed_index,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "evidentia-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    only = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    if only is HEADLINE:  # indexes are built once and shared by the searches; their time is shown on its own
        for name, build in INDEXES.items():
            start = time.perf_counter()
            build(spark, sf_dir)
            times[name] = round(time.perf_counter() - start, 3)
            print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    for name in only:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
