"""Vector searches, mixing and URL rules against brute-force versions."""

import numpy as np
import pytest

from evidentia.llm import blockmax, hnsw, mixing, urls


def brute_top(ids, vectors, query_ids, queries, k):
    out = {}
    for q, v in zip(query_ids, queries, strict=True):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), i) for i, w in zip(ids, vectors, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scale", [3, 1 << 40])
def test_exact_topk_equals_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-4, 5, (300, 6)) * np.int64(scale // 3)
    vectors[50:60] = vectors[0]
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, []), (1001, [1])]
    df = spark.createDataFrame(rows, "id long, weights array<long>")
    asked = df.where("id % 20 = 0")
    if scale > 3:
        with np.errstate(over="ignore"):
            rows = [(i, [x // (1 << 12) for x in w]) for i, w in rows]
        df = spark.createDataFrame(rows, "id long, weights array<long>")
        asked = df.where("id % 20 = 0")
    got = found(blockmax.top_products(df, asked, 7))
    names = [i for i, _ in rows if i % 20 == 0]
    assert got == brute_top([i for i, _ in rows], [w for _, w in rows], names, [w for i, w in rows if i % 20 == 0], 7)


def test_search_shard_of_few_rows_and_of_none(spark):
    ids, weights = np.array([1, 2]), np.array([[1, 2], [3, 4]])
    assert blockmax.search_shard(ids, weights, np.array([1]), np.array([[1, 1]]), 20) == [(1, 2, 7)]
    empty = spark.createDataFrame([], "id long, weights array<long>")
    assert blockmax.top_products(empty, empty).count() == 0


def test_graph_search_has_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 700 * 24 * 8)
    monkeypatch.setattr(hnsw, "QUERY_GROUP", 40)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 24))
    vectors = centers[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 24)) * 0.6
    vectors[100:400] = vectors[100]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = found(hnsw.nearest(df, df.where("id % 20 = 0"), 20))
    products = vectors[::20] @ vectors.T
    hits = 0
    for n, q in enumerate(range(0, 2000, 20)):
        order = [i for i in np.lexsort((np.arange(2000), -np.round(products[n], 9))) if i != q][:20]
        assert len(got[q]) == 20 and all(abs(products[n][i] - s) < 1e-9 for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(order))
    assert hits >= 0.95 * 20 * 100
    assert got[0] == found(hnsw.nearest(df, df.where("id % 20 = 0"), 20))[0]


def test_graph_of_few_points(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "id long, vector array<double>")
    assert found(hnsw.nearest(df, df.where("id = 0"), 20)) == {0: [(1, 0.5), (2, 0.5)]}
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_vectors_of_other_lengths_never_meet(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LOT", 2)
    rows = [(i, [float(i % 7), 1.0]) for i in range(9)] + [(20 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(40, []), (41, [3.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = found(hnsw.nearest(df, df, 3))
    for i, v in rows:
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v) > 0)[:3]
        assert got.get(i, []) == [(j, -s) for s, j in want]


def test_targets_reshare_what_is_above_the_cap():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 1000, 90], [5, 2, 1], 3)
    assert got[0] == 30 and got[1] == pytest.approx(1070 * 2 / 3) and got[2] == 270 or got[2] <= 270
    assert sum(got) == pytest.approx(1100)
    assert mixing.targets([], [], 3) == [] and mixing.targets([0, 0], [5, 2], 3) == [0, 0]


def test_tree_splits_quotas_exactly():
    leaves = mixing.splitting_tree([50, 0, 7, 43], 6, 3)
    assert leaves.sum(axis=0).tolist() == [50, 0, 7, 43] and set(leaves.sum(axis=1)) <= {16, 17}
    assert (leaves == mixing.splitting_tree([50, 0, 7, 43], 6, 3)).all()


def mixed_rows():
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), rng.choice(["a", "a", "a", "b", "c", "d"])) for i in range(900)]
    return [(i, t, str(s)) for i, t, s in rows] + [(2000, "x y", None), (2001, None, "a"), (2002, "", "zero"), (None, "p q r", "b"), (5, rows[5][1], str(rows[5][2]))]


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCK_WORDS", 2000)
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [r.asDict() for r in mixing.plan_mix(df, shards=5).collect()]
    again = [r.asDict() for r in mixing.plan_mix(df.repartition(7), shards=5).collect()]
    key = lambda r: str(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(map(key, plan)) == sorted(map(key, again)) and len(plan) == len(rows)
    sizes, taken, target = {}, {}, {}
    source = {r[0]: r[2] for r in rows}
    for r in plan:
        s = source[r["doc_id"]]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["draws"] or [])
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = mixing.targets([sizes[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))], 3)
    for s, w in zip(order, want, strict=True):
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= max(30, 0.02 * w)
    mixed = mixing.mix(df, shards=5)
    assert mixed.columns == ["doc_id", "text", "source", "shard", "pass"]
    drawn = {}
    for r in mixed.collect():
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + len((r.text or "").split())
    planned = {}
    for r in plan:
        planned[r["doc_id"]] = planned.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in drawn.items() if v} == {k: v for k, v in planned.items() if v}
    assert mixing.plan_mix(df.limit(0)).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/x", "block")]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h), len(p), h + p, v) for h, p, v in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("ranges", [None, 4, 9])
def test_urls_equal_brute_force(spark, ranges):
    hosts = ["a.net", "net", "xnet", "example.net", "b.example.net", "EXAMPLE.com", "c.example.com", "org", "w.org", "w.org:80", "org.evil", ""]
    paths = ["", "/", "/en/1", "/de/", "/de/x?q=/fr/", "/fr/x", "/fr/y#/en/", "?x://y/z", "/en"]
    all_urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no-scheme.net/en/", "a://b://net/", "://net/"] + ["http://a.net/same"] * 60
    rows = [(i, u, "x") for i, u in enumerate(all_urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    done = urls.judge(df, rules, ranges=ranges)
    assert done.columns == ["page_id", "url", "rule", "host", "path", "rule_", "verdict"]
    assert {r.page_id: (r.host, r.path, r["rule_"], r.verdict) for r in done.collect()} == {i: brute_judge(u) for i, u, _ in rows}
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.limit(0), default="block").collect()} == {"block"}
