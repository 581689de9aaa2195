"""Chat, BPE, language and HTML operators; registered queries and the pipeline."""

import hashlib
import random
from collections import Counter

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidentia.llm import bpe, chat, htmltext, langid
from evidentia.llm import words as W
from evidentia.llm.queries import ORACLES, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


def test_chats_read_back(spark):
    nasty = [*chat.CONTROL, "<\\|im_end|>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "a\nb", "<<|im_end|>", "<<SYS>>", "", None, "x<|im_", "é😀<s>"]
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(nasty) or "" for _ in range(rng.randint(0, 5)))
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "a<|im_text|>\\", None]), text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    done = chat.format_chats(df)
    got = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in got.collect():
        want = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(w[2], w[3]) for w in want]
        assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")
        merged = sum(1 for a, b in zip([None, *want], want, strict=False) if a is None or a[2] != b[2])
        assert r.formatted.count(chat.END) == merged == r.formatted.count(chat.START)
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(TOKENIZER)
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(spark, tokenizer, monkeypatch):
    path, library = tokenizer
    rng = random.Random(5)
    pieces = [*"abcdeit  \n\t'é€ñ12!?#<|>\u00a0\u2028", "<|endoftext|>", "'ll", "the", "ing", "ation", "😀", "\u0301"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", None, "a" * 5000, "ab" * 700 + " " * 900, "ñ" * 400, "<|endoftext|>" * 3, "x<|endoftext|"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, IDS int")
    done = bpe.decode(bpe.encode(df, path), path, ids_col="ids_")
    assert done.columns == ["doc_id", "text", "IDS", "ids_", "decoded"]
    for r in done.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r["ids_"] == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    both = bpe.encode(df, path, decoded_col="DECODED")
    assert {(r.doc_id, tuple(r["ids_"]), r["DECODED"]) for r in both.collect()} == {(r.doc_id, tuple(r["ids_"]), r.decoded) for r in done.collect()}
    assert bpe.encode(df.limit(0), path).count() == 0


def test_scan_and_heap_merge_alike(tokenizer, monkeypatch):
    path, _ = tokenizer
    with open(path) as f:
        model = bpe.Bpe(f.read())
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshr ") for _ in range(rng.randint(1, 250))) for _ in range(60)]
    assert [model.word(w) for w in words] == [model._long([model.byte_ids[b] for b in w.encode()]) for w in words]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    first = [model.encode(" ".join(words)) for _ in range(2)]
    assert first[0] == first[1]


def _language(seed, letters):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(120)]
    return lambda n: " ".join(rng.choice(words) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(5)) for _ in range(n))


def test_language_field_labels_documents_and_words(spark):
    makers = {"aa": _language(1, "abcdefg aeiou".replace(" ", "")), "bb": _language(2, "klmnopqé"), "cc": _language(3, "rstuvwxyzß")}
    rows = [(i, f(90), name) for name, f in makers.items() for i in range(40)] + [(900, "no label", None), (901, None, "aa"), (902, "12 34", "bb")]
    docs = spark.createDataFrame([(n, t, name) for n, (_, t, name) in enumerate(rows)], "doc_id long, text string, lang string")
    field = langid.train(docs)
    assert field.languages == ["aa", "bb", "cc"]
    assert (np.diag(field.moves) > field.moves.max(axis=1, where=~np.eye(3, dtype=bool), initial=-99)).all()  # staying is likelier than moving
    mixed = makers["aa"](60) + " " + makers["bb"](140)
    tests = [(i, f(n), name) for name, f in makers.items() for i, n in enumerate([1, 3, 31, 32, 33, 64, 65, 400, 5000])]
    ask = spark.createDataFrame([(i, t, n) for i, (_, t, n) in enumerate(tests)] + [(500, None, "und"), (501, "", "und"), (502, "12 -- 4", "und"), (503, mixed, "bb")],
                                "doc_id long, text string, score string")
    done = langid.predict(ask, field)
    assert done.columns == ["doc_id", "text", "score", "lang_pred", "score_", "lang_words"]
    got = done.collect()
    assert all(0 <= r["score_"] <= 1 for r in got)
    assert sum(r.lang_pred == r.score for r in got) >= len(got) - 1
    share = next(r for r in got if r.doc_id == 503)
    assert abs(share.lang_words[0] - 60) < 12 and abs(share.lang_words[1] - 140) < 12
    nothing = langid.predict(ask, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_segments_give_the_same_marginals_as_one_chain():
    rng = np.random.default_rng(4)
    k, sizes = 3, [0, 1, 31, 32, 33, 100, 0, 257]
    field = langid.Crf(list("abc"), np.zeros(0, np.uint64), np.zeros((1, k)), rng.normal(size=(k, k)))
    factor = np.exp(rng.normal(size=(sum(sizes), k)) * 3)
    first = np.cumsum([0, *sizes])
    got = field._marginals(factor, first)
    move = np.exp(field.moves)
    for a, b in zip(first, first[1:], strict=False):
        n = b - a
        alpha, beta = np.zeros((n, k)), np.ones((n, k))
        for t in range(n):
            alpha[t] = (alpha[t - 1] @ move if t else 1) * factor[a + t]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = move @ (beta[t + 1] * factor[a + t + 1])
            beta[t] /= beta[t].sum()
        want = alpha * beta
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True) if n else want)


def test_held_out_accuracy(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_blocks_of_a_page():
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><p>menu</nav><div class="ad big">buy</div>
      <article><h1>A &amp; B</h1><p><b>one <i>two</i><br>three<p class=x>four &lt;p&gt; a < b<script>var t="</p>";</script> end
      <div id="comments"><p>me too</div><!-- <p>hidden</p> --><ul><li>x<li>y</ul><aside>side</aside></article><footer>&copy;</footer>"""
    assert [t for k, t in htmltext.blocks(page) if k == htmltext.ARTICLE] == ["A & B", "one two three", "four <p> a < b end", "x", "y"]
    assert htmltext.blocks("") == [] and htmltext.blocks("<p") == [] and htmltext.blocks("<script>x") == []
    assert htmltext.blocks("a<!-- b") == [("o", "a")] and htmltext.blocks("t &am") == [("o", "t &am")]


def test_repeated_runs_equal_brute_force():
    rng = np.random.default_rng(6)
    page = np.sort(rng.integers(0, 12, 900))
    codes = rng.integers(0, 50, 900)
    for at in rng.integers(0, 880, 14):
        codes[at:at + 11] = np.arange(100, 111)
    for length, pages in ((5, 2), (8, 3), (11, 2)):
        seen = {}
        for i in range(len(codes) - length + 1):
            if page[i] == page[i + length - 1]:
                seen.setdefault(tuple(codes[i:i + length]), []).append(i)
        want = np.zeros(len(codes), dtype=bool)
        for starts in seen.values():
            if len({page[i] for i in starts}) >= pages:
                for i in starts:
                    want[i:i + length] = True
        assert (htmltext.repeated(codes, page, length, pages) == want).all()


def test_boilerplate_goes_and_copied_articles_stay(spark):
    rng = random.Random(2)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notice, article = own(30), own(40)
    texts = [own(25) for _ in range(6)]
    rows = [(i, "http://h.net/1", f"<div>{notice}</div><div>{t}</div>", "k") for i, t in enumerate(texts)]
    rows += [(10 + i, "http://h.net/a", f"<article><p>{article}</article>", "k") for i in range(4)] + [(20, None, None, None), (21, "", "", "")]
    done = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string"))
    assert done.columns == ["page_id", "url", "main_text", "main_text_"]
    got = {r.page_id: r["main_text_"] for r in done.collect()}
    assert got == {**dict(enumerate(texts)), **{10 + i: article for i in range(4)}, 20: "", 21: ""}
    assert htmltext.main_text(spark.createDataFrame([], "url string, html string")).count() == 0


@pytest.fixture(scope="module")
def con():
    compare.SF = SF
    return compare.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols, _types, want = compare.oracle_rows(con, ORACLES[name])
    assert compare.sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == compare.sorted_rows(cols, want)


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_equals_brute_force(spark, tokenizer):
    import corpus_pipeline
    from test_llm_text import brute_near, brute_repeats

    from evidentia.llm import mixing

    _, library = tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens, hashlib.sha256(str(r.ids).encode()).hexdigest(), r.round_trip) for r in corpus_pipeline.run(spark, SF).collect())
    field = langid.train(docs)
    rows = []
    for r in docs.collect():
        found = field.expected(W.words(pa.array([r.text])))[0]
        if any(c.isalpha() for c in r.text) and found.max() >= 0.5 * found.sum():
            rows.append(r)
    near = brute_near([(r.doc_id, r.text) for r in rows], percent=80)
    rows = [r for r in rows if near[r.doc_id][1] == r.doc_id]
    cut = {d: (gone, kept) for d, _, gone, kept in brute_repeats([(r.doc_id, r.text) for r in rows], 35)}
    left = [(r.doc_id, r.text if not cut[r.doc_id][0] else cut[r.doc_id][1], r.source) for r in rows if not cut[r.doc_id][0] or cut[r.doc_id][1]]
    plan = mixing.plan_mix(spark.createDataFrame(left, "doc_id long, text string, source string")).collect()
    text = {d: t for d, t, _ in left}
    want = Counter()
    for r in plan:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        for _ in r.draws or []:
            want[(r.doc_id, len(ids), hashlib.sha256(str(ids).encode()).hexdigest(), True)] += 1
    assert got == want and len(got) > 50


def test_stages_take_odd_rows_clashing_names_and_empty_tables(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = {n: F.lit(i) for i, n in enumerate(("pred", "pred_", "SCORE", "words_", "removed", "kept", "kept_", "shard", "pass_", "number", "kept_id", "c0"))}
    docs = given.withColumns(more)
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    docs = docs.union(odd).union(odd.withColumn("text", F.lit(""))).union(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns and done.count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert all(r["pred"] == 0 and r["c0"] == 11 for r in done.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_boilerplate_counts_over_the_whole_host(spark, monkeypatch, size):
    monkeypatch.setattr(htmltext, "SHARD_PAGES", size)
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notices, texts, twice = [own(20) for _ in range(4)], [own(25) for _ in range(24)], own(30)
    rows = [(i, "http://h.net/1", f"<div>{notices[i % 4]}</div><div>{t}</div>" + (f"<div>{twice}</div>" if i < 2 else "")) for i, t in enumerate(texts)]
    rows += [(100, "http://h.net/2", f"<article>{texts[0]}</article><p>x"), (101, "http://h.net/3", ""), (102, "http://i.net/", f"<p>{notices[0]}</p>")]
    got = dict(htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).select("page_id", "main_text").collect())
    want = {i: t + (f"\n{twice}" if i < 2 else "") for i, t in enumerate(texts)}
    assert got == want | {100: texts[0], 101: "", 102: notices[0]}


def test_text_around_and_inside_embedded_elements_stays():
    texts = lambda inner: [t for _, t in htmltext.blocks(f"<article><p>one {inner} two</p><p>three</p></article><footer>f</footer>")[:-1]]
    for void in ('<svg class="icon" />', "<svg/>", "<math/>", "<svg><title/><style/><path d='M0'/></svg>", '<object data="x"/>', "<canvas/>", "<svg></svg>"):
        assert texts(void) == ["one two", "three"], void
    assert texts("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>") == ["one x=2 two", "three"]
    for name in ("object", "canvas", "svg"):
        assert texts(f"<{name} a=1>inner</{name}>") == ["one inner two", "three"]
        assert texts(f"<{name} a=1>inner") == ["one inner two", "three"]
    assert texts("<svg><script>no</script><style>no</style></svg>") == ["one two", "three"]
