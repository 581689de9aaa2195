"""The queries of this subpackage: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import blockmax, bpe, chat, fim, hnsw, htmltext, langid, merkle, mixing, neardup, repeats, setjoin, urls
from evidentia.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
keyed AS (SELECT doc_id, i, hash(array_to_string(list_slice(words, i, i + 34), ' ')) AS k,
                 md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS m FROM starts),
hot AS (SELECT k, m FROM keyed GROUP BY k, m HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM keyed JOIN hot USING (k, m)),
cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(js), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN words
                              ELSE list_filter(words, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=85)


ORACLES["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
raw AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))
                            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS s FROM w),
sets AS (SELECT doc_id, list_distinct(s) AS s FROM raw),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
          FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least ON id = doc_id
"""


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs, weights=(5, 2, 1), cap=3).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(rows.union(extra))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_CONTROL = chat.ESCAPE.replace("'", "''")
ORACLES["op2_chat_formatting"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows),
sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
  + CASE WHEN before IS NULL THEN length('{chat.START}{chat.TEXT}') + length(role) + len(regexp_extract_all(role, '{_CONTROL}'))
         WHEN before = role THEN length('{chat.NEXT}')
         ELSE length('{chat.END}{chat.START}{chat.TEXT}') + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + length('{chat.END}'))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERY_EVERY = 20


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and vectors in double precision that take part; of rows with one id, the least vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad).groupBy("id").agg(F.min("vector").alias("vector"))


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("id") % QUERY_EVERY == 0)


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole: Column = F.transform("vector", lambda x: F.floor(x * 64).cast("long"))
    weights = _vectors(spark, sf_dir).select("id", whole.alias("weights"))
    return blockmax.top_products(weights, _asked(weights), 20).select("query_id", "rank", "vec_id", "score")


ORACLES["op5_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.is_held_out(F.col("doc_id"))
    field = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), field).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).where(F.exists("vector", lambda x: x != 0))
    return hnsw.nearest(vectors, _asked(vectors), 20).select("query_id", "rank", "vec_id", "score")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = htmltext.main_text(pages, text_col="text")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")],
                                  "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op9_url_filters"] = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT *, '.' || host AS h,
  CASE WHEN suffix('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN suffix('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN suffix('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
       WHEN suffix('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

TOKENIZER = "byte_bpe_50k.json"


@query
def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    done = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed="1", rate=90, spm=20, restored_col="restored")
    return done.select("doc_id", F.col("n_chars").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM drawn),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


@query
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


ORACLES["op12_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
raw AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(list_slice(words, i, i + 2), ' '))
                            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS s FROM w),
sets AS (SELECT doc_id, list_distinct(s) AS s FROM raw),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
          FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT doc_id, n AS n_shingles, least_id AS component_id FROM sized JOIN (SELECT id, min(other) AS least_id FROM reach GROUP BY id) ON id = doc_id
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(hit, merkle.leaf_digest(*(F.col(c) for c in docs.columns[:-1]), lowered))
    done = merkle.manifest(docs, [F.col(c) for c in docs.columns], extra={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = done.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(low: int = 6, high: int = 3) -> str:
    """All levels written out: up to 16 ** low documents of a source, 16 ** high sources."""
    shown = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    fields = lambda text: "sha256(" + " || ".join(shown(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    crc = ("xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), "
           "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT), 4294967295)")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""docs AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {fields('text')} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {fields(lowered)} END AS tampered FROM documents),
low0 AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM docs)"""]
    folds = ["p0 AS (SELECT doc_id, grp, leaf, coalesce(tampered, leaf) AS f, '' AS proof, i AS place FROM low0)"]
    for name, depth in (("low", low), ("high", high)):
        if name == "high":
            steps.append(f"high0 AS (SELECT '' AS grp, grp AS member, d, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM low{low})")
        for k in range(depth):
            steps.append(f"""{name}{k}s AS (SELECT *, i // 16 AS up,
  coalesce(string_agg(d, '') OVER (PARTITION BY grp, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY grp, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT grp, up AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k}s GROUP BY grp, up, n)""")
            on = "x.grp = p.grp AND x.i = p.place" if name == "low" else "x.member = p.grp" if k == 0 else "x.i = p.place"
            folds.append(f"p{len(folds)} AS (SELECT p.doc_id, p.grp, p.leaf, CASE WHEN x.n = 1 THEN f ELSE sha256(x.l || f || x.r) END AS f, proof || x.l || x.r AS proof, x.up AS place "
                         f"FROM p{len(folds) - 1} p JOIN {name}{k}s x ON {on})")
    return "WITH " + ",\n".join(steps + folds) + f"""
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified
FROM p{low + high} p JOIN low{low} s ON s.grp = p.grp CROSS JOIN high{high} t"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()
