"""Integrity, manifest and contamination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.operators import integrity as ig, phrases
from evidentia.plans import sqltext as S
from evidentia.plans.derive import doc_files, phrase_index, through_files
from evidentia.plans.registry import query
from evidentia.session import materialize, table


def _trees(spark, sf):
    """Documents as case trees of eight files; every fourth file is a test."""
    d = doc_files(spark, sf)
    folder = F.when(F.col("doc_id") % 4 == 0, "src/test/").otherwise("src/main/")
    return d.select((F.col("doc_id") / 8).cast("bigint").alias("case_id"), F.concat(folder, "file").alias("file"), "content", "doc_id")


_TREES = S.FILES + """, trees AS (
  SELECT doc_id // 8 AS case_id, CASE WHEN doc_id % 4 = 0 THEN 'src/test/' ELSE 'src/main/' END || file AS file, content, doc_id FROM files)"""


def _tree_sql(where, scope):
    return f"""SELECT case_id::VARCHAR AS case_id, '{scope}' AS scope,
  sha256(string_agg(file || chr(0) || content || chr(0), '' ORDER BY file)) AS tree_sha256 FROM trees WHERE {where} GROUP BY 1"""


_THREE = " UNION ALL ".join([_tree_sql("true", "all"), _tree_sql("file NOT LIKE 'src/test/%'", "source"), _tree_sql("file LIKE 'src/test/%'", "tests")])


def _tree_hashes(spark, sf):
    t = _trees(spark, sf)
    is_test = F.startswith("file", F.lit("src/test/"))
    # the three variants are three keys of one streamed hash
    scopes = F.array(F.lit("all"), F.when(is_test, "tests").otherwise("source"))
    return ig.tree_hash(t.withColumn("scope", F.explode(scopes)), ["case_id", "scope"])


@query("ag_tree_hash", f"WITH {_TREES} {_THREE}")
def ag_tree_hash(spark, sf):
    return _tree_hashes(spark, sf)


@query("ag_file_manifest", f"WITH {_TREES} SELECT case_id, file, sha256(content) AS sha256 FROM trees")
def ag_file_manifest(spark, sf):
    return ig.file_manifest(_trees(spark, sf), "case_id")


_RECORD = """sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"')
  || '","user_id":' || CASE WHEN user_id % 10 = 0 THEN 'null' ELSE user_id::VARCHAR END || '}')"""


def _records(spark, sf):
    return table(spark, sf, "events").withColumn("user_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))


@query("ag_record_hash", f"SELECT event_id, {_RECORD} AS sha256 FROM events")
def ag_record_hash(spark, sf):
    return ig.record_hash(_records(spark, sf), "event_id", ["event_type", "user_id", "props", "event_id"])


def _later(spark, sf):
    """The same trees after some files changed, vanished or appeared."""
    t = _trees(spark, sf)
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\n# edited"))).otherwise(F.col("content"))
    kept = t.where("doc_id % 11 <> 0").withColumn("content", changed)
    new = t.where("doc_id % 13 = 0").withColumn("file", F.concat("file", F.lit(".new")))
    return kept.unionByName(new)


_LATER = """, later AS (
  SELECT case_id, file, content || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '# edited' ELSE '' END AS content FROM trees WHERE doc_id % 11 <> 0
  UNION ALL SELECT case_id, file || '.new', content FROM trees WHERE doc_id % 13 = 0)"""


@query("jn_manifest_diff", f"""WITH {_TREES} {_LATER}
SELECT coalesce(b.case_id, a.case_id) AS case_id, coalesce(b.file, a.file) AS file, sha256(b.content) AS before, sha256(a.content) AS after,
  CASE WHEN coalesce(b.file, a.file) LIKE 'src/test/%' THEN 'tests' ELSE 'other' END AS scope
FROM trees b FULL JOIN later a ON a.case_id = b.case_id AND a.file = b.file WHERE b.content IS DISTINCT FROM a.content""")
def jn_manifest_diff(spark, sf):
    before = ig.file_manifest(_trees(spark, sf), "case_id")
    after = ig.file_manifest(_later(spark, sf), "case_id")
    return ig.manifest_diff(before, after, "case_id").withColumn("scope", ig.change_scope(F.col("file")))


def _frozen(spark, sf):
    return ig.file_manifest(_trees(spark, sf).withColumn("section", F.concat(F.lit("s"), (F.col("case_id") % 40).cast("string"))), "section")


_FREEZE = f"""WITH {_TREES} {_LATER}, checked AS (
  SELECT 's' || (t.case_id % 40) AS section, t.file, coalesce(sha256(l.content), 'missing') AS actual,
    coalesce(sha256(l.content), 'missing') = sha256(t.content) AS intact FROM trees t LEFT JOIN later l ON l.file = t.file)"""


@query("jn_freeze_verify", _FREEZE + " SELECT * FROM checked")
def jn_freeze_verify(spark, sf):
    return ig.freeze_check(_frozen(spark, sf), ig.file_manifest(_later(spark, sf)))


@query("src_manifest", f"""WITH {_TREES} SELECT section, file, sha FROM (SELECT 's' || (case_id % 40) AS section, file, sha256(content) AS sha FROM trees)""")
def src_manifest(spark, sf):
    from evidentia.sources.records import manifest_rows

    # per case a JSON map path -> hash, as manifests store it
    maps = _trees(spark, sf).groupBy("case_id").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("file", F.sha2("content", 256))))).alias("json"))
    stored = through_files(maps.select(F.concat(F.lit("s"), (F.col("case_id") % 40).cast("string")).alias("section"), "json"), "manifests", "section")
    rows = manifest_rows(stored.select(F.regexp_extract("source", "section=([^/]*)/", 1).alias("section"), F.col("raw").alias("json")), "section")
    return rows.select("section", "file", F.col("sha256").alias("sha"))


# --------------------------------------------------------------- contamination
def _gold_terms(spark, sf):
    """Long words and three-word concepts of the benchmark items."""
    b = table(spark, sf, "benchmark")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= ig.MIN_LEAK_SYMBOL)
    concepts = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ [a-z]+ [a-z]+"), 0)
    return b.select(F.explode(F.concat(words, concepts)).alias("term"))


_LEAKS = f"""WITH {S.FILES}, gold_terms AS (
  SELECT DISTINCT unnest(list_concat(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 8),
    regexp_extract_all(lower(text), '[a-z]+ [a-z]+ [a-z]+'))) AS term FROM benchmark),
leaks AS (SELECT file, term FROM files JOIN gold_terms ON contains(lower(content), term))"""


@query("jn_gold_leak", _LEAKS + " SELECT file, term FROM leaks")
def jn_gold_leak(spark, sf):
    return _leaks(spark, sf).select("file", "term")


def _leaks(spark, sf):
    return ig.term_leaks(doc_files(spark, sf), _gold_terms(spark, sf), phrase_index(spark, sf))


_AUDIT_PATTERNS = [*ig.PROHIBITED_TEST_TEXT, "password|secret|token", "the .* and"]


IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
_MIN_IDENTIFIER = 6
_IDENTIFIERS = f"""doc_idents AS (SELECT file, unnest(list_distinct(regexp_extract_all(content, '{IDENTIFIER}'))) AS token FROM files),
item_idents AS (SELECT 'items/i' || item_id AS file, unnest(list_distinct(regexp_extract_all(text, '{IDENTIFIER}'))) AS token FROM benchmark),
copied_idents AS (SELECT token, d.file, d.n AS files, i.file AS known_file, i.n AS known_files
  FROM (SELECT token, 'corpus/' || min(file) AS file, count(*) AS n FROM doc_idents WHERE length(token) >= {_MIN_IDENTIFIER} GROUP BY 1) d
  JOIN (SELECT token, 'gold/' || min(file) AS file, count(*) AS n FROM item_idents GROUP BY 1) i USING (token))"""


def _copied(spark, sf):
    items = table(spark, sf, "benchmark").select(
        F.lit("gold").alias("repo"), F.concat(F.lit("items/i"), F.col("item_id").cast("string")).alias("file"), F.col("text").alias("content"))
    return phrases.copied_identifiers(doc_files(spark, sf), items, IDENTIFIER, _MIN_IDENTIFIER)


@query("jn_token_audit", f"""WITH {S.FILES}, {_IDENTIFIERS},
pattern_hits AS (SELECT file, unnest(list_filter([""" + ", ".join(
    f"CASE WHEN regexp_matches(lower(content), {S.quoted(p)}) THEN {S.quoted(p)} END" for p in _AUDIT_PATTERNS) + """], lambda x: x IS NOT NULL)) AS token FROM files)
SELECT 'prohibited' AS audit, token, 'corpus/' || file AS file, 1 AS files, NULL AS known_file, NULL AS known_files FROM pattern_hits
UNION ALL SELECT 'copied', token, file, files, known_file, known_files FROM copied_idents""")
def jn_token_audit(spark, sf):
    """Prohibited text per file, and identifiers that documents and benchmark items share, with a file of each."""
    hits = doc_files(spark, sf).select(
        F.lit("prohibited").alias("audit"), F.explode(ig.pattern_hits(F.lower("content"), _AUDIT_PATTERNS)).alias("token"),
        F.concat_ws("/", "repo", "file").alias("file"), F.lit(1).cast("bigint").alias("files"),
        F.lit(None).cast("string").alias("known_file"), F.lit(None).cast("bigint").alias("known_files"))
    copied = _copied(spark, sf).select(
        F.lit("copied").alias("audit"), F.col("identifier").alias("token"), F.col("fresh_file").alias("file"), F.col("fresh_files").alias("files"), "known_file", "known_files")
    return hits.unionByName(copied)


# A document as a test source: some of its lines begin with one of the tokens.
_TEST_SOURCE = f"""test_lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, {S.lines('text')} AS ls FROM documents)),
test_sources AS (SELECT doc_id, string_agg(coalesce(([{', '.join(S.quoted(t) for t in V.CONFIG_OVERRIDES)}])[(doc_id + i * i) % 40 + 1], '') || line, chr(10) ORDER BY i) AS body
  FROM test_lines GROUP BY 1)"""


def _test_sources(spark, sf):
    tokens = F.array(*[F.lit(t) for t in V.CONFIG_OVERRIDES])
    number = F.transform(tx.lines_of(F.col("text")), lambda x, i: F.concat(
        F.coalesce(F.get(tokens, ((F.col("doc_id") + (i + 1) * (i + 1)) % 40).cast("int")), F.lit("")), x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(number, "\n").alias("body"))


@query("flt_config_override", f"WITH {_TEST_SOURCE} SELECT doc_id, unnest(list_filter([" + ", ".join(
    f"CASE WHEN contains(body, {S.quoted(t)}) THEN 'docs/' || doc_id || ': ' || {S.quoted(t)} END" for t in V.CONFIG_OVERRIDES)
    + "], lambda x: x IS NOT NULL)) AS hit FROM test_sources")
def flt_config_override(spark, sf):
    hits = ig.literal_hits(F.col("body"), V.CONFIG_OVERRIDES)
    return _test_sources(spark, sf).select("doc_id", F.explode(hits).alias("t")).select(
        "doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(": "), F.col("t")).alias("hit"))


@query("set_intersect", r"""SELECT md5(s) AS shared FROM (
  SELECT unnest(string_split_regex(text, '[.\n]+\s*')) AS s FROM documents INTERSECT
  SELECT unnest(string_split_regex(text, '[.\n]+\s*')) AS s FROM benchmark) WHERE s <> ''""")
def set_intersect(spark, sf):
    def parts(name):
        return table(spark, sf, name).select(F.explode(F.split("text", r"[.\n]+\s*")).alias("s")).where("s <> ''")

    return parts("documents").intersect(parts("benchmark")).select(F.md5("s").alias("shared"))


@query("set_except", """SELECT id, 'missing' AS side FROM (SELECT doc_id AS id FROM documents EXCEPT SELECT page_id FROM pages)
UNION ALL SELECT id, 'unexpected' FROM (SELECT item_id AS id FROM benchmark EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT id, 'unlabelled' FROM (SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def set_except(spark, sf):
    def ids(name, column):
        return table(spark, sf, name).select(F.col(column).alias("id"))

    sides = [("missing", ids("documents", "doc_id"), ids("pages", "page_id")), ("unexpected", ids("benchmark", "item_id"), ids("labels", "doc_id")),
             ("unlabelled", ids("documents", "doc_id"), ids("labels", "doc_id"))]
    parts = [want.join(have, "id", "left_anti").distinct().withColumn("side", F.lit(side)) for side, want, have in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _novelty(spark, sf):
    trees = ig.tree_hash(_trees(spark, sf), ["case_id"])
    d = table(spark, sf, "documents").withColumn("case_id", (F.col("doc_id") / 8).cast("bigint").cast("string"))
    first = d.groupBy("case_id").agg(F.min_by(F.lower(F.trim("text")), "doc_id").alias("description"), F.min_by("source", "doc_id").alias("family"))
    # five counts read these rows; the trees are hashed once for all
    rows = materialize(trees.join(first, "case_id").withColumn("known", F.col("case_id").cast("bigint") % 2 == 0), "audited-trees")
    copied = _leaks(spark, sf)
    cols = ["tree_sha256", "description", "family"]
    return ig.novelty(rows.where("not known").select(*cols), rows.where("known").select(*cols), copied)


_NOVELTY = _LEAKS.replace("WITH ", f"WITH {_TREES}, ", 1).replace(S.FILES + ", gold", "gold", 1) + """,
cases AS (SELECT case_id, sha256(string_agg(t.file || chr(0) || content || chr(0), '' ORDER BY t.file)) AS h,
    arg_min(lower(trim(content)), doc_id) AS descr, arg_min('src' || 0, doc_id) AS fam0, min(doc_id) AS first_doc FROM trees t GROUP BY 1),
fam AS (SELECT c.*, d.source AS family FROM cases c JOIN documents d ON d.doc_id = c.first_doc),
counts AS (SELECT family, count(*) AS n FROM fam WHERE case_id % 2 = 1 GROUP BY 1),
nov AS (SELECT (SELECT count(*) FROM (SELECT h FROM fam WHERE case_id % 2 = 1 INTERSECT SELECT h FROM fam WHERE case_id % 2 = 0)) AS shared_tree_sha256,
  (SELECT count(*) FROM (SELECT descr FROM fam WHERE case_id % 2 = 1 INTERSECT SELECT descr FROM fam WHERE case_id % 2 = 0)) AS shared_description,
  (SELECT count(*) FROM counts) AS families, (SELECT max(n) FROM counts) AS largest_family, (SELECT count(*) FROM leaks) AS copied)"""


@query("ag_novelty", _NOVELTY + """
SELECT *, shared_tree_sha256 = 0 AND shared_description = 0 AND copied = 0 AND families >= 6 AND largest_family <= 2 AS passed FROM nov""")
def ag_novelty(spark, sf):
    return _novelty(spark, sf)


@query("pl_contamination", _NOVELTY.replace("gold_terms AS", _IDENTIFIERS + ", gold_terms AS", 1) + """,
audits AS (SELECT 'gold_leak' AS audit, count(*) AS hits FROM leaks
  UNION ALL SELECT 'copied_identifier', count(*) FROM copied_idents
  UNION ALL SELECT 'token', count(*) FROM documents WHERE """ + " OR ".join(
    f"regexp_matches(lower(text), {S.quoted(p)})" for p in _AUDIT_PATTERNS) + """
  UNION ALL SELECT 'shared_tree', shared_tree_sha256 FROM nov UNION ALL SELECT 'shared_description', shared_description FROM nov
  UNION ALL SELECT 'families', families FROM nov UNION ALL SELECT 'largest_family', largest_family FROM nov)
SELECT audit, hits, CASE audit WHEN 'families' THEN hits >= 6 WHEN 'largest_family' THEN hits <= 2 ELSE hits = 0 END AS passed FROM audits""")
def pl_contamination(spark, sf):
    """Every audit with its count and verdict: leaks, copies, prohibited text, and how the families are spread."""
    names = {"gold_leak": "copied", "shared_tree": "shared_tree_sha256", "shared_description": "shared_description", "families": "families", "largest_family": "largest_family"}
    n = _novelty(spark, sf).select(F.explode(F.array(*(
        F.struct(F.lit(audit).alias("audit"), F.col(column).alias("hits")) for audit, column in names.items()))).alias("r")).select("r.*")
    token = doc_files(spark, sf).agg(
        F.count_if(F.size(ig.pattern_hits(F.lower("content"), _AUDIT_PATTERNS)) > 0).alias("hits")).select(F.lit("token").alias("audit"), "hits")
    copied = _copied(spark, sf).agg(F.count(F.lit(1)).alias("hits")).select(F.lit("copied_identifier").alias("audit"), "hits")
    passed = F.when(F.col("audit") == "families", F.col("hits") >= ig.MIN_FAMILIES).when(
        F.col("audit") == "largest_family", F.col("hits") <= ig.MAX_PER_FAMILY).otherwise(F.col("hits") == 0)
    return n.unionByName(token).unionByName(copied).withColumn("passed", passed)


@query("pl_freeze", f"""WITH {_TREES}, hashes AS ({_THREE})
SELECT CASE scope WHEN 'all' THEN 'sample_hashes' WHEN 'source' THEN 'source_hashes' ELSE 'test_hashes' END AS section, case_id AS key, tree_sha256 AS sha256 FROM hashes
UNION ALL SELECT 'gold_hashes', event_id::VARCHAR, {_RECORD} FROM events
UNION ALL SELECT 'file_hashes', file, sha256(content) FROM trees""")
def pl_freeze(spark, sf):
    section = F.when(F.col("scope") == "all", "sample_hashes").when(F.col("scope") == "source", "source_hashes").otherwise("test_hashes")
    trees = _tree_hashes(spark, sf).select(section.alias("section"), F.col("case_id").alias("key"), F.col("tree_sha256").alias("sha256"))
    gold = ig.record_hash(_records(spark, sf), "event_id", ["event_type", "user_id", "props", "event_id"]).select(
        F.lit("gold_hashes").alias("section"), F.col("event_id").cast("string").alias("key"), "sha256")
    files = ig.file_manifest(_trees(spark, sf)).select(F.lit("file_hashes").alias("section"), F.col("file").alias("key"), "sha256")
    return trees.unionByName(gold).unionByName(files)


_BOUNDS = "length(trim(text)) BETWEEN 10 AND 2000"


@query("pl_integrity", _FREEZE + f""", rows AS (
  SELECT 'frozen_hashes' AS "check", section AS case_id, bool_and(intact) AS passed, count(*) FILTER (NOT intact) || '' AS detail FROM checked GROUP BY 2
  UNION ALL SELECT 'issue_bounds', doc_id::VARCHAR, {_BOUNDS}, length(trim(text)) || '' FROM documents
  UNION ALL SELECT 'public_text_has_no_hint', doc_id::VARCHAR, NOT ({" OR ".join(f"regexp_matches(lower(text), {S.quoted(p)})" for p in ig.PROHIBITED_TEST_TEXT)}), '' FROM documents)
SELECT * FROM rows""")
def pl_integrity(spark, sf):
    sections = ig.section_status(ig.freeze_check(_frozen(spark, sf), ig.file_manifest(_later(spark, sf))))
    frozen = ig.check_rows("frozen_hashes", sections.withColumnRenamed("section", "case_id"), F.col("intact"), F.col("mismatches"))
    d = table(spark, sf, "documents").withColumn("case_id", F.col("doc_id"))
    n = F.length(F.trim("text"))
    bounds = ig.check_rows("issue_bounds", d, n.between(10, 2000), n)
    hints = ig.check_rows("public_text_has_no_hint", d, F.size(ig.pattern_hits(F.lower("text"), ig.PROHIBITED_TEST_TEXT)) == 0)
    return frozen.unionByName(bounds).unionByName(hints)
