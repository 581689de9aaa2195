"""Inputs that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import bm25, corpus, lexical, phrases, querying, retrieval
from evidentia.session import computed_once, drops, materialize, new_table_path, spread, table
from evidentia.sources.records import read_jsonl

_INDEX: dict[tuple[str, int, str, int, str], object] = {}


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one corpus."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.lit("corpus").alias("repo"),
        F.concat(F.lit("docs/d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".yml")).alias("file"),
        F.col("text").alias("content"),
        "doc_id",
    )


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as search queries with normalised terms."""
    idents = F.filter(
        F.regexp_extract_all("text", F.lit(tx.IDENTIFIER), 0), lambda x: F.length(x) >= 3
    )
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit("corpus").alias("repo"),
        "text",
        tx.normal_terms(idents).alias("terms"),
    )


def _version(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes when a file of the indexed tables does; no column is read for it."""
    files = [table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
             for name in ("documents", "benchmark")]
    return files[0].unionByName(files[1]).distinct().agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()[0] or 0


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """Index tables are written once per application and version of the input tables."""
    key = (spark.sparkContext.applicationId, drops(), sf_dir, _version(spark, sf_dir), name)
    if key not in _INDEX:
        _INDEX[key] = build()
    return _INDEX[key]


def chunk_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored chunk table of the document corpus and its token weights."""
    return _once(
        spark, sf_dir, "chunks", lambda: bm25.build_index(corpus.window_corpus(doc_files(spark, sf_dir)))
    )


def posting_index(spark: SparkSession, sf_dir: str) -> bm25.Postings:
    """The stored inverted index of the document corpus."""
    return _once(spark, sf_dir, "postings", lambda: bm25.build_postings(*chunk_index(spark, sf_dir)))


def line_index(spark: SparkSession, sf_dir: str, run_pattern: str) -> lexical.Lines:
    """The stored line index of the document corpus."""
    return _once(spark, sf_dir, f"lines-{run_pattern}", lambda: lexical.build_lines(doc_files(spark, sf_dir), run_pattern))


def through_files(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """The ``raw`` lines written as JSONL files to the shared folder and read back by the reader."""
    path = new_table_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).text(path)
    return read_jsonl(df.sparkSession, path)


def phrase_index(spark: SparkSession, sf_dir: str) -> phrases.Phrases:
    """The stored phrase index of the document corpus."""
    return _once(spark, sf_dir, "phrases", lambda: phrases.build(doc_files(spark, sf_dir)))


# ------------------------------------------------------------------ source code
def _capital(word, default: str):
    w = F.coalesce(word, F.lit(default))
    return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one source file of the repository named by its source.

    The words of the document name the types and methods, and each of its lines
    becomes a statement, so the code grows with the text.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    words = lambda text: F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), 0)
    # three words are used; where the head holds more than three, none of the first three is cut
    docs = computed_once(docs, _head=words(F.left("text", F.lit(400))))
    docs = computed_once(docs, _found=F.when(F.size("_head") > 3, F.slice("_head", 1, 3)).otherwise(words(F.col("text"))))
    found = F.col("_found")
    named = docs.select(
        "doc_id", "source", tx.lines_of(F.col("text")).alias("body"),
        F.concat(_capital(F.get(found, F.lit(0)), "alpha"), F.lit("Service")).alias("cls"),
        F.concat(_capital(F.get(found, F.lit(1)), "beta"), F.lit("Repository")).alias("dep"),
        F.concat(F.lit("find"), _capital(F.get(found, F.lit(2)), "gamma")).alias("method"),
    )

    def t(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    head = F.array(
        t("package com.acme.", F.col("source"), ";"), t(""), t("import java.util.List;"),
        t("import com.acme.store.", F.col("dep"), ";"), t(""), t("@Service"),
        t("public class ", F.col("cls"), " {"),
        t("    private final ", F.col("dep"), " repo;"), t(""),
        t("    public ", F.col("cls"), "(", F.col("dep"), " repo) {"), t("        this.repo = repo;"), t("    }"),
        t(""), t("    @Transactional"), t("    public List<String> ", F.col("method"), "(String key) {"),
        t('        String open = "{ not a brace";'), t("        /* block { comment"), t("           } */"),
        t("        // line } comment"),
    )
    statements = F.transform(
        "body", lambda x: F.concat(F.lit('        text.add("'), tx.only(x, "A-Za-z0-9 "), F.lit('");'))
    )
    tail = F.array(t("        return repo.load(key);"), t("    }"), t("}"))
    return named.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/main/java/com/acme/"), "source", F.lit("/D"), F.lpad(F.col("doc_id").cast("string"), 9, "0"),
                 F.lit(".java")).alias("file"),
        F.concat(F.array_join(F.concat(head, statements, tail), "\n"), F.lit("\n")).alias("content"),
        "doc_id", "cls", "dep", "method", F.size("body").cast("bigint").alias("n_body"),
    )


def symbol_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as symbol lookups: (query_id, repo, symbol, symbol_no)."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0)
    symbols = F.array(
        F.concat(_capital(F.get(found, F.lit(0)), "alpha"), F.lit("Service")),
        F.concat(F.lit("find"), _capital(F.get(found, F.lit(1)), "beta")),
        F.lit("Transactional"),
    )
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"),
        F.posexplode(symbols).alias("symbol_no", "symbol"),
    )


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files beside the code derived from them, in the repository of their source."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("repo"), F.concat(F.lit("docs/d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".yml")).alias("file"),
        F.col("text").alias("content"))
    return docs.unionByName(code_files(spark, sf_dir).select("repo", "file", "content"))


def mixed_index(spark: SparkSession, sf_dir: str) -> retrieval.Index:
    """The stored index of the mixed corpus."""
    return _once(spark, sf_dir, "mixed", lambda: retrieval.build(mixed_files(spark, sf_dir)))


def case_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as cases: queries built from their text and the symbols that a plan names."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0)
    symbols = F.array(
        F.concat(_capital(F.get(words, F.lit(0)), "alpha"), F.lit("Service")), F.concat(F.lit("find"), _capital(F.get(words, F.lit(1)), "beta")),
        F.lit("Transactional"))
    cases = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"), "text", symbols.alias("symbols"))
    none = F.lit(None).cast("array<string>")
    return querying.build_queries(cases, F.col("text"), F.lit(""), none, none, F.col("symbols"), none, none, none, none)


def case_channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three channels' hits of all cases over the mixed corpus."""
    return _once(spark, sf_dir, "case-channels", lambda: retrieval.channels(mixed_index(spark, sf_dir), case_queries(spark, sf_dir)))


# --------------------------------------------------------------- ranges and edits
def _line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n): how many lines a document has, counted once and not for each range that is made from it."""
    docs = spread(table(spark, sf_dir, "documents"))
    return computed_once(docs, n=F.size(tx.lines_of(F.col("text"))).cast("bigint")).select("doc_id", "n")


def case_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three retrieved ranges per document: (case_id, file, rank, start_line, end_line)."""
    d = _line_counts(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"),
        F.concat(F.lit("docs/d"), F.col("doc_id").cast("string")).alias("file"),
        "n",
        F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])).alias("k"),
    ).where("n > 0")
    start = (F.col("case_id") * 7 + F.col("k") * 11) % F.col("n") + 1
    return d.select("case_id", "file", (F.col("k") + 1).alias("rank"), start.alias("start_line"),
                    F.least(start + 5 + F.col("k") * 3, F.col("n")).alias("end_line"))


def case_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six evidence references per document; some inverted, some to another file."""
    d = _line_counts(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"),
        "n",
        F.explode(F.array(*[F.lit(j).cast("bigint") for j in range(6)])).alias("j"),
    ).where("n > 0")
    start = (F.col("case_id") * 5 + F.col("j") * 9) % F.col("n") + 1
    return d.select(
        "case_id", (F.col("j") % 3).alias("candidate_index"), F.col("j").alias("evidence_index"),
        F.when(F.col("j") == 5, "docs/none").otherwise(F.concat(F.lit("docs/d"), F.col("case_id").cast("string")))
        .alias("file"),
        start.alias("start_line"),
        (start + F.col("j") * 2 - F.when(F.col("j") == 4, 10).otherwise(0)).alias("end_line"),
    )


def code_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files as case files."""
    return code_files(spark, sf_dir).withColumn("case_id", F.col("doc_id"))


def code_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two validated ranges per source file."""
    pair = F.array(*[F.struct(F.lit(a).cast("bigint").alias("start_line"), F.lit(b).cast("bigint").alias("end_line"))
                     for a, b in ((8, 11), (18, 25))])
    return code_cases(spark, sf_dir).select("case_id", "file", F.explode(pair).alias("r")).select(
        "case_id", "file", "r.*")


def proposed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten edits per source file, one for each way an edit can fare."""
    c = code_cases(spark, sf_dir).select(
        "case_id", "file", "content", F.slice(F.split("content", "\n"), 1, 25).alias("ls")
    )

    def line(i):
        return F.get(F.col("ls"), F.lit(i - 1))

    three = F.col("case_id") % 3
    helper = F.lit("        text.add(TextHelper.of(key));")
    plain = F.lit("        text.add(key);")
    first = F.when(three == 1, plain).otherwise(helper)
    five = F.col("case_id") % 5 == 0
    rows = [
        (0, F.col("file"), 20, 20, line(20), first, F.lit(True)),
        (1, F.col("file"), 3, 3, line(3), F.lit("import java.util.List;\nimport com.acme.util.TextHelper;"), three != 2),
        (2, F.col("file"), 20, 21, F.concat(line(20), F.lit("\n"), line(21)), F.lit("        text.clear();"), None),
        (3, F.col("file"), 8, 8, F.lit("wrong"), plain, None),
        (4, F.col("file"), 11, 11, line(11), F.when(five, F.lit("        System.exit(1);")).otherwise(line(11)), None),
        (5, F.lit("src/test/java/T.java"), 1, 1, F.lit("x"), F.lit("y"), None),
        (6, F.col("file"), 20, 1_000_000, line(20), plain, None),
        (7, F.col("file"), 20, 20, line(20), plain, None),
        (8, F.lit("src/main/java/Other.java"), 1, 1, F.lit("x"), F.lit("y"), None),
        (9, F.col("file"), 1, 1, line(1), F.lit("package com.acme.other;"), None),
    ]
    more = F.col("case_id") % 4 != 0
    made = F.array_compact(F.array(*[
        F.when(more if cond is None else cond, F.struct(
            F.lit(i).cast("bigint").alias("edit_index"), f.alias("file"), F.lit(s).cast("bigint").alias("start_line"),
            F.lit(e).cast("bigint").alias("end_line"), old.alias("old_code"), new.alias("new_code")))
        for i, f, s, e, old, new, cond in rows
    ]))
    return c.select(
        "case_id", F.when(F.col("case_id") % 7 == 0, "insufficient_evidence").otherwise("proposed").alias("proposal_status"),
        F.explode(made).alias("e"),
    ).select("case_id", "proposal_status", "e.*")


# -------------------------------------------------------------------- gold files
SENTENCE = r"[.\n]+\s*"


def expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, file): documents of an item's repository that share a sentence with it."""
    def sentences(df, key, repo):
        return df.select(key, repo.alias("repo"), F.explode(F.array_distinct(F.split("text", SENTENCE))).alias("s")).where("s <> ''")

    docs = sentences(spread(table(spark, sf_dir, "documents")), "doc_id", F.col("source"))
    items = sentences(table(spark, sf_dir, "benchmark"), "item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    from evidentia.session import broadcast_if_small

    return docs.join(broadcast_if_small(items), ["repo", "s"]).select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("docs/d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".yml")).alias("file"),
    ).distinct()
