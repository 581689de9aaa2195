"""The line-by-line lexical channel.

A search term occurs in a line exactly when it occurs inside one of the runs of
non-blank characters (or of lower-case letters and digits, for normalised
terms) that the line consists of.  The index inverts the runs: a row says in
which of 64 neighbouring lines of a file a run stands, as the bits of a number.
Terms are matched against the distinct runs of a block of files, by their first characters;
the lines of a term in a file are then the union of its runs' bits.  Counts and
scores are taken from the bits, so no line is ever paired with a term unless
the lines themselves are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from evidentia.functions import text as tx
from evidentia.operators import blocks
from evidentia.operators.ranking import top_k
from evidentia.session import broadcast_if_small, materialize, new_table_path, rows_if_small

# Read alike by Spark and Python.
NON_BLANK_RUN = r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NORMAL_RUN = "[a-z0-9]+"
# Terms that share one number of a bit set; runs of a folder of the index.
BITS = 60
BUCKET_RUNS = 50_000
# Text of a block of the line index, what a file counts beside its text, and the tasks that the blocks are dealt to.
BLOCK_BYTES = 1024 * 1024
FILE_BYTES = 256
ROW_GROUP_BYTES = 16 * 1024 * 1024
MAX_TASKS = 2000


def classified_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, repo, term, kind, weight, needle): distinct terms of a raw query text."""
    raw = queries.select(
        "query_id", "repo",
        F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "))).alias("term"),
    )
    return (
        raw.withColumn("kind", tx.term_kind(F.col("term")))
        .where(F.col("kind").isNotNull())
        .withColumn("weight", tx.term_weight(F.col("kind")))
        .withColumn(
            "needle",
            F.when(F.col("kind") == "annotation", F.substr("term", F.lit(2))).otherwise(F.col("term")),
        )
    )


def normal_query_terms(queries: DataFrame, min_chars: int = 1, max_chars: int | None = None) -> DataFrame:
    """The same shape for queries whose ``terms`` are already normalised; terms of any length unless limits are given."""
    terms = queries.select("query_id", "repo", F.posexplode("terms").alias("term_no", "term")).select(
        "query_id", "repo", "term", F.lit("plain").alias("kind"), F.lit(1.0).alias("weight"),
        F.col("term").alias("needle"), "term_no",
    ).where(F.length("term") >= min_chars)
    return terms if max_chars is None else terms.where(F.length("term") <= max_chars)


def _grams(run: Column) -> Column:
    """Distinct pieces of a run of one to three characters."""
    def pieces(size: int) -> Column:
        return F.when(
            F.length(run) >= size,
            F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substring(run, i, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(pieces(1), pieces(2), pieces(3)))


@dataclass
class Lines:
    """A stored line index, by blocks of the files of a repository; no two repositories share a block.

    ``blocks`` has one row per (repo, block): its ``files`` in order, and ``runs``, where each of its runs
    stands, as (slot, grp, bits).  A slot counts into the files; the bits are the lines ``64 * grp + 1`` to
    ``64 * grp + 64`` of that file.  ``tasks`` is how many tasks the blocks are dealt to.
    """

    blocks: DataFrame
    tasks: int

    @property
    def rows(self) -> DataFrame:
        """One row per (repo, block, run)."""
        return self.blocks.select("repo", "block", F.inline("runs"))

    @property
    def names(self) -> DataFrame:
        return self.blocks.select("repo", "block", "files")


def build_lines(files: DataFrame, run_pattern: str = NON_BLANK_RUN) -> Lines:
    """Writes the line index of (repo, file, content); ``run_pattern`` is one that Spark and Python read alike.

    The texts are shuffled once, to the task of their block, which packs the block's runs into one row.
    """
    spark = files.sparkSession
    room = F.coalesce(F.octet_length("content"), F.lit(0)) + FILE_BYTES
    sizes = materialize(files.groupBy("repo").agg(F.ceil(F.sum(room) / BLOCK_BYTES).cast("long").alias("blocks")), "line-blocks")
    before = F.coalesce(F.sum("blocks").over(Window.orderBy("repo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sizes.withColumn("first", before)  # a row per repository
    # no fewer than a join would take, or it would deal the rows again
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, sizes.agg(F.sum("blocks")).first()[0] or 1))
    dealt = files.select("repo", "file", "content").join(broadcast_if_small(numbered), "repo").withColumn("block", F.col("first") + F.pmod(F.xxhash64("file"), "blocks")).drop("blocks", "first")
    slot = (F.dense_rank().over(Window.partitionBy("block").orderBy("file")) - 1).alias("slot")
    placed = dealt.repartition(tasks, "block").select("repo", "block", slot, "file", "content")
    kind = StructType([StructField("repo", files.schema["repo"].dataType), *StructType.fromDDL(
        "block long, files array<string>, runs array<struct<run:string,found:array<struct<slot:int,grp:int,bits:long>>>>").fields])
    path = new_table_path(spark, "line-runs")
    # a block is one row of about its text's size, so few rows are read at once
    placed.mapInArrow(blocks.packer(run_pattern, tx.LINE_BREAK), kind).write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
    return Lines(spark.read.parquet(path), tasks)


def _numbered_needles(terms: DataFrame) -> DataFrame:
    return materialize(terms.select("needle").distinct().withColumn("needle_no", F.monotonically_increasing_id()), "needles")


def needle_bits(index: Lines, terms: DataFrame, needles: DataFrame) -> DataFrame:
    """(repo, block, slot, grp, needle_no, bits): in which lines of each 64 a needle stands.

    Partitioned by block, which every later step groups by: index rows move once, as arrays,
    to the task of their block.  A needle meets the runs that hold its first characters, and the bits
    of its runs are united where they lie.
    """
    by = ["repo"] if "repo" in terms.columns else []  # a needle counts in the repositories of its queries only
    keyed = terms.select(*by, "needle").distinct().join(broadcast_if_small(needles), "needle").where("needle <> ''")
    keyed = materialize(keyed.withColumn("gram", F.left("needle", F.lit(3))), "needle-grams")
    pieces = index.rows.repartition(index.tasks, "block").select("repo", "block", "run", "found", F.explode(_grams(F.col("run"))).alias("gram"))
    met = pieces.join(broadcast_if_small(keyed), [*by, "gram"]).where(F.contains("run", F.col("needle")))
    return met.select("repo", "block", "needle_no", F.inline("found")).groupBy("repo", "block", "slot", "grp", "needle_no").agg(F.bit_or("bits").alias("bits"))


def _with_files(rows: DataFrame, index: Lines) -> DataFrame:
    """Names the files of (block, slot), and their repository; the join key is the partition of the rows, which stay where they are."""
    names = index.names.drop("repo") if "repo" in rows.columns else index.names
    named = rows.join(names.hint("shuffle_hash"), "block")
    return named.withColumn("file", F.get("files", F.col("slot"))).drop("files", "slot")


def _lines_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per set bit, with ``line_no``."""
    each = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return rows.select(*columns, "grp", F.explode(each).alias("_i")).select(*columns, (F.col("grp").cast("long") * 64 + F.col("_i") + 1).alias("line_no"))


def needle_lines(index: Lines, terms: DataFrame) -> DataFrame:
    """(repo, file, line_no, needle): which needle occurs in which line, exactly."""
    needles = _numbered_needles(terms)
    bits = _with_files(needle_bits(index, terms, needles), index).join(broadcast_if_small(needles), "needle_no")
    return _lines_of(bits, "repo", "file", "needle")


def _line_sums(index: Lines, terms: DataFrame, *more: Column) -> DataFrame:
    """(query_id, block, slot, line_no, score) of every line with a match, and aggregates of the matched terms' columns.

    Numbers only: files are named when the lines are chosen.
    """
    needles = _numbered_needles(terms)
    lines = _lines_of(needle_bits(index, terms, needles), "repo", "block", "slot", "needle_no")
    used = materialize(terms.join(broadcast_if_small(needles), "needle").drop("needle"), "line-terms")
    return lines.join(broadcast_if_small(used), ["repo", "needle_no"]).groupBy("query_id", "block", "slot", "line_no").agg(F.sum("weight").alias("score"), *more)


def _term_bits(terms: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The terms with a bit in one of the named columns, the words of each query to spell them, and the columns.

    Sixty terms share a number, and the longest query says how many numbers there are.
    """
    terms = materialize(terms, "lexical-terms")
    longest = terms.agg(F.max("term_no")).first()[0] or 0
    sets = [f"_bits{i}" for i in range(longest // BITS + 1)]
    bits = [F.when(F.floor(F.col("term_no") / BITS) == i, F.expr(f"shiftleft(1L, CAST(term_no % {BITS} AS INT))")).otherwise(F.lit(0).cast("long"))
            .alias(name) for i, name in enumerate(sets)]
    spelled = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "term_no"))).alias("_terms"))
    return terms.select("query_id", "repo", "needle", "weight", *bits), spelled, sets


def _spelled_terms(sets: list[str]) -> Column:
    words = F.array(*sets)
    used = F.filter("_terms", lambda t: F.getbit(F.get(words, F.floor(t["term_no"] / BITS).cast("int")), (t["term_no"] % BITS).cast("int")) == 1)
    return F.transform(used, lambda t: t["term"])


def _scored(index: Lines, terms: DataFrame, n: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The lines of ``_line_sums`` with the matched terms as bits, the words to spell them, and the columns of the bits."""
    if "term_no" not in terms.columns:
        terms = terms.withColumn("term_no", F.row_number().over(Window.partitionBy("query_id").orderBy("term")) - 1)
    used, spelled, sets = _term_bits(terms)
    sums = _line_sums(index, used, *[F.bit_or(name).alias(name) for name in sets])
    return first_matching_lines(sums, n), spelled, sets


def _with_terms(rows: DataFrame, spelled: DataFrame, sets: list[str]) -> DataFrame:
    return rows.join(broadcast_if_small(spelled), "query_id").withColumn("terms", _spelled_terms(sets)).drop("_terms", *sets)


def scored_lines(index: Lines, terms: DataFrame, lines_per_file: int | None = None) -> DataFrame:
    """Score and matched terms of every (query, file, line) with a match, or of the first ``lines_per_file`` of each query and file.

    Terms are collected as bits, which aggregate in Spark's hash aggregate, and spelled out afterwards.
    """
    sums, spelled, sets = _scored(index, terms, lines_per_file)
    return _with_terms(_with_files(sums, index), spelled, sets)


def first_matching_lines(scored: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` matching lines of each (query, file); all of them for None."""
    if n is None:
        return scored
    # with the block, rows stay where they are; a slot of a block is a file
    keys = ["query_id", "block", "slot"] if "slot" in scored.columns else [c for c in ("query_id", "repo", "block", "file") if c in scored.columns]
    return top_k(scored, keys, [F.asc("line_no")], n, "_hit").drop("_hit")


def search_lines(files: DataFrame, queries: DataFrame, k: int = 10, lines_per_file: int | None = None, index: Lines | None = None) -> DataFrame:
    """The line search: the best ``k`` lines of each raw query text.

    Each block gives its best ``k`` lines, with their terms as bits that are spelled for the final ones only.  Terms that
    are few enough to be sent to every task meet the blocks where they lie; others, and those of searches with a limit, meet
    them by joins, where lines are numbers until they are chosen (the slots of a block are in the order of its files).
    """
    index = build_lines(files) if index is None else index
    terms = classified_terms(queries)
    terms = terms.withColumn("term_no", F.row_number().over(Window.partitionBy("query_id").orderBy("term")) - 1)
    used, spelled, sets = _term_bits(terms)
    # an item that is no query of its own has no lines
    rows = None if lines_per_file is not None else rows_if_small(used.where("query_id IS NOT NULL AND needle IS NOT NULL"))
    if rows is not None:
        kinds = {f.name: f.dataType for f in used.schema.fields}
        kind = StructType([StructField("query_id", kinds["query_id"]), StructField("repo", kinds["repo"]), *StructType.fromDDL(
            "block long, file string, line_no long, score double, " + ", ".join(f"{name} long" for name in sets)).fields])
        search = blocks.line_searcher([tuple(r) for r in rows], k, len(sets), to_arrow_schema(kind))
        named = index.blocks.select("repo", "block", "files", "runs").mapInArrow(search, kind)
    else:
        hits = first_matching_lines(_line_sums(index, used, *[F.bit_or(name).alias(name) for name in sets]), lines_per_file)
        near = top_k(hits, ["query_id", "block"], [F.desc("score"), F.asc("slot"), F.asc("line_no")], k, "_near").drop("_near")
        named = _with_files(near, index)
    best = top_k(named, ["query_id"], [F.desc("score"), F.asc("file"), F.asc("line_no")], k)
    return _with_terms(best, spelled, sets)


def file_totals(index: Lines, terms: DataFrame, *more: Column) -> DataFrame:
    """Per (query, repo, file): the score of all its matching lines, their span, and aggregates of the matched terms' columns.

    A needle's lines in a file are counted, and its first and last found, before queries meet it.
    """
    low, high = F.expr("bit_count((bits & -bits) - 1)"), F.length(F.bin("bits")) - 1
    low = F.when(F.col("bits") == F.lit(-(1 << 63)), 63).otherwise(low)
    first, needles = F.col("grp").cast("long") * 64, _numbered_needles(terms)
    by_needle = needle_bits(index, terms, needles).groupBy("repo", "block", "slot", "needle_no").agg(
        F.sum(F.bit_count("bits")).alias("n"), F.min(first + low + 1).alias("start_line"), F.max(first + high + 1).alias("end_line"))
    used = materialize(terms.join(broadcast_if_small(needles), "needle").drop("needle"), "file-terms")
    totals = by_needle.join(broadcast_if_small(used), ["repo", "needle_no"]).groupBy("query_id", "repo", "block", "slot").agg(
        F.sum(F.col("weight") * F.col("n")).alias("score"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), *more)
    return _with_files(totals, index).drop("block")


def file_scores(hits: DataFrame) -> DataFrame:
    """Per (query, file): total score, the span of matching lines, all matched terms."""
    return (
        hits.groupBy("query_id", "repo", "file")
        .agg(
            F.sum("score").alias("score"),
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("matched_terms"),
        )
        .withColumn(
            "chunk_id",
            tx.chunk_id(F.col("file"), F.lit("file_window"), F.lit(None), F.col("start_line"), F.col("end_line")),
        )
    )


def _block_file_scores(index: Lines, rows: list, terms: DataFrame, k: int) -> DataFrame:
    """The best ``k`` files of each task's blocks: a block is one row, scored where it lies, so nothing else moves."""
    kinds = {f.name: f.dataType for f in terms.schema.fields}
    kind = StructType([StructField("query_id", kinds["query_id"]), StructField("repo", kinds["repo"]), *StructType.fromDDL(
        "file string, score double, start_line long, end_line long, matched_terms array<string>").fields])
    return index.blocks.select("repo", "files", "runs").mapInArrow(blocks.searcher([tuple(r) for r in rows], k, to_arrow_schema(kind)), kind)


def _normal_file_scores(index: Lines, terms: DataFrame, k: int, lines_per_file: int | None) -> DataFrame:
    """Top files for normalised queries, with their matched terms.

    Terms that are few enough to be sent to every task meet the blocks there; others, and those of
    searches with a limit, meet them by joins, with matched terms as a bit set that is spelled out for the winners only.
    """
    order = [F.desc("score"), F.asc("file"), F.asc("start_line")]
    columns = ["query_id", "repo", "term", "needle", "weight", "term_no"]
    rows = None if lines_per_file is not None else rows_if_small(terms.select(*columns).where("query_id IS NOT NULL AND needle IS NOT NULL"))
    if rows is not None:
        best = top_k(_block_file_scores(index, rows, terms, k), ["query_id"], order, k)
    else:
        used_terms, spelled, sets = _term_bits(terms)
        any_bits = [F.bit_or(name).alias(name) for name in sets]
        if lines_per_file is None:
            per_file = file_totals(index, used_terms, *any_bits)
        else:
            per_file = _with_files(first_matching_lines(_line_sums(index, used_terms, *any_bits), lines_per_file), index).groupBy("query_id", "repo", "file").agg(
                F.sum("score").alias("score"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), *any_bits)
        best = top_k(per_file, ["query_id"], order, k).join(spelled, "query_id").withColumn("matched_terms", _spelled_terms(sets))
    return best.select(
        "query_id", "repo", "file", "score", "start_line", "end_line", "matched_terms",
        tx.chunk_id(F.col("file"), F.lit("file_window"), F.lit(None), F.col("start_line"), F.col("end_line")).alias("chunk_id"),
        "rank",
    )


def lexical_search(
    files: DataFrame, terms: DataFrame, k: int = 10, run_pattern: str = NON_BLANK_RUN, lines_per_file: int | None = None, index: Lines | None = None,
) -> DataFrame:
    """Top ``k`` files per query, by all matching lines or the first ``lines_per_file``.

    Terms of ``normal_query_terms`` and of ``classified_terms`` give the same columns.  ``index`` is the
    stored index of ``build_lines`` with the same pattern; without it, it is made from ``files``.
    """
    index = build_lines(files, run_pattern) if index is None else index
    if "term_no" in terms.columns:
        return _normal_file_scores(index, terms, k, lines_per_file)
    hits = file_scores(scored_lines(index, terms, lines_per_file))
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("file"), F.asc("start_line")], k)
