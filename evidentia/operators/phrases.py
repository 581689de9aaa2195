"""Which texts hold which of many terms, from one scan of the texts.

The scan writes the runs of letters and digits of every text, each with its neighbours and the
characters between.  A term of one run is looked up among the distinct runs, by its first
characters.  A phrase is looked up by the pairs it is made of: the inner run with the gaps on
both sides and the edge characters beyond is one key, so a phrase of frequent words is as rare
as its words are side by side, and no text has to be searched again.  A longer phrase holds
where all its keys stand one after another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import lexical
from evidentia.operators.stored import Bucketed, bucket_count
from evidentia.session import broadcast_if_light, broadcast_if_small, computed_once, materialize

RUN = "[a-z0-9]+"
_GAP = "[a-z0-9]+([^a-z0-9]*)"
#: Edge characters of the outer runs in a key.
EDGE = 2


def _windows(low: DataFrame) -> DataFrame:
    """Every run of each text with its place, its neighbours and the gaps between (null beyond the ends)."""
    split = computed_once(low, _runs=F.regexp_extract_all("content", F.lit(RUN), 0), _gaps=F.regexp_extract_all("content", F.lit(_GAP), 1))
    return split.select("repo", "file", F.inline(F.transform("_runs", lambda run, i: F.struct(
        i.alias("at"), F.get("_runs", i - 1).alias("before"), F.get("_gaps", i - 1).alias("gap"), run.alias("run"),
        F.get("_gaps", i).alias("next_gap"), F.get("_runs", i + 1).alias("after")))))


@dataclass
class Phrases:
    """A stored phrase index of (repo, file): ``runs`` (repo, file, at, before, gap, run, next_gap, after), and the ``grams`` of the distinct runs."""

    runs: DataFrame
    grams: Bucketed
    texts: DataFrame


def build(texts: DataFrame) -> Phrases:
    """One scan of (repo, file, content); case is folded."""
    low = texts.select("repo", "file", F.lower("content").alias("content"))
    runs = materialize(_windows(low), "phrase-runs")
    distinct = materialize(runs.select("run").distinct(), "phrase-vocabulary")
    grams = distinct.select(F.explode(lexical._grams(F.col("run"))).alias("gram"), "run")
    return Phrases(runs, Bucketed.write(grams, "gram", bucket_count(distinct.count(), lexical.BUCKET_RUNS), ["run"], ["gram"], "phrase-grams"), low)


def _triple_key(before: Column, gap: Column, run: Column, next_gap: Column, after: Column) -> Column:
    return F.concat(F.right(before, F.lit(1)), gap, run, next_gap, F.left(after, F.lit(1)))


def _single(index: Phrases, terms: DataFrame) -> DataFrame:
    numbered = materialize(terms.select(F.col("core").alias("needle"), F.monotonically_increasing_id().alias("needle_no")), "phrase-needles")
    keyed = materialize(numbered.withColumn("gram", F.left("needle", F.lit(3))), "phrase-needle-grams")
    matches = index.grams.of(keyed).join(broadcast_if_small(keyed), "gram").where(F.contains("run", F.col("needle"))).select("run", F.col("needle").alias("core"))
    matches = materialize(matches, "phrase-matches")
    return index.runs.select("repo", "file", "run").join(broadcast_if_light(matches, "run", "core"), "run").select("repo", "file", "core")


def _pairs(index: Phrases, terms: DataFrame) -> DataFrame:
    """Phrases of two runs, by the characters around their gap."""
    a, gap, b = (F.get("p.runs", F.lit(0)), F.get("p.gaps", F.lit(0)), F.get("p.runs", F.lit(1)))
    found = None
    for left in range(1, EDGE + 1):  # an outer run may be shorter than the edge
        for right in range(1, EDGE + 1):
            keyed = terms.select("core", a.alias("a"), gap.alias("g"), b.alias("b")).where((F.least(F.length("a"), F.lit(EDGE)) == left) & (F.least(F.length("b"), F.lit(EDGE)) == right))
            keyed = broadcast_if_small(keyed.withColumn("key", F.concat(F.right("a", F.lit(left)), "g", F.left("b", F.lit(right)))))
            key = F.concat(F.right("run", F.lit(left)), "next_gap", F.left("after", F.lit(right)))
            hits = index.runs.where("after IS NOT NULL").select("repo", "file", "run", "after", key.alias("key")).join(keyed, "key")
            hits = hits.where(F.endswith("run", F.col("a")) & F.startswith("after", F.col("b"))).select("repo", "file", "core")
            found = hits if found is None else found.union(hits)
    return found


def _longer(index: Phrases, terms: DataFrame) -> DataFrame:
    """Phrases of three runs or more: each inner run with its gaps and edges is a key; all must stand in a row."""
    runs, gaps = F.col("p.runs"), F.col("p.gaps")
    inner = F.transform(F.sequence(F.lit(1), F.size(runs) - 2), lambda i: F.struct(
        i.alias("o"), (i == 1).alias("first"), (i == F.size(runs) - 2).alias("last"), F.get(runs, i - 1).alias("a"), F.get(runs, i + 1).alias("c"),
        _triple_key(F.get(runs, i - 1), F.get(gaps, i - 1), F.get(runs, i), F.get(gaps, i), F.get(runs, i + 1)).alias("key")))
    keyed = terms.select("core", (F.size(runs) - 2).alias("parts"), F.inline(inner))
    key = _triple_key(*(F.col(c) for c in ("before", "gap", "run", "next_gap", "after")))
    here = index.runs.where("before IS NOT NULL AND after IS NOT NULL").select("repo", "file", "at", "before", "after", key.alias("key")).join(broadcast_if_small(keyed), "key")
    starts = F.when(F.col("first"), F.endswith("before", F.col("a"))).otherwise(F.col("before") == F.col("a"))
    ends = F.when(F.col("last"), F.startswith("after", F.col("c"))).otherwise(F.col("after") == F.col("c"))
    hits = here.where(starts & ends)
    whole = hits.where("parts = 1").select("repo", "file", "core")
    several = hits.where("parts > 1").groupBy("repo", "file", "core", "parts", (F.col("at") - F.col("o")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return whole.union(several.where("n = parts").select("repo", "file", "core"))


def holding(index: Phrases, terms: DataFrame) -> DataFrame:
    """(repo, file, term): which text contains which term, anywhere, case folded.

    Terms may begin or end with other characters, or have no letters and digits at all: the first are
    found by what is between and then looked for in the texts found, the second in all texts.
    """
    wanted = terms.select(F.lower("term").alias("term")).distinct().where("term <> ''")
    core = F.regexp_extract("term", r"(?s)^[^a-z0-9]*(.*?)[^a-z0-9]*$", 1)
    wanted = materialize(wanted.withColumn("core", core), "phrase-terms")
    cores = wanted.where("core <> ''").select("core").distinct().withColumn(
        "p", F.struct(F.regexp_extract_all("core", F.lit(RUN), 0).alias("runs"), F.regexp_extract_all("core", F.lit(_GAP), 1).alias("gaps")))
    cores = materialize(cores.withColumn("m", F.size("p.runs")), "phrase-cores")
    sizes = {r[0] for r in cores.select(F.least("m", F.lit(3))).distinct().collect()}  # one, two, three or more
    found = [part(index, cores.where(which)) for m, part, which in ((1, _single, "m = 1"), (2, _pairs, "m = 2"), (3, _longer, "m > 2")) if m in sizes]
    empty = index.texts.select("repo", "file", F.lit("").alias("core")).limit(0)
    hits = empty
    for part in found:
        hits = hits.union(part)
    hits = hits.distinct().join(broadcast_if_small(wanted), "core")
    exact = hits.where("core = term").select("repo", "file", "term")
    loose = wanted.where("core <> term AND core <> ''")
    if not loose.isEmpty():
        maybe = hits.where("core <> term").select("repo", "file", "term")
        exact = exact.union(maybe.join(index.texts, ["repo", "file"]).where(F.contains("content", F.col("term"))).select("repo", "file", "term"))
    signs = wanted.where("core = ''").select("term")
    if not signs.isEmpty():
        plain = F.regexp_replace("content", "[a-z0-9]+", "a")  # what is left of a text is short, and holds a sign term if the text does
        pieces = index.texts.select("repo", "file", F.explode(F.array_distinct(F.split(plain, "a"))).alias("piece")).where("piece <> ''")
        distinct = materialize(pieces.select("piece").distinct(), "phrase-pieces")
        grams = distinct.select("piece", F.explode(F.array_distinct(F.split("piece", ""))).alias("gram"))
        keyed = signs.withColumn("gram", F.left("term", F.lit(1)))
        matched = grams.join(broadcast_if_small(keyed), "gram").where(F.contains("piece", F.col("term"))).select("piece", "term")
        exact = exact.union(pieces.join(matched, "piece").select("repo", "file", "term").distinct())
    return exact


def identifier_sets(files: DataFrame, pattern: str, min_chars: int = 1, only: DataFrame | None = None) -> DataFrame:
    """(identifier, file, files): the distinct identifiers of a corpus, each with its first file and in how many files it stands; ``only`` (identifier) are those asked for."""
    each = files.select("repo", "file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 0))).alias("identifier"))
    if only is not None:
        each = each.join(broadcast_if_small(only), "identifier", "left_semi")
    name = F.concat_ws("/", "repo", "file")
    return (each.where(F.length("identifier") >= min_chars).groupBy("identifier")
            .agg(F.min(name).alias("file"), F.count(F.lit(1)).alias("files")))


def copied_identifiers(fresh: DataFrame, known: DataFrame, pattern: str, min_chars: int = 1, allowed: DataFrame | None = None) -> DataFrame:
    """(identifier, fresh_file, fresh_files, known_file, known_files): identifiers that stand in both corpora.

    The known corpus is reduced to its distinct identifiers, and only those of the fresh one are sorted by
    identifier that are among them; ``allowed`` (identifier) are words that both may use, such as those of a
    language or a framework.
    """
    b = materialize(identifier_sets(known, pattern, min_chars), "known-identifiers")
    a = identifier_sets(fresh, pattern, min_chars, b.select("identifier"))
    both = a.select("identifier", F.col("file").alias("fresh_file"), F.col("files").alias("fresh_files")).join(
        b.select("identifier", F.col("file").alias("known_file"), F.col("files").alias("known_files")), "identifier")
    return both if allowed is None else both.join(allowed.select("identifier").distinct(), "identifier", "left_anti")
