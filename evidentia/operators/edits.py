"""Proposed edits: path and code policies, validation, application and diffs.

A proposal is a handful of edits, so the edits of one (case, file) form a
short array; they meet the file's text once and everything about them is
decided inside that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.operators import java
from evidentia.operators.intervals import range_arrays, with_containment
from evidentia.session import computed_once

# Where edits may go.
ALLOWED_ROOTS = r"^src/main/(?:java|resources)/"
FORBIDDEN_PARTS = [".git", "benchmark", "target", "artifacts"]
APPLY_FORBIDDEN_PARTS = [".git", "target", "build", "node_modules", "artifacts", "benchmark", "__pycache__"]
# end fixed values


def _absolute(path: Column) -> Column:
    return path.rlike(r"^/|^[A-Za-z]:/")


def path_allowed(path: Column) -> Column:
    """Edit paths a proposal may name."""
    p = tx.normal_path(path)
    parts = tx.path_parts(p)
    low = F.lower(p)
    return (
        (p != "") & ~_absolute(p)
        & ~F.exists(parts, lambda x: x.isin("..", *FORBIDDEN_PARTS) | x.rlike(r"^\.env(?:\.|\z)"))
        & ~F.endswith(low, F.lit(".md"))
        & ~F.contains(F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")), F.lit("/src/test/"))
        & low.rlike(ALLOWED_ROOTS)
    )


def apply_path_allowed(path: Column) -> Column:
    """The second check before anything is written: parts compare without case."""
    p = tx.normal_path(path)
    parts = F.transform(tx.path_parts(p), F.lower)
    low = F.lower(p)
    return (
        (p != "") & ~_absolute(p)
        & ~F.exists(parts, lambda x: x.isin("..", *APPLY_FORBIDDEN_PARTS) | x.rlike(r"^\.env(?:\.|\z)"))
        & ~F.endswith(low, F.lit(".md"))
        & low.rlike(ALLOWED_ROOTS)
    )


def dangerous_families(code: Column) -> Column:
    return F.array_compact(F.array(*[F.when(code.rlike(p), F.lit(n)) for n, p in V.DANGEROUS_CODE]))


def is_dangerous(code: Column) -> Column:
    out = F.lit(False)
    for _name, pattern in V.DANGEROUS_CODE:
        out = out | code.rlike(pattern)
    return out


def is_sensitive_diff(diff: Column) -> Column:
    return diff.rlike(V.SENSITIVE_DIFF) | diff.rlike(V.WINDOWS_DRIVE_PATH)


def same_code(a: Column, b: Column) -> Column:
    """Equal up to line-end style and any number of final line ends."""
    def bare(x: Column) -> Column:
        return F.regexp_replace(tx.canonical_newlines(x), r"\n+\z", "")

    return bare(a) == bare(b)


def same_code_strict(a: Column, b: Column) -> Column:
    """Equal up to line-end style and one final line end on either side."""
    def cut(x: Column) -> Column:
        return F.regexp_replace(x, r"\n\z", "")

    x, y = tx.canonical_newlines(a), tx.canonical_newlines(b)
    return (x == y) | (cut(x) == y) | (x == cut(y))


def is_blank(x: Column) -> Column:
    return x.rlike(r"(?U)^\s*$")


def code_slice(lines: Column, start: Column, end: Column) -> Column:
    n = F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0)).cast("int")
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), n), "\n")


def replacement_lines(code: Column) -> Column:
    return F.split(F.regexp_replace(tx.canonical_newlines(code), r"\n\z", ""), "\n", -1)


def _in_import_section(lines: Column, end: Column) -> Column:
    """Only package, imports, comments and blanks up to ``end``."""
    return F.forall(
        F.slice(lines, F.lit(1), F.greatest(end, F.lit(0)).cast("int")),
        lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")).rlike(r"^(?:$|//|/\*|\*|package )") | x.rlike(java._IMPORT),
    )


def uses(code: Column, symbol: Column) -> Column:
    return F.regexp_like(code, F.concat(F.lit(r"\b\Q"), symbol, F.lit(r"\E\b")))


def composed(lines: Column, edits: Column) -> Column:
    """Lines with non-overlapping edits applied from the bottom up."""
    down = F.reverse(F.array_sort(F.transform(edits, lambda e: F.struct(
        e["start_line"].alias("s"), e["end_line"].alias("e"), e["new_code"].alias("c")))))

    def put(acc: Column, e: Column) -> Column:
        tail = F.greatest(F.size(acc) - e["e"], F.lit(0)).cast("int")
        return F.concat(
            F.slice(acc, F.lit(1), (e["s"] - 1).cast("int")),
            replacement_lines(e["c"]),
            F.slice(acc, (e["e"] + 1).cast("int"), tail),
        )

    return F.aggregate(down, lines, put)


# ------------------------------------------------------------------- evidence
def validated_evidence(
    refs: DataFrame, snippets: DataFrame, files: DataFrame, max_candidates: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """References a repair may build on: allowed, inside a retrieved range, with real content.

    ``max_candidates`` takes the first candidates only, ``max_chars`` no longer
    content; by default neither limits.
    """
    used = refs if max_candidates is None else refs.where(F.col("candidate_index") < max_candidates)
    named = used.where(path_allowed(F.col("file"))).withColumn("file", tx.normal_path(F.col("file")))
    sound = named.where((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    usable = snippets.where((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    inside = with_containment(sound, usable, ["case_id", "file"]).where("contained")
    ranges = inside.groupBy("case_id", "file", "start_line", "end_line").agg(
        F.min(F.struct("candidate_index", "evidence_index")).alias("_first")
    )
    content = code_slice(tx.code_lines(F.col("content")), F.col("start_line"), F.col("end_line"))
    return (
        ranges.join(files.select("case_id", "file", "content"), ["case_id", "file"])
        .withColumn("content", content)
        .where((F.length("content") >= 1) & (F.lit(True) if max_chars is None else F.length("content") <= max_chars))
        .select("case_id", "file", "start_line", "end_line", "content", "_first.*")
    )


# ----------------------------------------------------------------- validation
_EDIT_FIELDS = ["edit_index", "proposal_status", "start_line", "end_line", "old_code", "new_code"]


def checked_edits(edits: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per (case, file) with ``_edits``: each edit with its first rejection reason."""
    keys = ["case_id", "file"]
    edits = edits.withColumn("file", tx.normal_path(F.col("file")))
    evidence = evidence.withColumn("file", tx.normal_path(F.col("file"))).where(
        (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    )
    # edits, evidence ranges and the file meet once by case and file; the rest is decided in that row
    grouped = edits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*_EDIT_FIELDS))).alias("_given"))
    met = grouped.join(range_arrays(evidence, keys), keys, "left").join(files.select(*keys, "content"), keys, "left")

    def placed(e: Column) -> Column:
        supported = F.exists("_ranges", lambda r: (r["start_line"] <= e["end_line"]) & (r["end_line"] >= e["start_line"]))
        return F.struct(
            *[e[f].alias(f) for f in _EDIT_FIELDS], F.coalesce(supported, F.lit(False)).alias("_supported"),
            F.when(F.col("_ranges").isNotNull(), F.lit(True)).alias("_backed"), path_allowed(F.col("file")).alias("_allowed"))

    met = met.withColumn("_raw", F.transform("_given", placed)).drop("_given", "_ranges")
    met = computed_once(met, _lines=tx.code_lines(F.col("content")))
    lines = F.col("_lines")

    def look(e: Column) -> Column:
        actual = code_slice(lines, e["start_line"], e["end_line"])
        imports = (
            F.startswith(F.col("file"), F.lit("src/main/java/"))
            # the new code is short; the lines an edit names may be the whole file
            & java.is_import_only(e["new_code"]) & java.is_import_only(actual)
        )
        return F.struct(e.alias("e"), actual.alias("actual"), F.coalesce(imports, F.lit(False)).alias("imports"))

    def judge(x: Column) -> Column:
        e, actual = x["e"], x["actual"]
        exempt = x["imports"] & java.is_import_only(e["old_code"]) & _in_import_section(lines, e["end_line"])
        reason = (
            F.when(~e["_allowed"], "path_not_allowed")
            .when(e["proposal_status"] != "proposed", "proposal_not_proposed")
            .when(e["_backed"].isNull(), "file_not_in_validated_evidence")
            .when((e["start_line"] > e["end_line"]) | (e["start_line"] < 1), "line_range_invalid")
            .when(F.col("content").isNull(), "file_not_found")
            .when(e["end_line"] > F.size(lines), "line_range_invalid")
            .when(is_blank(e["old_code"]) | ~same_code(actual, e["old_code"]), "old_code_mismatch")
            .when(is_blank(e["new_code"]) | same_code(e["old_code"], e["new_code"]), "empty_or_unchanged_edit")
            .when(is_dangerous(e["new_code"]), "dangerous_new_code")
            .when(~e["_supported"] & ~exempt, "line_range_outside_evidence")
        )
        return F.struct(
            *[e[f].alias(f) for f in _EDIT_FIELDS], e["_supported"].alias("supported"),
            x["imports"].alias("imports"), reason.alias("reason"), F.lit(None).cast("string").alias("symbol"),
        )

    seen = computed_once(met, _seen=F.transform("_raw", look)).drop("_raw")
    return computed_once(seen, _judged=F.transform("_seen", judge)).drop("_seen")


def greedy_conflicts(judged: Column) -> Column:
    """Later edits give way to accepted earlier ones of the same file."""

    def step(acc: Column, e: Column) -> Column:
        twin = F.exists(acc, lambda a: a["reason"].isNull() & (a["start_line"] == e["start_line"])
                        & (a["end_line"] == e["end_line"]))
        clash = F.exists(acc, lambda a: a["reason"].isNull() & (a["start_line"] <= e["end_line"])
                         & (e["start_line"] <= a["end_line"]))
        reason = (
            F.when(e["reason"].isNotNull(), e["reason"])
            .when(twin, F.lit("duplicate_edit"))
            .when(clash, F.lit("conflicting_edit"))
        )
        return F.concat(acc, F.array(e.withField("reason", reason)))

    return F.aggregate(judged, F.slice(judged, 1, 0), step)


def _open(edits: Column) -> Column:
    return F.filter(edits, lambda e: e["reason"].isNull())


def _uses_any(code: Column, import_code: Column) -> Column:
    return F.exists(java.simple_imports(import_code), lambda s: uses(code, s))


def validate_edits(edits: DataFrame, files: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edit verdicts, import checks).

    Verdicts: case_id, file, edit_index, reason (null when accepted), symbol.
    Import checks: case_id, file, introduced, resolved, unresolved, status.
    """
    is_java = F.startswith(F.col("file"), F.lit("src/main/java/"))
    rows = computed_once(checked_edits(edits, files, evidence), _folded=greedy_conflicts(F.col("_judged")))
    folded = F.col("_folded")
    main = F.filter(_open(folded), lambda e: ~e["imports"])

    def justify(e: Column) -> Column:
        wanted = F.exists(main, lambda m: _uses_any(m["new_code"], e["new_code"]))
        reason = (
            F.when(e["reason"].isNotNull() | ~e["imports"], e["reason"])
            .when(F.size(main) == 0, F.lit("supporting_import_edit_not_justified"))
            .when(~wanted, F.lit("unrelated_import"))
        )
        return e.withField("reason", reason)

    rows = computed_once(
        rows.drop("_judged"), _imported=F.when(is_java, F.transform(folded, justify)).otherwise(folded)
    ).drop("_folded")
    left = _open(F.col("_imported"))
    changes = F.transform(left, lambda e: F.struct(e["old_code"].alias("old_code"), e["new_code"].alias("new_code")))
    rows = computed_once(
        rows,
        _left=F.size(left),
        _changes=changes,
        _old=F.array_join("_lines", "\n"),
        _new=F.array_join(composed(F.col("_lines"), left), "\n"),
    )
    check = java.import_check(F.col("_old"), F.col("_new"), F.col("_changes"))
    rows = computed_once(rows, _check=F.when(is_java & (F.col("_left") > 0), check))
    failed = F.coalesce(F.col("_check.status") == "fail", F.lit(False))

    def resolve(e: Column) -> Column:
        missing = F.filter(F.col("_check.unresolved"), lambda s: uses(e["new_code"], s))
        hit = failed & e["reason"].isNull() & ~e["imports"] & (F.size(missing) > 0)
        return e.withField("symbol", F.when(hit, F.get(missing, F.lit(0)))).withField(
            "reason", F.when(hit, F.lit("missing_required_import")).otherwise(e["reason"])
        )

    rows = computed_once(rows, _resolved=F.transform("_imported", resolve)).drop("_imported")
    still = F.filter(_open(F.col("_resolved")), lambda e: ~e["imports"])

    def support(e: Column) -> Column:
        wanted = F.exists(still, lambda m: _uses_any(m["new_code"], e["new_code"]))
        reason = (
            F.when(e["reason"].isNotNull() | ~e["imports"] | ~failed, e["reason"])
            .when(F.size(still) == 0, F.lit("supporting_import_edit_not_justified"))
            .when(~wanted, F.lit("missing_required_import"))
        )
        return e.withField("reason", reason)

    rows = rows.select("case_id", "file", "_check", F.transform("_resolved", support).alias("_final"))
    verdicts = rows.select("case_id", "file", F.explode("_final").alias("e")).select(
        "case_id", "file", *[f"e.{f}" for f in _EDIT_FIELDS], "e.reason", "e.symbol"
    )
    checks = rows.where(F.col("_check").isNotNull()).select("case_id", "file", "_check.*")
    return verdicts, checks


def proposal_summary(verdicts: DataFrame) -> DataFrame:
    """Per case: counts, sanitised status and whether the whole proposal passed."""
    accepted = F.count_if(F.col("reason").isNull())
    unsafe = F.bool_or(
        (F.coalesce(F.col("reason"), F.lit("")) == "dangerous_new_code")
        | (F.col("proposal_status") == "unsafe_to_propose")
    )
    total = F.count(F.lit(1))
    status = (
        F.when(unsafe, "unsafe_to_propose").when(accepted > 0, "proposed").otherwise("insufficient_evidence")
    )
    return verdicts.groupBy("case_id").agg(
        total.alias("original_edits"), accepted.alias("accepted_edits"), (total - accepted).alias("rejected_edits"),
        status.alias("status"), ((status == "proposed") & (accepted == total)).alias("passed"),
    )


def passed_edits(verdicts: DataFrame) -> DataFrame:
    """The edits of proposals that passed as a whole (a proposal is a handful of rows)."""
    w = Window.partitionBy("case_id")
    refused = F.col("reason").isNotNull() | (F.col("proposal_status") != "proposed")
    return verdicts.withColumn("_refused", F.max(refused).over(w)).where("not _refused").drop("_refused")


# ---------------------------------------------------------------- application
CONTEXT_LINES = 3
_CHANGE = "struct<s:int,old:array<string>,new:array<string>>"


def _equal_head(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1)


def _changes(lines: Column, edits: Column) -> Column:
    """array<struct<s, old, new>> in file order: 0-based start, replaced and new lines, without common ends."""
    raw = F.array_sort(F.transform(edits, lambda e: F.struct(
        (e["start_line"] - 1).cast("int").alias("s"), replacement_lines(e["new_code"]).alias("new"), e["end_line"].cast("int").alias("e"))))

    def trimmed(c: Column) -> Column:
        old = F.slice(lines, c["s"] + 1, F.greatest(c["e"] - c["s"], F.lit(0)))

        def after_head(x: Column) -> Column:
            head = F.struct((c["s"] + x["k"]).alias("s"), F.slice(x["old"], x["k"] + 1, F.size(x["old"])).alias("old"),
                            F.slice(x["new"], x["k"] + 1, F.size(x["new"])).alias("new"))

            def before_tail(y: Column) -> Column:
                tail = _equal_head(F.reverse(y["old"]), F.reverse(y["new"]))
                return tx.let(tail, lambda t: F.struct(
                    y["s"].alias("s"), F.slice(y["old"], F.lit(1), F.size(y["old"]) - t).alias("old"),
                    F.slice(y["new"], F.lit(1), F.size(y["new"]) - t).alias("new")))

            return tx.let(head, before_tail)

        both = F.struct(_equal_head(old, c["new"]).alias("k"), old.alias("old"), c["new"].alias("new"))
        return tx.let(both, after_head)

    def together(out: Column, c: Column) -> Column:
        """Changes that touch are one change."""
        last = F.try_element_at(out, F.lit(-1))
        both = F.struct(last["s"].alias("s"), F.concat(last["old"], c["old"]).alias("old"), F.concat(last["new"], c["new"]).alias("new"))
        touch = (F.size(out) > 0) & (last["s"] + F.size(last["old"]) == c["s"])
        return F.when(touch, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(c)))

    real = F.filter(F.transform(raw, trimmed), lambda c: (F.size(c["old"]) > 0) | (F.size(c["new"]) > 0))
    return F.aggregate(real, F.array().cast(f"array<{_CHANGE}>"), together)


def _range(start: Column, length: Column) -> Column:
    """A hunk header's range; ``start`` is 0-based."""
    first = F.when(length == 0, start).otherwise(start + 1).cast("string")
    return F.when(length == 1, first).otherwise(F.concat(first, F.lit(","), length.cast("string")))


def unified_diff(file: Column, lines: Column, edits: Column) -> Column:
    """a/ b/ unified diff of non-overlapping edits on the file's lines; empty when nothing changes.

    Changes whose context of three lines meets share a hunk.
    """
    n = F.size(lines)
    none = F.array().cast(f"array<struct<low:int,high:int,moved:int,changes:array<{_CHANGE}>>>")

    def grown(hunks: Column, c: Column) -> Column:
        low = F.greatest(c["s"] - CONTEXT_LINES, F.lit(0))
        high = F.least(c["s"] + F.size(c["old"]) + CONTEXT_LINES, n)
        last = F.try_element_at(hunks, F.lit(-1))
        gain = F.aggregate(last["changes"], last["moved"], lambda k, x: k + F.size(x["new"]) - F.size(x["old"]))
        alone = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.coalesce(gain, F.lit(0)).cast("int").alias("moved"),
                         F.array(c).alias("changes"))
        joined = F.struct(last["low"].alias("low"), high.cast("int").alias("high"), last["moved"].alias("moved"),
                          F.concat(last["changes"], F.array(c)).alias("changes"))
        return F.when((F.size(hunks) > 0) & (low <= last["high"]), F.concat(F.slice(hunks, F.lit(1), F.size(hunks) - 1), F.array(joined))).otherwise(
            F.concat(hunks, F.array(alone)))

    def marked(mark: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit(mark), x))

    def context(start: Column, stop: Column) -> Column:
        return marked(" ", F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))))

    def shown(h: Column) -> Column:
        start = F.struct(h["low"].alias("at"), F.array().cast("array<string>").alias("out"))
        body = F.aggregate(
            h["changes"], start,
            lambda acc, c: F.struct((c["s"] + F.size(c["old"])).cast("int").alias("at"), F.concat(
                acc["out"], context(acc["at"], c["s"]), marked("-", c["old"]), marked("+", c["new"])).alias("out")),
            lambda acc: F.concat(acc["out"], context(acc["at"], h["high"])))
        was = h["high"] - h["low"]
        gain = F.aggregate(h["changes"], F.lit(0), lambda k, x: k + F.size(x["new"]) - F.size(x["old"]))
        header = F.concat(F.lit("@@ -"), _range(h["low"], was), F.lit(" +"), _range(h["low"] + h["moved"], was + gain), F.lit(" @@"))
        return F.concat(F.array(header), body)

    hunks = tx.let(_changes(lines, edits), lambda cs: F.aggregate(cs, none, grown))
    text = F.array_join(F.flatten(F.transform(hunks, shown)), "\n")
    return F.when(text == "", "").otherwise(F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n"), text, F.lit("\n")))


def pair_conflicts(edits: Column) -> Column:
    """Symmetric conflicts: both edits of a clash fail, only the later of two equal ones."""

    def verdict(e: Column) -> Column:
        def clash(o: Column) -> Column:
            return (o["edit_index"] != e["edit_index"]) & (o["start_line"] <= e["end_line"]) & (
                e["start_line"] <= o["end_line"])

        def twin(o: Column) -> Column:
            return (
                (o["start_line"] == e["start_line"]) & (o["end_line"] == e["end_line"])
                & same_code_strict(o["old_code"], e["old_code"]) & same_code_strict(o["new_code"], e["new_code"])
            )

        fine = F.filter(edits, lambda o: o["failure"].isNull() & clash(o))
        # the pair seen first decides: pairs are visited by their earlier edit, then the later one
        earlier = F.filter(fine, lambda o: o["edit_index"] < e["edit_index"])
        later_clash = F.exists(fine, lambda o: (o["edit_index"] > e["edit_index"]) & ~twin(o))
        from_earlier = F.when(
            F.size(earlier) > 0,
            F.when(twin(F.get(earlier, F.lit(0))), F.lit("duplicate_edit")).otherwise(F.lit("conflicting_edit")),
        )
        return e.withField(
            "failure",
            F.coalesce(e["failure"], from_earlier, F.when(later_clash, F.lit("conflicting_edit"))),
        )

    return F.transform(edits, verdict)


def preflight(edits: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, file, content, _lines, _edits) with the failure of each edit, if any."""
    grouped = edits.withColumn("file", tx.normal_path(F.col("file"))).groupBy("case_id", "file").agg(
        F.sort_array(F.collect_list(F.struct("edit_index", "start_line", "end_line", "old_code", "new_code"))).alias("_raw")
    )
    met = grouped.join(files.select("case_id", "file", "content"), ["case_id", "file"], "left")
    body = tx.canonical_newlines(tx.strip_bom(F.col("content")))
    no_end = F.regexp_replace(body, r"\n\z", "")
    met = computed_once(
        met,
        _lines=F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(no_end, "\n", -1)),
    )
    lines = F.col("_lines")

    def look(e: Column) -> Column:
        failure = (
            F.when(~apply_path_allowed(F.col("file")), "path_not_allowed")
            .when(F.col("content").isNull(), "new_file_not_supported")
            .when((e["start_line"] < 1) | (e["end_line"] < e["start_line"]) | (e["end_line"] > F.size(lines)),
                  "invalid_range")
            .when(~same_code_strict(code_slice(lines, e["start_line"], e["end_line"]), e["old_code"]), "stale_patch")
            .when(is_blank(e["new_code"]) | same_code_strict(e["old_code"], e["new_code"]), "empty_or_unchanged_edit")
        )
        return e.withField("failure", failure)

    seen = computed_once(met, _seen=F.transform("_raw", look)).drop("_raw")
    return computed_once(seen, _edits=pair_conflicts(F.col("_seen"))).drop("_seen")


def apply_edits(edits: DataFrame, files: DataFrame) -> DataFrame:
    """All-or-nothing application per case.

    One row per (case, file): ``status`` applied or rejected, the ``error`` of a
    rejected case, each edit with its own ``failure``, and for applied files the
    new ``content`` and ``diff``.
    """
    checked = preflight(edits, files)
    text = tx.strip_bom(F.col("content"))
    newline = F.when(F.contains(text, F.lit("\r\n")), "\r\n").when(F.contains(text, F.lit("\r")), "\r").otherwise("\n")
    bad = F.exists(F.col("_edits"), lambda e: e["failure"].isNotNull())
    ends = F.when(tx.canonical_newlines(text).rlike(r"\n\z"), "\n").otherwise("")
    new_text = F.concat(F.array_join(composed(F.col("_lines"), F.col("_edits")), "\n"), ends)
    with_bom = F.concat(F.when(F.startswith(F.col("content"), F.lit("﻿")), "﻿").otherwise(""),
                        F.replace(new_text, F.lit("\n"), newline))
    # whether a case fails is known before anything is composed; files of a case meet in one window
    case = Window.partitionBy("case_id")
    judged = checked.withColumn("_failed", F.max(bad).over(case))
    done = computed_once(judged, _new=F.when(~F.col("_failed"), with_bom),
                         _diff=F.when(~F.col("_failed"), unified_diff(F.col("file"), F.col("_lines"), F.col("_edits")))).drop("_lines")
    unsafe = F.max(F.coalesce(is_sensitive_diff(F.col("_diff")), F.lit(False))).over(case)
    out = done.withColumn("error", F.when(F.col("_failed"), "preflight_failed").when(unsafe, "unsafe_diff"))
    applied = F.col("error").isNull()

    def own(e: Column) -> Column:
        return e.withField(
            "failure",
            F.when(F.col("error") == "unsafe_diff", F.lit("unsafe_diff"))
            .when(F.col("error").isNotNull(), F.coalesce(e["failure"], F.lit("preflight_aborted"))),
        )

    return out.select(
        "case_id", "file", F.when(applied, "applied").otherwise("rejected").alias("status"), "error",
        F.transform("_edits", own).alias("edits"),
        F.when(applied, F.col("_new")).alias("content"), F.when(applied, F.col("_diff")).alias("diff"),
        (applied & (F.col("_diff") != "")).alias("changed"),
    )


def edit_audit(applied: DataFrame) -> DataFrame:
    """Hashes of the code each applied edit replaced and put in."""
    e = applied.where("status = 'applied'").select("case_id", "file", F.explode("edits").alias("e"))
    return e.select(
        "case_id", "file", "e.edit_index", "e.start_line", "e.end_line",
        F.sha2(tx.canonical_newlines(F.col("e.old_code")), 256).alias("old_code_sha256"),
        F.sha2(tx.canonical_newlines(F.col("e.new_code")), 256).alias("new_code_sha256"),
    )
