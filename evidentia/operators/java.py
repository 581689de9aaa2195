"""Declarations, block ends, symbols and imports of Java-like source text.

Everything about one file is computed inside its row: a source file is bounded
(oversized files are cut at scan time), so no shuffle is needed to find blocks,
split long declarations or fall back to windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.operators.corpus import WINDOW_LINES, window_starts
from evidentia.session import broadcast_if_small, computed_once, materialize

MAX_DECL_LINES = 60
DECL_OVERLAP = 5

# What counts as a declaration.  Modifiers are eaten greedily and
# word by word, so indentation never makes the matcher backtrack.
_WORDS = "public|protected|private|abstract|final|static|synchronized|native|default|strictfp"
_MODS = rf"[ \t]*+(?:(?:{_WORDS})[ \t]*+)*"
_MODS_ANY_BLANK = rf"\s*+(?:(?:{_WORDS})\s*+)*"
_TYPE = r"(?:[A-Z][A-Za-z0-9_<>\[\],\s]*|[a-z][A-Za-z0-9_<>\[\],\s]*|void)\s+"


def _kind_patterns(mods: str) -> dict[str, str]:
    out = {
        kind: rf"(?md)^{mods}{kind}\s+([A-Z][A-Za-z0-9_]*)" for kind in ("class", "interface", "enum", "record")
    }
    out["constructor"] = rf"(?md)^{mods}([A-Z][A-Za-z0-9_]*)\s*\("
    out["method"] = rf"(?md)^{mods}{_TYPE}([a-z][A-Za-z0-9_]*)\s*\("
    return out


DECLARATIONS = _kind_patterns(_MODS)
SYMBOLS = {k: p for k, p in _kind_patterns(_MODS_ANY_BLANK).items() if k != "constructor"}
SYMBOLS["annotation"] = r"@([A-Z][A-Za-z0-9_]*)\s*(?:\(|\s|$)"
# end fixed values

# Pieces of code that matter to brace counting: comments and literals come
# first so that braces inside them are swallowed.
_BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
_STRING = r'"(?:[^"\\\n]++|\\[^\n])*+\\?"?'
_CHAR = r"'(?:[^'\\\n]++|\\[^\n])*+\\?'?"
_BRACE_TOKEN = rf"{_BLOCK_COMMENT}|//[^\n]*|{_STRING}|{_CHAR}|[{{}}\n]"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def matches_with_lines(content: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, name, line>>: every match with the 0-based line it starts on.

    The text between matches and the matches themselves add up to the whole
    text, so line numbers are running sums of their line ends.
    """
    def parts(whole: Column) -> Column:
        # the same pattern finds the same name inside its match, and a text without a match is not split
        return F.when(F.size(whole) > 0, F.arrays_zip(
            F.slice(F.split(content, pattern, -1), 1, F.size(whole)).alias("b"), whole.alias("w"),
            F.transform(whole, lambda w: F.regexp_extract(w, pattern, 1)).alias("n")))

    start = F.struct(
        F.lit(0).alias("line"), F.array().cast("array<struct<kind:string,name:string,line:int>>").alias("out")
    )

    def step(acc: Column, m: Column) -> Column:
        at = acc["line"] + _newlines(m["b"])
        found = F.struct(F.lit(kind).alias("kind"), m["n"].alias("name"), at.cast("int").alias("line"))
        return F.struct(
            (at + _newlines(m["w"])).cast("int").alias("line"), F.concat(acc["out"], F.array(found)).alias("out")
        )

    whole = F.regexp_extract_all(content, F.lit(pattern), 0)
    found = F.aggregate(tx.let(whole, parts), start, step, lambda acc: acc["out"])
    return F.when(content.isNotNull(), F.coalesce(found, start["out"]))


def block_end(lines: Column, start: Column) -> Column:
    """0-based line on which the first ``{`` block at or after ``start`` closes."""
    tail = F.array_join(F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0))), "\n")
    tokens = F.regexp_extract_all(tail, F.lit(_BRACE_TOKEN), 0)
    # literals and line comments fall away first, so that the fold visits braces only, each with the line ends before it
    plain = F.filter(tokens, lambda t: (F.length(t) == 1) | F.startswith(t, F.lit("/*")))
    ends = F.transform(plain, lambda t: F.when(F.length(t) == 1, t).otherwise(F.regexp_replace(t, "[^\n]+", "")))
    braces = F.regexp_extract_all(F.array_join(ends, ""), F.lit(r"[^{}]*[{}]"), 0)
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(0).alias("line"), F.lit(-1).alias("end")
    )

    def step(acc: Column, t: Column) -> Column:
        opens = F.endswith(t, F.lit("{"))
        depth = acc["depth"] + F.when(opens, 1).otherwise(-1)
        opened = acc["open"] | opens
        line = acc["line"] + _newlines(t)
        closed = ~opens & opened & (depth == 0)
        return F.when(acc["end"] >= 0, acc).otherwise(
            F.struct(
                depth.cast("int").alias("depth"), opened.alias("open"), line.cast("int").alias("line"),
                F.when(closed, line).otherwise(-1).cast("int").alias("end"),
            )
        )

    end = F.aggregate(braces, zero, step, lambda acc: acc["end"])
    return F.when(end >= 0, start + end).otherwise(F.size(lines) - 1)


def annotation_start(lines: Column, decl: Column, max_above: int | None = None) -> Column:
    """0-based first line of the annotations, comments and blanks directly above (at most ``max_above`` lines)."""

    def attached(line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"\s+", " "))
        return (bare == "") | bare.rlike(r"^(?:@|\*|//)")

    above = F.aggregate(
        F.sequence(F.lit(1), F.greatest(decl, F.lit(1)) if max_above is None else F.lit(max_above)),
        F.lit(0),
        lambda n, k: F.when(
            (n == k - 1) & (decl - k >= 0) & attached(F.get(lines, decl - k)), k
        ).otherwise(n),
    )
    return decl - above


def split_block(lines: Column, start: Column, end: Column, max_chars: int | None = None) -> Column:
    """array<struct<w, s, e, body>>: 60-line windows of a long block.

    A window over ``max_chars`` (None: no limit) ends at the last line that fits,
    and the next one starts five lines before its end, or right after it if that
    would not move forward.
    """
    out_type = "array<struct<w:int,s:int,e:int,body:string>>"
    zero = F.struct(start.cast("int").alias("cursor"), F.array().cast(out_type).alias("out"))

    def window(cursor: Column, w: Column) -> Column:
        last = F.least(cursor + (MAX_DECL_LINES - 1), end)
        body = F.array_join(F.slice(lines, cursor + 1, last - cursor + 1), "\n")
        if max_chars is None:
            return F.struct(w.cast("int").alias("w"), cursor.alias("s"), last.cast("int").alias("e"), body.alias("body"))
        cut = tx.cut_at_line(body, max_chars)
        # a first line beyond the limit leaves no line end to cut at
        fits = F.when((F.length(body) > max_chars) & F.left(body, F.lit(max_chars)).rlike(r"(?s)^.+\n"), cut)
        text = F.coalesce(fits, body)
        e = F.when(fits.isNotNull(), cursor + _newlines(text)).otherwise(last)
        return F.struct(w.cast("int").alias("w"), cursor.alias("s"), e.cast("int").alias("e"), text.alias("body"))

    def step(acc: Column, w: Column) -> Column:
        made = F.array(window(acc["cursor"], w))

        def advance(m: Column) -> Column:
            back = m["e"] + (1 - DECL_OVERLAP)
            nxt = F.when(m["e"] >= end, end + 1).otherwise(F.greatest(back, F.lit(0)))
            nxt = F.when((m["e"] < end) & (back <= m["s"]), m["e"] + 1).otherwise(nxt)
            return F.struct(nxt.cast("int").alias("cursor"), F.concat(acc["out"], F.array(m)).alias("out"))

        # the one-element array lets the window be computed once and used twice
        return F.when(acc["cursor"] > end, acc).otherwise(F.get(F.transform(made, advance), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), end - start), zero, step, lambda acc: acc["out"])


def with_declarations(files: DataFrame, max_file_chars: int | None = None) -> DataFrame:
    """Adds ``_lines`` and ``_decls`` (kind, name, line, start, end; all 0-based)."""
    content = F.col("content") if max_file_chars is None else F.left(F.col("content"), F.lit(max_file_chars))
    text = tx.canonical_newlines(content)
    base = computed_once(files, _text=text)
    base = computed_once(
        base,
        _lines=tx.lines_of(F.col("_text")),
        _found=F.concat(*[matches_with_lines(F.col("_text"), p, k) for k, p in DECLARATIONS.items()]),
    )
    spans = F.transform(
        F.col("_found"),
        lambda d: F.struct(
            d["kind"].alias("kind"), d["name"].alias("name"), d["line"].alias("line"),
            annotation_start(F.col("_lines"), d["line"]).cast("int").alias("start"),
            block_end(F.col("_lines"), d["line"]).cast("int").alias("end"),
        ),
    )
    keep = F.filter(
        spans,
        lambda d: (d["end"] - d["start"] >= 1) | d["kind"].isin("method", "constructor"),
    )
    return computed_once(base, _decls=keep).drop("_found")


def declarations(files: DataFrame) -> DataFrame:
    """(repo, file, kind, name, decl_line, start_line, end_line), lines 1-based."""
    d = with_declarations(files).select("repo", "file", F.explode("_decls").alias("d"))
    return d.select(
        "repo", "file", "d.kind", "d.name",
        (F.col("d.line") + 1).cast("bigint").alias("decl_line"),
        (F.col("d.start") + 1).cast("bigint").alias("start_line"),
        (F.col("d.end") + 1).cast("bigint").alias("end_line"),
    )


def declaration_chunks(files: DataFrame, max_chars: int | None = None, max_file_chars: int | None = None) -> DataFrame:
    """Chunks of code files, ready for ``finish_chunks``.

    A file without declarations, or with a single line too long for a chunk of
    ``max_chars``, is cut into plain windows instead.  By default nothing is cut;
    ``truncated`` marks chunks that a limit has cut.
    """
    lines = F.col("_lines")

    def over(text: Column) -> Column:
        return F.lit(False) if max_chars is None else F.length(text) > max_chars

    def pieces(d: Column) -> Column:
        body = F.array_join(F.slice(lines, d["start"] + 1, d["end"] - d["start"] + 1), "\n")
        long = (d["end"] - d["start"] + 1 > MAX_DECL_LINES) | over(body)
        single = F.array(
            F.struct(F.lit(-1).alias("w"), d["start"].alias("s"), d["end"].alias("e"), body.alias("body"))
        )
        windows = F.when(long, split_block(lines, d["start"], d["end"], max_chars)).otherwise(single)
        return F.transform(
            windows,
            lambda x: F.struct(
                d["kind"].alias("chunk_type"), d["name"].alias("symbol_name"),
                F.when(x["w"] >= 0, F.concat(d["name"], F.lit("_w"), x["w"].cast("string")))
                .otherwise(d["name"]).alias("_id_symbol"),
                (x["s"] + 1).cast("bigint").alias("start_line"),
                (x["e"] + 1).cast("bigint").alias("end_line"),
                x["body"].alias("content"), F.lit(False).alias("truncated"),
            ),
        )

    def window_body(s: Column) -> Column:
        return F.array_join(F.slice(lines, s + 1, F.lit(WINDOW_LINES)), "\n")

    plain = F.transform(
        window_starts(F.size(lines)),
        lambda s: F.struct(
            F.lit("file_window").alias("chunk_type"), F.lit(None).cast("string").alias("symbol_name"),
            F.lit(None).cast("string").alias("_id_symbol"),
            (s + 1).cast("bigint").alias("start_line"),
            F.least(s + WINDOW_LINES, F.size(lines)).cast("bigint").alias("end_line"),
            tx.cut_at_line(window_body(s), max_chars).alias("content"), over(window_body(s)).alias("truncated"),
        ),
    )
    staged = computed_once(with_declarations(files, max_file_chars), _pieces=F.flatten(F.transform(F.col("_decls"), pieces)))
    usable = F.size("_pieces") > 0
    if max_chars is not None:
        usable = usable & ~F.exists(F.col("_pieces"), lambda p: over(p["content"]))
    return staged.select(
        "repo", "file", F.lit("java").alias("language"),
        F.explode(F.when(usable, F.col("_pieces")).otherwise(plain)).alias("_c"),
    ).select("repo", "file", "language", "_c.*")


# -------------------------------------------------------------------- symbols
def symbol_table(files: DataFrame) -> DataFrame:
    """(repo, file, line, kind, name) of all types, methods and annotation uses."""
    text = tx.canonical_newlines(F.col("content"))
    base = computed_once(files, _text=text)
    found = F.array_distinct(F.concat(*[matches_with_lines(F.col("_text"), p, k) for k, p in SYMBOLS.items()]))
    return base.select("repo", "file", F.explode(found).alias("s")).select(
        "repo", "file", (F.col("s.line") + 1).cast("bigint").alias("line"), "s.kind", "s.name"
    )


def symbol_matches(files: DataFrame, symbols: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Declarations and uses of exact names: ``symbols`` is (query_id, repo, symbol, symbol_no).

    ``table`` is a stored ``symbol_table`` of the files' code.
    """
    wanted = broadcast_if_small(symbols.withColumnRenamed("symbol", "name"))
    names = symbol_table(files.where(F.endswith("file", F.lit(".java")))) if table is None else table
    return names.join(wanted, ["repo", "name"])


def symbol_search(
    files: DataFrame, symbols: DataFrame, per_symbol: int | None = None, k: int = 10, max_chars: int | None = None,
    annotation_lines: int = 30, table: DataFrame | None = None,
) -> DataFrame:
    """The symbol channel: the first ``k`` matches in discovery order with their surrounding block.

    An annotation use has no block of its own and shows ``annotation_lines`` lines.
    ``per_symbol`` times the query's symbols is one more limit; ``max_chars`` cuts
    the block's text at a line.  Neither holds by default.
    """
    from evidentia.operators.ranking import first_per_key, top_k

    # names meet and are ranked as narrow rows; only the winners' files are read for their blocks
    matches = symbol_matches(files, symbols, table).withColumn("_walk", tx.walk_key(F.col("file")))
    order = [F.asc("symbol_no"), F.asc("_walk"), F.asc("line"), F.asc("kind")]
    once = first_per_key(matches, ["query_id", "file", "kind", "name", "line"], order)
    ranked = top_k(once, ["query_id"], order, k)
    if per_symbol is not None:
        sizes = symbols.groupBy("query_id").agg((F.count(F.lit(1)) * per_symbol).alias("_cap"))
        ranked = ranked.join(broadcast_if_small(sizes), "query_id").where(F.col("rank") <= F.col("_cap"))
    # written once: the check before a broadcast would read all code again
    ranked = files.select("repo", "file", "content").join(broadcast_if_small(materialize(ranked, "symbol-winners")), ["repo", "file"])
    ranked = computed_once(ranked, _lines=tx.lines_of(tx.canonical_newlines(F.col("content"))))
    line = F.col("line").cast("int")
    n = F.size("_lines")
    end = F.when(F.col("kind") == "annotation", F.least(n, line + annotation_lines)).otherwise(
        F.least(block_end(F.col("_lines"), line - 1) + 1, n)
    )
    ranked = computed_once(ranked, end_line=end.cast("bigint")).select(
        "query_id", "repo", "file", "kind", F.col("name").alias("symbol"), "rank", F.col("line").alias("start_line"), "end_line",
        tx.cut_at_line(
            F.array_join(F.slice("_lines", line, F.greatest(F.col("end_line").cast("int") - line + 1, F.lit(0))), "\n"), max_chars
        ).alias("content"),
    )
    ranked = ranked.withColumn(
        "chunk_id",
        tx.chunk_id(F.col("file"), F.col("kind"), F.col("symbol"), F.col("start_line"), F.col("end_line")),
    )
    return ranked.select(
        "query_id", "repo", "chunk_id", "file", "start_line", "end_line", "rank", "kind", "symbol",
        F.array("symbol").alias("matched_terms"), "content",
    )


# -------------------------------------------------------------------- imports
# Imports, literals and comments, and where a capitalised name is certainly a type.
_IMPORT = r"^\s*import\s+(?:static\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\s*;\s*$"
_LITERAL = r'"(?:[^"\\]++|\\(?s:.))*+"|' + r"'(?:[^'\\]++|\\(?s:.))*+'|//[^\r\n]*|/\*(?s:.*?)\*/"
_DECLARED = r"\b(?:class|interface|enum|record)\s+([A-Z][A-Za-z0-9_$]*)\b"
_DECLARED_ANNOTATION = r"\b@interface\s+([A-Z][A-Za-z0-9_$]*)\b"
_CAPITALISED = r"\b[A-Z][A-Za-z0-9_$]*\b"
_AFTER_DOT = r"\.\s*([A-Z][A-Za-z0-9_$]*)\b"
_ANNOTATION = r"(?<![\w.$])@([A-Z][A-Za-z0-9_$]*)\b"
_QUALIFIED = r"(?:[a-z_$][\w$]*\.)+([A-Z][A-Za-z0-9_$]*)\b"
_TYPE_CONTEXTS = [
    r"\bnew\s+([A-Z][A-Za-z0-9_$]*)\b",
    r"\b(?:extends|implements|instanceof|throws)\s+([A-Z][A-Za-z0-9_$]*)\b",
    r"<\s*([A-Z][A-Za-z0-9_$]*)\s*(?:[,>])",
    r"\b([A-Z][A-Za-z0-9_$]*)\s*(?:<[^>\n]*>)?\s+[a-z_$][A-Za-z0-9_$]*\s*(?:[=;,({]|$)",
    r"(?<![\w.$])([A-Z][A-Za-z0-9_$]*)\s*\.",
]
_JAVA_MARKER = (
    r"(?m)^\s*(?:package\s+|import\s+|(?:public\s+)?(?:class|interface|enum|record)\s+)|[{}]"
)
# end fixed values


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def strip_code(source: Column) -> Column:
    """Comments and literals blanked; line structure kept.

    The pieces between comments and literals stay; each of those becomes as many
    line ends as it spans, with one blank on either side.
    """
    kept = F.split(source, _LITERAL, -1)
    gone = F.regexp_extract_all(source, F.lit(_LITERAL), 0)
    blank = lambda g: F.transform(F.split(g, "\n", -1), lambda x: F.repeat(F.lit(" "), F.length(x)))
    blanks = F.transform(gone, lambda g: F.array_join(blank(g), "\n"))
    return F.array_join(
        F.flatten(F.transform(F.arrays_zip(kept.alias("k"), blanks.alias("b")),
                              lambda z: F.array(z["k"], F.coalesce(z["b"], F.lit(""))))), "")


def _code_split(source: Column) -> Column:
    return F.split(tx.canonical_newlines(source), "\n", -1)


def simple_imports(source: Column) -> Column:
    """Last name segments of all import lines."""
    names = F.transform(
        F.filter(_code_split(source), lambda x: x.rlike(_IMPORT)),
        lambda x: F.substring_index(F.regexp_extract(x, _IMPORT, 1), ".", -1),
    )
    return F.array_distinct(names)


def without_imports(source: Column) -> Column:
    return F.array_join(F.transform(_code_split(source), lambda x: F.when(x.rlike(_IMPORT), "").otherwise(x)), "\n")


def is_import_only(source: Column) -> Column:
    """At least one import line and nothing but import lines."""
    used = F.filter(_code_split(source), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    return (F.size(used) > 0) & F.forall(used, lambda x: x.rlike(_IMPORT))


def declared_symbols(source: Column) -> Column:
    code = strip_code(source)
    return F.array_distinct(F.concat(_all(code, _DECLARED), _all(code, _DECLARED_ANNOTATION)))


def qualified_symbols(source: Column) -> Column:
    return F.array_distinct(_all(strip_code(source), _QUALIFIED))


def type_symbols(source: Column) -> Column:
    """struct<confident, uncertain, qualified>: capitalised names used by a piece of code."""

    def named(code: Column) -> Column:
        sure = F.concat(
            _all(code, _ANNOTATION), _all(code, _DECLARED), _all(code, _DECLARED_ANNOTATION),
            *[_all(code, p) for p in _TYPE_CONTEXTS],
        )
        return F.struct(
            sure.alias("sure"),
            F.array_except(_all(code, _CAPITALISED, 0), _all(code, _AFTER_DOT)).alias("named"),
            F.array_union(tx.words(*V.JAVA_KEYWORDS, *V.JAVA_LANG_TYPES), _all(code, _QUALIFIED)).alias("known"),
        )

    def sort(x: Column) -> Column:
        return F.struct(
            F.array_sort(F.array_except(x["sure"], x["known"])).alias("confident"),
            F.array_sort(F.array_except(F.array_except(x["named"], x["sure"]), x["known"])).alias("uncertain"),
            F.array_sort(qualified_symbols(source)).alias("qualified"),
        )

    return tx.let(tx.let(strip_code(without_imports(source)), named), sort)


def import_check(existing: Column, proposed: Column, changes: Column) -> Column:
    """struct<introduced, resolved, unresolved, status> for the composed edits of a file.

    ``changes`` is array<struct<old_code, new_code>>: the edits of one file, a
    handful.
    """
    empty = F.array().cast("array<string>")

    def stripped(code: Column) -> Column:
        return tx.strip(strip_code(code))

    def added(c: Column) -> Column:
        def gain(n: Column, o: Column) -> Column:
            return F.struct(*[F.array_except(n[f], o[f]).alias(f) for f in ("confident", "uncertain", "qualified")],
                            changed.alias("changed"))

        changed = (stripped(c["new_code"]) != stripped(c["old_code"])) & ~(
            is_import_only(c["new_code"]) | c["new_code"].rlike(r"^\s*$")
        )
        pair = F.struct(type_symbols(c["new_code"]).alias("n"), type_symbols(c["old_code"]).alias("o"))
        return tx.let(pair, lambda x: gain(x["n"], x["o"]))

    def collect(adds: Column) -> Column:
        return F.struct(
            F.flatten(adds["confident"]).alias("sure"), F.flatten(adds["uncertain"]).alias("unsure"),
            F.flatten(adds["qualified"]).alias("qualified"), F.exists(adds, lambda a: a["changed"]).alias("changed"),
            (existing.rlike(_JAVA_MARKER) | proposed.rlike(_JAVA_MARKER)).alias("is_java"),
        )

    def resolve(g: Column) -> Column:
        introduced = F.array_sort(F.array_distinct(F.concat(g["sure"], g["unsure"], g["qualified"])))
        own = tx.let(strip_code(proposed), lambda code: F.concat(*[_all(code, p) for p in (_DECLARED, _DECLARED_ANNOTATION, _QUALIFIED)]))
        known = F.concat(simple_imports(proposed), own, tx.words(*V.JAVA_LANG_TYPES), g["qualified"])
        # the file's own names matter only when an edit brings new ones
        resolved = F.when(F.size(introduced) > 0, F.array_intersect(introduced, known)).otherwise(empty)
        return F.struct(g.alias("g"), introduced.alias("introduced"), resolved.alias("resolved"))

    def verdict(r: Column) -> Column:
        g = r["g"]
        unresolved = F.array_sort(F.array_except(g["sure"], r["resolved"]))
        status = (
            F.when(~g["is_java"], "unknown")
            .when(F.size(r["introduced"]) == 0, F.when(g["changed"], "unknown").otherwise("pass"))
            .when(F.size(unresolved) > 0, "fail")
            .when(F.size(F.array_except(g["unsure"], r["resolved"])) > 0, "unknown")
            .otherwise("pass")
        )
        return F.struct(
            F.when(g["is_java"], r["introduced"]).otherwise(empty).alias("introduced"),
            F.when(g["is_java"], r["resolved"]).otherwise(empty).alias("resolved"),
            F.when(g["is_java"], unresolved).otherwise(empty).alias("unresolved"),
            status.alias("status"),
        )

    adds = F.transform(changes, added)
    return tx.let(tx.let(tx.let(adds, collect), resolve), verdict)
