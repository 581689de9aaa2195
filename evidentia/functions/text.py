"""Text expressions: lines, tokens, normal forms, redaction and bounded fields.

Every function takes and returns a Column, so callers evaluate whole tables
inside the JVM. Regular expressions are written for the Java engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import values as V

# Line ends, word boundaries and identifiers.
# Line ends as Python's ``splitlines`` sees them.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
WORD_BOUNDARY = r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
# end fixed values


def first_items(items: Column, limit: int | None) -> Column:
    """The first ``limit`` elements; all of them for None."""
    return items if limit is None else F.slice(items, 1, limit)


def words(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once although ``body`` uses it many times.

    Inside lambdas equal sub-expressions are not shared, so a value that several
    others build on is bound as the element of a one-element array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Blanks off both ends in linear time (a pattern would retry on every inner run)."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


# ---------------------------------------------------------------------- lines
def lines_of(text: Column) -> Column:
    """Lines without their ends; a final empty line does not count."""
    parts = F.split(text, LINE_BREAK, -1)
    trailing = F.element_at(parts, -1) == ""
    return F.when(trailing, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_lines(text: Column) -> Column:
    """Lines of source as edits address them: BOM off, CR forms unified, all kept."""
    return F.split(canonical_newlines(strip_bom(text)), "\n", -1)


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def only(text: Column, allowed: str) -> Column:
    """The text without the characters that the class ``allowed`` lacks; its runs are joined, as replacing single characters costs far more."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"[{allowed}]+"), 0), "")


def canonical_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def cut_at_line(body: Column, max_chars: int | None = None) -> Column:
    """At most ``max_chars`` (None: all), ending at the last line break inside them if there is one."""
    if max_chars is None:
        return body
    head = F.left(body, F.lit(max_chars))
    return F.when(
        F.length(body) > max_chars,
        F.regexp_replace(head, r"(?s)^(.+)\n[^\n]*\z", "$1"),
    ).otherwise(body)


# --------------------------------------------------------------------- tokens
def _plain_tokens(text: Column) -> Column:
    """Lower-case sub-words of at least two characters, repeats kept."""
    spaced = F.regexp_replace(F.regexp_replace(text, WORD_BOUNDARY, " "), "[^A-Za-z0-9]+", " ")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]{2,}"), 0)


def identifier_tokens(text: Column) -> Column:
    """Distinct sub-words of an identifier (or of free text) in first-seen order."""
    return F.array_distinct(_plain_tokens(text))


text_tokens = identifier_tokens


def chunk_tokens(content: Column, max_tokens: int | None = None) -> Column:
    """Sub-words of each identifier, then the whole identifier; stop words out.

    ``max_tokens`` keeps the first tokens only; by default all are kept.
    """
    names = F.array_distinct(F.regexp_extract_all(content, F.lit(IDENTIFIER), 0))
    expanded = F.flatten(
        F.transform(
            names,
            lambda n: F.when(
                n.rlike("^[A-Za-z][a-z]+$"), F.array(F.lower(n))
            ).otherwise(
                F.concat(
                    _plain_tokens(n),
                    F.when(F.length(n) >= 2, F.array(F.lower(n))).otherwise(F.array().cast("array<string>")),
                )
            ),
        )
    )
    return first_items(F.array_except(expanded, words(*V.STOP_WORDS)), max_tokens)


def normal_terms(terms: Column, max_terms: int | None = None) -> Column:
    """Query terms split into sub-words, stop words out, first ``max_terms`` kept (None: all).

    A term without any sub-word is kept lower-cased if it is long enough.
    """
    stop = words(*V.STOP_WORDS)
    split_terms = F.flatten(
        F.transform(
            F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != ""),
            lambda t: F.when(F.size(_plain_tokens(t)) > 0, _plain_tokens(t)).otherwise(
                F.filter(F.array(F.lower(t)), lambda x: F.length(x) >= 2)
            ),
        )
    )
    return first_items(F.array_except(split_terms, stop), max_terms)


def discarded_terms(terms: Column, max_terms: int | None = None) -> Column:
    """How many inputs the normal form drops.

    Below the cap that is every stop-word occurrence plus every unusable term;
    at the cap it is the number of inputs after the first occurrence of the
    term that filled the list.
    """
    stop = words(*V.STOP_WORDS)
    usable = F.filter(terms, lambda t: F.trim(t) != "")

    def subs(t: Column) -> Column:
        t = F.trim(t)
        return F.when(F.size(identifier_tokens(t)) > 0, identifier_tokens(t)).otherwise(F.array(F.lower(t)))

    def dropped(t: Column) -> Column:
        raw = F.size(identifier_tokens(F.trim(t))) == 0
        unusable = raw & ((F.length(F.trim(t)) < 2) | F.array_contains(stop, F.lower(F.trim(t))))
        return F.when(unusable, 1).otherwise(
            F.size(F.filter(subs(t), lambda x: F.array_contains(stop, x)))
        )

    below = F.aggregate(F.transform(usable, dropped), F.lit(0), lambda a, x: a + x)
    if max_terms is None:
        return below
    kept = F.array_except(F.flatten(F.transform(usable, subs)), stop)
    last = F.element_at(kept, max_terms)
    filler = F.element_at(F.filter(usable, lambda t: F.array_contains(subs(t), last)), 1)
    at_cap = F.size(terms) - F.array_position(terms, filler).cast("int")
    return F.when(F.size(kept) >= max_terms, at_cap).otherwise(below)


def term_kind(term: Column) -> Column:
    """Lexical shape of a search term; null when a plain term is too short or long."""
    return (
        F.when(term.rlike(r"^@[A-Z][A-Za-z0-9_]*$"), "annotation")
        .when(term.rlike(r"^[A-Z][A-Za-z0-9_]*Exception$"), "exception")
        .when(term.rlike(r"^[A-Z][A-Za-z0-9_]*$"), "class")
        .when(term.rlike(r"^[a-z][a-zA-Z0-9_]*[A-Z][a-zA-Z0-9_]*$"), "method")
        .when(F.length(term).between(2, 64), "plain")
    )


def term_weight(kind: Column) -> Column:
    return (
        F.when(kind == "annotation", 2.5)
        .when(kind == "exception", 3.0)
        .when(kind.isin("class", "method"), 2.0)
        .otherwise(1.0)
    )


def is_symbol(token: Column) -> Column:
    """Does a token look like an identifier worth looking up?"""
    return (
        (F.length(token) >= 3)
        & ((F.lower(token) != token) | token.isin("int", "long", "char"))
        & ~token.isin(*V.SYMBOL_STOP_WORDS)
        & ~((F.upper(token) == token) & (F.length(token) <= 4))
    )


FRAME_NAME = r"at\s+((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*\.[A-Za-z_]\w*)\s*\("


def stack_symbols(issue: Column, log: Column, cap: int | None = None) -> Column:
    """Class and method of every stack frame, then identifiers of the text; the first ``cap`` (None: all)."""
    frames = F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(FRAME_NAME), 1)
    from_log = F.flatten(F.transform(frames, lambda q: F.slice(F.split(q, r"\."), -2, 2)))
    from_text = F.regexp_extract_all(F.coalesce(issue, F.lit("")), F.lit(IDENTIFIER), 0)
    found = F.array_distinct(F.filter(F.concat(from_log, from_text), is_symbol))
    return first_items(found, cap)


# ---------------------------------------------------------------------- files
def chunk_id(file: Column, kind: Column, symbol: Column, start: Column, end: Column) -> Column:
    raw = F.concat_ws(
        ":", file, kind, F.coalesce(symbol, F.lit("")), start.cast("string"), end.cast("string")
    )
    return F.left(F.sha2(raw, 256), F.lit(16))


def language_of(file: Column) -> Column:
    return (
        F.when(F.endswith(file, F.lit(".java")), "java")
        .when(F.endswith(file, F.lit(".xml")), "xml")
        .when(file.rlike(r"\.ya?ml\z"), "yaml")
        .when(F.endswith(file, F.lit(".properties")), "properties")
        .when(F.endswith(file, F.lit(".sql")), "sql")
        .otherwise("text")
    )


def extension_of(file: Column) -> Column:
    """File suffix with its dot; names that only start with a dot have none."""
    return F.regexp_extract(file, r"[^/](\.[^./]+)\z", 1)


def normal_path(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def gold_path(path: Column) -> Column:
    return F.lower(F.trim(normal_path(path)))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def walk_key(path: Column) -> Column:
    """Sort key of a directory walk: files of a directory before its sub-directories."""
    parts = F.split(path, "/")
    n = F.size(parts)
    dirs = F.transform(F.slice(parts, 1, n - 1), lambda p: F.concat(F.lit("1/"), p))
    return F.array_join(F.concat(dirs, F.array(F.concat(F.lit("0/"), F.element_at(parts, -1)))), "\u0001")


def category(value: Column) -> Column:
    text = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")
    aliases = F.create_map(*[F.lit(x) for kv in V.CATEGORY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, text), text)


# -------------------------------------------------------------------- fixed patterns
# What the redactions recognise.
BEARER = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{8,}"
API_KEY = r"(?i)\bsk-[A-Za-z0-9_-]{16,}\b"
# Blanks are not part of the separator class: the pattern is read in verbose mode
# except inside classes, where "api key" keeps its blank.
SECRET_ASSIGNMENT = (
    r"(?i)\b(api[_ -]?key|token|secret|password|authorization|credential)\b"
    r"(\s*[:=]\s*)"
    r"(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|[^\r\n,;]+)"
)
URL = r"(?i)https?://[^\s\]\)}>]+"
ENV_FILE = r"(?i)(?:^|[\\/])\.env(?:\.[^\s/\\,;]+)?"
LOCAL_PATH = (
    r"(?i)(?:[\"'](?:[a-z]:[\\/]|\\\\|/(?:private/tmp|tmp|var|home|users?|root|workspaces?|opt|mnt)/)[^\"'\r\n]*[\"']|"
    r"(?:[a-z]:[\\/]|\\\\|/(?:private/tmp|tmp|var|home|users?|root|workspaces?|opt|mnt)/)[^\r\n,;]+)"
)
LOG_SECRET = r"(?i)(api[_ -]?key|token|secret|password|authorization)(\s*[:=]\s*)[^\s,;]+"
LOG_PATH = r"(?i)(?:[a-z]:[\\/]|/(?:tmp|var|home|users?)/)[^\s\r\n,;]+"
ANY_ABSOLUTE_PATH = r"(?:[A-Za-z]:[\\/]|(?<!\w)/)[^\s,;)}\]]+"
PATH_MARK = "<absolute-path-redacted>"
# end fixed values


def redact_artifact(text: Column) -> Column:
    out = F.regexp_replace(text, BEARER, "<redacted>")
    out = F.regexp_replace(out, API_KEY, "<redacted>")
    out = F.regexp_replace(out, SECRET_ASSIGNMENT, "$1=<redacted>")
    out = F.regexp_replace(out, URL, "<url>")
    out = F.regexp_replace(out, ENV_FILE, "/<redacted-env>")
    return F.regexp_replace(out, LOCAL_PATH, "<path>")


def redact_log(text: Column) -> Column:
    out = F.regexp_replace(text, BEARER, "Bearer <redacted>")
    out = F.regexp_replace(out, LOG_SECRET, "$1$2<redacted>")
    return F.regexp_replace(out, LOG_PATH, "<path>")


def redact_paths(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ANY_ABSOLUTE_PATH, PATH_MARK)


def safe_evidence_file(path: Column) -> Column:
    p = normal_path(path)
    return F.when(p.rlike(r"^/|^[A-Za-z]:/"), PATH_MARK).otherwise(p)


def redact_nested(col: Column, dtype) -> Column:
    """Redact every string inside a value of any nested type, by its schema."""
    from pyspark.sql import types as T

    if isinstance(dtype, T.StringType):
        return redact_artifact(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: redact_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _k, v: redact_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        made = F.struct(
            *[redact_nested(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        )
        return F.when(col.isNotNull(), made)
    return col


def output_tail(text: Column, max_lines: int = 100, max_chars: int = 4096) -> Column:
    """The redacted end of a process output."""
    lines = lines_of(redact_log(text))
    n = F.size(lines)
    last = F.when(n > max_lines, F.slice(lines, -max_lines, max_lines)).otherwise(lines)
    return F.right(F.array_join(last, "\n"), F.lit(max_chars))


def shorten(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def bounded_list(items: Column, max_chars: int, max_items: int) -> Column:
    """Trimmed, non-blank, length-bounded elements; the first ``max_items``."""
    trimmed = F.transform(items, lambda x: F.left(strip(x), F.lit(max_chars)))
    return F.slice(F.filter(trimmed, lambda x: x != ""), 1, max_items)


# Step texts must not ask for these commands.
SHELL_WORDS = ["mvn ", "mvn\t", "bash ", "sh ", "sudo ", "rm -rf", "curl "]
# end fixed values


def asks_for_shell(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(words(*SHELL_WORDS), lambda w: F.contains(low, w))


def bounded_evidence(
    summary: Column, candidates: Column, max_candidates: int = 3, summary_chars: int = 400, title_chars: int = 200,
    description_chars: int = 600, fix_chars: int = 600,
) -> Column:
    """A diagnosis as struct<summary, candidates, truncated_fields, truncated, evaluation_ready>.

    ``candidates`` is an array of (title, description, recommended_fix).  Texts are redacted,
    then cut; the names of cut fields are listed in reading order.  Evidence is ready for
    evaluation if it has any text and nothing was cut.
    """
    none = F.array().cast("array<string>")
    given = F.coalesce(candidates, F.slice(candidates, 1, 0))
    limits = {"title": title_chars, "description": description_chars, "recommended_fix": fix_chars}

    def safe(text: Column) -> Column:
        return redact_artifact(F.coalesce(text, F.lit("")))

    def build(x: Column) -> Column:
        def cut_names(c: Column, i: Column) -> Column:
            name = F.concat(F.lit("candidates["), i.cast("string"), F.lit("]."))
            return F.array_compact(F.array(*[F.when(F.length(c[f]) > n, F.concat(name, F.lit(f))) for f, n in limits.items()]))

        names = F.concat(
            F.when(F.length(x["summary"]) > summary_chars, F.array(F.lit("summary"))).otherwise(none),
            F.when(x["count"] > max_candidates, F.array(F.lit("candidates"))).otherwise(none),
            F.flatten(F.transform(x["candidates"], cut_names)))
        short = F.transform(x["candidates"], lambda c: F.struct(*[F.left(c[f], F.lit(n)).alias(f) for f, n in limits.items()]))
        text = (F.trim(x["summary"]) != "") | F.exists(
            x["candidates"], lambda c: (F.trim(c["title"]) != "") | (F.trim(c["description"]) != "") | (F.trim(c["recommended_fix"]) != ""))
        return let(names, lambda cut: F.struct(
            F.nullif(F.left(x["summary"], F.lit(summary_chars)), F.lit("")).alias("summary"), short.alias("candidates"), cut.alias("truncated_fields"),
            (F.size(cut) > 0).alias("truncated"), (text & (F.size(cut) == 0)).alias("evaluation_ready")))

    redacted = F.transform(F.slice(given, 1, max_candidates), lambda c: F.struct(*[safe(c[f]).alias(f) for f in limits]))
    whole = F.struct(safe(summary).alias("summary"), redacted.alias("candidates"), F.coalesce(F.size(given), F.lit(0)).alias("count"))
    return let(whole, build)


# ------------------------------------------------------------ semantic normal forms
SENTENCE_END = r"(?<=[.!?])\s+|[;\n]+"


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def semantic_v20(text: Column) -> Column:
    return _collapse(F.replace(F.lower(text), F.lit("\\"), F.lit("/")))


def _semantic_words(text: Column, morphology: dict[str, str]) -> Column:
    spaced = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("/")), WORD_BOUNDARY, " ")
    plain = F.regexp_replace(F.lower(spaced), r"(?U)[^\w]+", " ")
    table = F.create_map(*[F.lit(x) for kv in morphology.items() for x in kv])
    tokens = F.filter(F.split(plain, " "), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def semantic_v21(text: Column) -> Column:
    return _semantic_words(text, V.MORPHOLOGY_V21)


def semantic_v22(text: Column) -> Column:
    open_forms = F.regexp_replace(F.regexp_replace(text, "doesn['’]t", "does not"), "can['’]t", "cannot")
    return _semantic_words(open_forms, V.MORPHOLOGY_V22)


NORMAL_FORMS = {"v20": semantic_v20, "v21": semantic_v21, "v22": semantic_v22}


def clauses(text: Column, version: str) -> Column:
    """Normalised, non-empty clauses of one text part in order."""
    form = NORMAL_FORMS[version]
    # the first version splits the text it has already normalised
    source = form(text) if version == "v20" else text
    return F.filter(F.transform(F.split(source, SENTENCE_END, -1), form), lambda c: c != "")


# -------------------------------------------------------------------- numbers
def ratio(numerator: Column, denominator: Column) -> Column:
    """Rounded to four places; 0.0 when there is nothing to divide by."""
    return F.when(denominator > 0, F.round(numerator / denominator, 4)).otherwise(F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, F.round(numerator / denominator, 4))


def sum_known(value: Column) -> Column:
    """Sum of the known values; null when none is known."""
    return F.sum(value)


def sum_if_all_known(value: Column) -> Column:
    """Sum only when every row knows its value; null otherwise or without rows."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
