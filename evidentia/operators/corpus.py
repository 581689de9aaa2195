"""Files to chunks: fixed line windows for any text, declarations for code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.functions import values as V
from evidentia.session import computed_once

WINDOW_LINES = 40
WINDOW_OVERLAP = 5


def numbered_lines(files: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """One row per line: ``line_no`` from 1."""
    return files.select(
        *keys, F.posexplode(tx.lines_of(F.col(content))).alias("_pos", "line")
    ).select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def window_starts(n: Column) -> Column:
    """0-based starts of 40-line windows; the last one reaches the end."""
    step = WINDOW_LINES - WINDOW_OVERLAP
    last = F.greatest(F.ceil((n - WINDOW_LINES) / step) * step, F.lit(0)).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def line_windows(files: DataFrame, max_chars: int | None = None, max_file_chars: int | None = None) -> DataFrame:
    """Overlapping windows of (repo, file, content); end line is the window's, not the cut's.

    Windows and files are whole by default; ``max_chars`` cuts a window at a line,
    ``max_file_chars`` the file, and ``truncated`` marks the windows concerned.
    """
    text = F.col("content") if max_file_chars is None else F.left(F.col("content"), F.lit(max_file_chars))
    long_file = F.lit(False) if max_file_chars is None else F.length("content") > max_file_chars
    with_lines = computed_once(files.withColumn("_long", long_file), _lines=tx.lines_of(text))
    win = with_lines.select(
        "repo", "file", "_lines", "_long", F.explode(window_starts(F.size("_lines"))).alias("_start")
    )
    body = F.array_join(F.slice("_lines", F.col("_start") + 1, F.lit(WINDOW_LINES)), "\n")
    is_config = F.lower(tx.extension_of(F.col("file"))).isin(".xml", ".yml", ".yaml", ".properties")
    return win.select(
        "repo",
        "file",
        tx.language_of(F.col("file")).alias("language"),
        F.when(is_config, "config_block").otherwise("file_window").alias("chunk_type"),
        F.lit(None).cast("string").alias("symbol_name"),
        (F.col("_start") + 1).cast("bigint").alias("start_line"),
        F.least(F.col("_start") + WINDOW_LINES, F.size("_lines")).cast("bigint").alias("end_line"),
        tx.cut_at_line(body, max_chars).alias("content"),
        (F.col("_long") | (F.lit(False) if max_chars is None else F.length(body) > max_chars)).alias("truncated"),
    )


def finish_chunks(chunks: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Adds ``chunk_id`` and ``tokens`` (the first ``max_tokens``; None: all)."""
    symbol = F.col("_id_symbol") if "_id_symbol" in chunks.columns else F.col("symbol_name")
    return chunks.withColumn(
        "chunk_id",
        tx.chunk_id(F.col("file"), F.col("chunk_type"), symbol, F.col("start_line"), F.col("end_line")),
    ).withColumn("tokens", tx.chunk_tokens(F.col("content"), max_tokens)).drop("_id_symbol")


def chunk_corpus(
    files: DataFrame, max_chars: int | None = None, max_file_chars: int | None = None, max_tokens: int | None = None
) -> DataFrame:
    """Chunks of all indexable files: declarations of code, windows of the rest.

    Code without any declaration falls back to windows.  No text and no token is
    left out unless a limit is given.
    """
    from evidentia.operators.java import declaration_chunks

    indexable = files.where(tx.extension_of(F.col("file")).isin(*V.INDEXABLE_EXTENSIONS))
    is_code = F.endswith(F.col("file"), F.lit(".java"))
    code = declaration_chunks(indexable.where(is_code), max_chars, max_file_chars)
    plain = line_windows(indexable.where(~is_code), max_chars, max_file_chars).withColumn("_id_symbol", F.col("symbol_name"))
    return finish_chunks(code.unionByName(plain), max_tokens)


def window_corpus(files: DataFrame) -> DataFrame:
    """Chunks of non-code files only; no code branch in the plan."""
    return finish_chunks(line_windows(files))


def line_slice(
    files: DataFrame, content: Column, start: Column, end: Column, max_lines: int = 60, max_chars: int = 4000
) -> DataFrame:
    """A bounded excerpt: 0-based ``start`` up to ``end``, at most ``max_lines`` lines and ``max_chars`` characters.

    Out-of-range bounds fall back to the ends of the text.
    """
    df = computed_once(files, _lines=tx.lines_of(content))
    total = F.size("_lines")
    s = F.least(F.greatest(start, F.lit(0)), total).cast("int")
    e = F.when((end < 0) | (end > total), total).otherwise(end).cast("int")
    asked = F.greatest(e - s, F.lit(0))
    got = F.least(asked, F.lit(max_lines))
    df = computed_once(df, _s=s, _asked=asked, _got=got)
    df = computed_once(df, _body=F.array_join(F.slice("_lines", F.col("_s") + 1, F.col("_got")), "\n"))
    return df.select(
        *files.columns,
        total.cast("bigint").alias("total_lines"),
        (F.col("_s") + 1).cast("bigint").alias("first_line"),
        (F.col("_s") + F.col("_got")).cast("bigint").alias("last_line"),
        ((F.col("_asked") > max_lines) | (F.length("_body") > max_chars)).alias("truncated"),
        tx.cut_at_line(F.col("_body"), max_chars).alias("body"),
    )
