"""Chat formatting and its exact inverse, in Spark expressions only.

Adjacent turns of one role are one block:

    <|im_start|>role<|im_text|>text<|im_next|>text<|im_end|><|im_start|>...

A control string inside a role or text gets a backslash after its first character, one more
if it has some there already, so no text holds a control string and a plain split reads the
output back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|im_start|>", "<|im_text|>", "<|im_next|>", "<|im_end|>"
#: Control strings of this template and of others; all of them are escaped inside texts.
CONTROL = [START, TEXT, NEXT, END, "<|im_sep|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "|[]<>/\\" else c for c in text)


_RESTS = "|".join(sorted({_quoted(c[1:].lstrip("<")) for c in CONTROL}, key=lambda r: (-len(r), r)))
ESCAPE = rf"([<\[])(\\*)({_RESTS})"
UNESCAPE = rf"([<\[])\\(\\*)({_RESTS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, formatted string and loss_spans.

    Rows are ordered by turn (null first), then role, then text; repeated rows are turns of their
    own.  Null roles and texts are empty.  loss_spans lists (start, length), in code points of the
    formatted string from 0, of each text of ``loss_role``; markers are outside.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumns({"n": F.row_number().over(order), "before": F.lag("role").over(order)})
    head = (F.when(F.col("before").isNull(), F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT)))
            .when(F.col("before") == F.col("role"), F.lit(NEXT))
            .otherwise(F.concat(F.lit(END + START), escape(F.col("role")), F.lit(TEXT))))
    parts = placed.select("conv", "n", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    so_far = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("end", F.sum((F.length("head") + F.length("body")).cast("long")).over(so_far))
    turn = F.struct("n", "head", "body", (F.col("role") == loss_role).alias("loss"), "end")
    chat = parts.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    formatted = F.concat(F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"])), ""), F.lit(END))
    spans = F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(
        (t["end"] - F.length(t["body"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))
    return chat.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array of (role, text)."""
    blocks = F.filter(F.split(formatted, _quoted(END)), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.regexp_extract(b, rf"(?s){_quoted(TEXT)}(.*)$", 1), _quoted(NEXT)),
        lambda t: F.struct(unescape(F.regexp_extract(b, rf"(?s)^{_quoted(START)}(.*?){_quoted(TEXT)}", 1)).alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
