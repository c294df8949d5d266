"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of parts. Text parts that follow each other are joined and written as they are but for control
strings, which are escaped in the joined text, so none can be put together from parts;
image, audio and document parts become numbered placeholders, and what they refer to and how many tokens they expand to is
recorded beside the text. A turn reads ``<|im_start|>role``, a line feed, the content, ``<|im_end|>`` and a line feed.

Escaping: each run of backslashes between ``<`` and ``|`` gets one more, so no ``<|`` is left in a text, and taking one away
gives the text back. In a role, ``%``, line feeds and ``<|`` are percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens for one unit of a part: image tiles, seconds of audio, pages of a document.
RATES = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """Content of one text part; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["type"].isin(*RATES), F.lit(False))


def joined(parts: Column) -> Column:
    """``parts`` with each run of text parts (all but the types of ``RATES``) as one."""
    empty = F.array().cast(f"array<{PART}>")
    text = lambda p: F.coalesce(p["text"], F.lit(""))

    def step(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(F.lit("text").alias("type"), F.concat(text(last), text(p)).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
        return F.when((F.size(done) > 0) & _is_text(last) & _is_text(p), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(p)))

    typed = parts.cast(f"array<{PART}>")
    return F.when(F.size(typed) < 2, typed).otherwise(F.aggregate(typed, empty, step))


def _visit(part: Column) -> Column:
    """What a part writes, and its tokens: the visitor. An unknown type counts as a text part."""
    rate = F.coalesce(*[F.when(part["type"] == k, F.lit(v)) for k, v in RATES.items()])
    text = F.coalesce(part["text"], F.lit(""))
    return F.struct(
        F.when(rate.isNull(), escape(text)).otherwise(F.concat(F.lit("<|"), part["type"], F.lit("|>"))).alias("written"),
        rate.isNull().alias("is_text"),
        part["type"].alias("type"),
        part["ref"].alias("ref"),
        F.when(rate.isNotNull(), rate * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))).cast("bigint").alias("tokens"),
    )


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv, n_turns, formatted, loss_spans (code points, end exclusive) and attachments.

    ``parts``: array of ``PART``; null content is empty, so is a null text, and a part of unknown or null type is a text. Turns go by ``turn`` (null first), ties by role and content. The loss
    mask covers the texts of the ``learn_role``'s turns, a span for each run of text parts. An attachment has its place in the text, type, ref and tokens.
    A null ``conv`` is a conversation of its own; repeated rows are turns each; texts may have any length. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    no_parts = F.array().cast(f"array<{PART}>")
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), joined(F.coalesce(F.col(parts), no_parts)).alias("parts"))
    m = m.withColumn("seen", F.transform("parts", _visit))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    m = m.withColumn("head", head).withColumn("line", F.concat("head", F.array_join(F.col("seen.written"), ""), F.lit(END + "\n")))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "line")
    m = m.withColumn("pos", F.row_number().over(order))
    m = m.withColumn("base", F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    at = lambda i: F.col("base") + F.length(F.array_join(F.slice(F.col("seen.written"), F.lit(1), i), ""))
    placed = F.transform("seen", lambda s, i: F.struct(at(i).alias("start"), (at(i) + F.length(s["written"])).alias("end"), s["is_text"].alias("is_text"), s["type"].alias("type"), s["ref"].alias("ref"), s["tokens"].alias("tokens")))
    m = m.withColumn("placed", placed)
    spans = F.when(F.col("role") == learn_role, F.transform(F.filter("placed", lambda p: p["is_text"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    other = F.transform(F.filter("placed", lambda p: ~p["is_text"]), lambda p: F.struct(p["start"].alias("start"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    turns = F.array_sort(F.collect_list(F.struct("pos", "line", spans.alias("spans"), other.alias("other"))))
    out = m.groupBy("conv").agg(turns.alias("turns"))
    return out.select(
        F.col("conv").alias(conv),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.line"), "").alias("formatted"),
        F.flatten("turns.spans").alias("loss_spans"),
        F.flatten("turns.other").alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    lines = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    line = lambda x: F.substr(x, F.lit(len(START) + 1))
    return F.transform(lines, lambda x: F.struct(unescape_role(F.substring_index(line(x), "\n", 1)).alias("role"), unescape(F.substr(line(x), F.instr(line(x), F.lit("\n")) + 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
