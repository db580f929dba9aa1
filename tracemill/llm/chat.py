"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply is
trainable. All examples of a conversation are prefixes of one formatted stream, so the stream is written once,
with the spans of its examples; ``expanded_examples`` explodes them into rows of text and loss mask. Readers
that take a mask's text alone never hold the contexts, which would grow with the square of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace

#: The template's marks, and the control strings of common templates that texts may hold.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])|<(?=</?SYS>>)"


def escape(text: Column) -> Column:
    """Break control strings with a backslash after their first character; backslashes are doubled."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> one row per turn with its formatted segment and its place in the stream.

    Turns go by number (null first), ties by role and text, so equal rows keep one result. Null roles and
    texts count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(SEP))
    body = escape(text)
    segments = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.length(head).cast("long").alias("head_chars"),
        F.length(body).cast("long").alias("body_chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    chars = F.length("segment").cast("long")
    return segments.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        "role",
        "segment",
        (F.sum(chars).over(order.rowsBetween(Window.unboundedPreceding, 0)) - chars).alias("start"),
        chars.alias("chars"),
        "head_chars",
        "body_chars",
    )


def example_span() -> Column:
    reply = F.col("start") + F.col("head_chars")
    return F.struct("place", reply.alias("loss_start"), (reply + F.col("body_chars")).alias("loss_end"), (F.col("start") + F.col("chars")).alias("example_chars"))


def chat_streams(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``stream``, and ``examples``, an array of (place, loss_start, loss_end, example_chars).

    A conversation is one row of the output, so its turns meet in one task; its size is that of its texts, not
    of the expanded contexts. An empty table gives no rows; a null conv_id is a conversation of its own; rows
    that repeat are turns of their own; more columns of ``turns`` are left out.
    """
    example = F.when(F.col("role") == "assistant", example_span())
    return format_turns(turns).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "segment"))), lambda s: s["segment"]), "").alias(
            "stream"
        ),
        F.array_sort(F.collect_list(example)).alias("examples"),
    )


def expanded_examples(streams: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, place, text (context and reply, as formatted), loss_start, loss_end.

    The loss mask covers the characters of ``text`` from ``loss_start`` up to ``loss_end``.
    """
    return streams.select("conv_id", "stream", F.explode("examples").alias("e")).select(
        "conv_id",
        F.col("e.place").alias("place"),
        F.expr("substring(stream, 1, int(e.example_chars))").alias("text"),
        F.col("e.loss_start").alias("loss_start"),
        F.col("e.loss_end").alias("loss_end"),
    )


def masked_text() -> Column:
    """The text under an example's loss mask, as written by the user."""
    return unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))"))


def read_turns(stream: Column) -> Column:
    """The array of (role, text) that a stream holds."""
    parts = F.filter(F.split(stream, r"<\|im_end\|>"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.struct(
            unescape(F.substring_index(F.substring(s, len(OPEN) + 1, 1 << 30), SEP, 1)).alias("role"),
            unescape(F.regexp_replace(s, r"(?s)^.*?<\|im_sep\|>", "")).alias("text"),
        ),
    )


def op10_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    streams = Workspace(spark, "chat").table("streams", chat_streams(turns.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    whole = streams.select("conv_id", read_turns(F.col("stream")).alias("turns"), F.length("stream").cast("long").alias("formatted_chars")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), "formatted_chars"
    )
    examples = expanded_examples(streams).select("conv_id", F.struct("place", masked_text().alias("reply")).alias("loss"), F.length("text").cast("long").alias("chars"))
    read = whole.unionByName(examples, allowMissingColumns=True).groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda e: e["reply"]), "").alias("loss"),
        F.max("formatted_chars").alias("formatted_chars"),
        F.count("chars").alias("n_examples"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("expanded_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "expanded_chars",
    )


_MARKS = len(OPEN) + len(SEP) + len(CLOSE)
_ESC = r"""regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||/s>|s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), '<(\||/s>|s>)', '<\\\1', 'g')"""
OP10_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, {_MARKS} + length({_ESC.format('role')}) + length({_ESC.format('text')}) AS chars,
         row_number() OVER w AS place
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant') AS n_examples,
       coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM placed GROUP BY conv_id
"""
