"""Request bodies of coding agents: tool payloads, the calls they answer, and bodies with new texts in their places.

A body is JSON of one of two shapes. In blocks ("anthropic"), a user message's content is a list in which
``tool_result`` blocks answer the ``tool_use`` blocks of assistant messages; in messages ("openai"), messages of role
``tool`` answer the ``tool_calls`` of assistant messages. Bodies are read as VARIANT: messages, blocks and calls are
exploded with their places, so a path tells where every payload came from, and texts go back by that path.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.workspace import Workspace
from tracemill.operators.compress import compress_payloads

#: Arguments of a call that name its file, the first that does counts; the mark of a rewritten payload.
FILE_KEYS = ("file_path", "notebook_path", "path", "filePath", "filename", "file")
MARK, ID_CHARS = "[stored:", 32
BLOCKS, MESSAGES = "anthropic", "openai"


def _of(value: Column, path: str, kind: str) -> Column:
    """The value at a path, or null where there is none or it is of another kind."""
    return F.try_variant_get(value, path, kind)


def _text(value: Column, path: str) -> Column:
    """A JSON string at a path; other JSON values are no text."""
    return F.when(F.schema_of_variant(_of(value, path, "variant")) == "STRING", _of(value, path, "string"))


def _file(arguments: Column) -> Column:
    """The file that a call's arguments name: a JSON object, or a string that holds one."""
    packed = F.when(F.schema_of_variant(arguments) == "STRING", F.try_parse_json(arguments.cast("string"))).otherwise(arguments)
    named = [_text(packed, f"$.{key}") for key in FILE_KEYS]
    return F.coalesce(*[F.when(F.trim(n) != "", n) for n in named])


def messages_of(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, provider, message, role, value) per message of (key, provider, body); bodies that are no JSON, or without messages, have none."""
    listed = F.expr("try_variant_get(try_parse_json(body), '$.messages', 'array<variant>')")
    rows = requests.select(key, "provider", F.posexplode(listed).alias("message", "value"))
    return rows.select(key, "provider", "message", _text(F.col("value"), "$.role").alias("role"), "value")


def calls_of(messages: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, call_id, tool, file_path) of the calls in assistant messages; of calls that share an id the last counts."""
    said = messages.where("role = 'assistant'")

    def listed(provider: str, path: str) -> DataFrame:
        own = said.where(F.col("provider") == provider)
        return own.select(key, "message", F.posexplode(_of(F.col("value"), path, "array<variant>")).alias("place", "c"))

    c = F.col("c")
    used = listed(BLOCKS, "$.content").where(_text(c, "$.type") == "tool_use")
    used = used.select(key, "message", "place", _text(c, "$.id").alias("call_id"), _text(c, "$.name").alias("tool"), _file(_of(c, "$.input", "variant")).alias("file_path"))
    called = listed(MESSAGES, "$.tool_calls")
    called = called.select(
        key, "message", "place", _text(c, "$.id").alias("call_id"), _text(c, "$.function.name").alias("tool"), _file(_of(c, "$.function.arguments", "variant")).alias("file_path")
    )
    tool = F.when(F.coalesce("tool", F.lit("")) == "", "unknown").otherwise(F.col("tool"))
    last = F.max_by(F.struct(tool.alias("tool"), "file_path"), F.struct("message", "place")).alias("c")
    return used.unionByName(called).where("call_id IS NOT NULL").groupBy(key, "call_id").agg(last).select(key, "call_id", "c.tool", "c.file_path")


def _parts(value: Column) -> Column:
    """Text of a result: a string, or a list whose strings and text blocks are put together; null for anything else."""
    block = lambda b: F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).when(_text(b, "$.type") == "text", F.coalesce(_text(b, "$.text"), F.lit("")))
    listed = _of(value, "$", "array<variant>")
    joined = F.array_join(F.filter(F.transform(listed, block), lambda t: t.isNotNull()), "")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).when(listed.isNotNull(), joined)


def payloads_of(requests: DataFrame, latest_only: bool = False, key: str = "request_id") -> DataFrame:
    """Tool payloads of (key, provider, body), with the call they answer and whether no later payload is of the same file.

    Columns: key, provider, message, place (of the block, null in messages), call_id, text, tool, file_path,
    is_latest. ``latest_only`` keeps those of the last user message, or the tool messages at a body's end; is_latest
    is of all in any case. Payloads without a file, or of unknown calls, count as latest. Keys are unique.
    """
    messages = messages_of(requests, key)
    value, block = F.col("value"), F.col("block")
    # what a body ends with is told by two aggregates, not by sorting its messages
    ends = messages.groupBy(key).agg(F.max(F.when(F.col("role") == "user", F.col("message"))).alias("last_user"), F.max(F.when(F.col("role").eqNullSafe("tool"), None).otherwise(F.col("message"))).alias("last_other"))
    told = messages.where((F.col("provider") == BLOCKS) & (F.col("role") == "user"))
    told = told.select(key, "provider", "message", F.posexplode(_of(value, "$.content", "array<variant>")).alias("place", "block")).where(_text(block, "$.type") == "tool_result")
    told = told.select(key, "provider", "message", "place", _text(block, "$.tool_use_id").alias("call_id"), _parts(_of(block, "$.content", "variant")).alias("text"))
    said = messages.where((F.col("provider") == MESSAGES) & (F.col("role") == "tool"))
    said = said.select(key, "provider", "message", F.lit(None).cast("int").alias("place"), _text(value, "$.tool_call_id").alias("call_id"), _text(value, "$.content").alias("text"))
    found = told.unionByName(said).where("text IS NOT NULL").join(calls_of(messages, key), [key, "call_id"], "left")
    later = F.row_number().over(Window.partitionBy(key, "file_path").orderBy(F.desc("message"), F.desc("place")))
    found = found.withColumn("is_latest", F.col("file_path").isNull() | (later == 1))
    if latest_only:
        last = F.when(F.col("provider") == BLOCKS, F.col("message") == F.col("last_user")).otherwise(F.col("message") > F.coalesce("last_other", F.lit(-1)))
        found = found.join(ends, key).where(last).drop("last_user", "last_other")
    return found.select(key, "provider", "message", "place", "call_id", "text", "tool", "file_path", "is_latest")


def stored_id(text: Column) -> Column:
    """The id of a text by its content, 32 hex digits: equal texts have equal marks, so rewritten bodies stay stable."""
    return F.substring(F.sha2(text, 256), 1, ID_CHARS)


@F.pandas_udf(T.StringType())
def _with_texts(bodies: pd.Series, changes: pd.Series) -> pd.Series:
    """Bodies with texts set at (message, place) or, without a place, as the content of a message; all else as it was."""

    def one(body, rows):
        if rows is None or not len(rows):
            return body
        held = json.loads(body)
        for row in rows:
            target = held["messages"][row["message"]]
            if row["place"] is not None and not pd.isna(row["place"]):
                target = target["content"][int(row["place"])]
            target["content"] = row["text"]
        return json.dumps(held, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(b, c) for b, c in zip(bodies, changes, strict=True)])


def with_texts(requests: DataFrame, changes: DataFrame, key: str = "request_id") -> DataFrame:
    """``requests`` with the texts of ``changes`` (key, message, place, text) in their bodies; bodies without any stay byte for byte."""
    listed = changes.groupBy(key).agg(F.collect_list(F.struct("message", "place", "text")).alias("_changes"))  # of one body
    return requests.join(listed, key, "left").withColumn("body", _with_texts("body", "_changes")).drop("_changes")


def compress_requests(requests: DataFrame, work: Workspace, latest_only: bool = True, key: str = "request_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bodies with compressed payloads; per request what it saved; stored originals).

    A payload that carries our mark already is left alone and counted nowhere. One whose compressed text with its
    mark is no shorter in tokens stays as it was, and nothing is stored for it. The summary has key, tokens_before,
    tokens_after, content_types (map of type to rewritten payloads) and passthrough (nothing rewritten); originals
    are (stored_id, text, content_type), each once.
    """
    own = F.concat_ws("/", F.col(key).cast("string"), F.col("message").cast("string"), F.coalesce(F.col("place").cast("string"), F.lit("")))
    fresh = work.table("fresh", payloads_of(requests, latest_only, key).where(~F.ltrim("text").startswith(MARK)).withColumn("id", own))
    done = compress_payloads(fresh.select("id", "text", F.col("file_path").alias("path")))
    marked = F.concat(F.lit(MARK), stored_id(F.col("text")), F.lit("]\n"), F.col("compressed"))
    rows = fresh.join(done, "id").withColumn("marked", marked).withColumn("marked_tokens", F.greatest(F.lit(1), F.floor(F.length("marked") / 4)).cast("long"))
    smaller = (F.col("compressed") != F.col("text")) & (F.col("marked_tokens") < F.col("tokens_before"))
    rows = work.table("rewritten", rows.withColumn("rewritten", smaller))
    work.drop("fresh")
    after = F.when(F.col("rewritten"), F.col("marked_tokens")).otherwise(F.col("tokens_before"))
    by_type = rows.groupBy(key, "content_type").agg(F.sum("tokens_before").alias("b"), F.sum(after).alias("a"), F.count_if("rewritten").alias("n"))
    kinds = F.map_from_entries(F.filter(F.sort_array(F.collect_list(F.struct("content_type", "n"))), lambda e: e["n"] > 0))  # as many as there are types
    sums = by_type.groupBy(key).agg(F.sum("b").alias("tokens_before"), F.sum("a").alias("tokens_after"), kinds.alias("content_types"), (F.sum("n") == 0).alias("passthrough"))
    none = F.create_map().cast("map<string,long>")
    summary = requests.select(key).join(sums, key, "left").select(
        key, F.coalesce("tokens_before", F.lit(0)).alias("tokens_before"), F.coalesce("tokens_after", F.lit(0)).alias("tokens_after"),
        F.coalesce("content_types", none).alias("content_types"), F.coalesce("passthrough", F.lit(True)).alias("passthrough"),
    )
    changed = rows.where("rewritten")
    bodies = work.table("bodies", with_texts(requests, changed.select(key, "message", "place", F.col("marked").alias("text")), key))
    stored = changed.select(stored_id(F.col("text")).alias("stored_id"), "text", "content_type").groupBy("stored_id").agg(F.min("text").alias("text"), F.min("content_type").alias("content_type"))
    return bodies, summary, stored


def restored(bodies: DataFrame, stored: DataFrame, key: str = "request_id") -> DataFrame:
    """``bodies`` with the stored originals back in the place of marked payloads: the way back of ``compress_requests``."""
    marked = payloads_of(bodies, key=key).where(F.ltrim("text").startswith(MARK))
    found = marked.withColumn("stored_id", F.substring(F.ltrim("text"), len(MARK) + 1, ID_CHARS)).drop("text").join(stored, "stored_id")
    return with_texts(bodies, found.select(key, "message", "place", "text"), key)


def questions_of(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, message, query): the text of the last user message, its strings and text blocks joined by line ends; blank ones are left out."""
    asked = messages_of(requests, key).where("role = 'user'").groupBy(key).agg(F.max_by(F.struct("message", _of(F.col("value"), "$.content", "variant").alias("content")), "message").alias("m"))
    content = F.col("m.content")
    block = lambda b: F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).when(_text(b, "$.type") == "text", _text(b, "$.text"))
    listed = F.filter(F.transform(_of(content, "$", "array<variant>"), block), lambda t: F.coalesce(t, F.lit("")) != "")
    query = F.when(F.schema_of_variant(content) == "STRING", content.cast("string")).otherwise(F.array_join(listed, "\n"))
    rows = asked.select(key, F.col("m.message").alias("message"), F.regexp_replace(query, r"^\s+|\s+$", "").alias("query"))
    return rows.where("query <> ''")


@F.pandas_udf(T.StringType())
def _with_memories(bodies: pd.Series, places: pd.Series, texts: pd.Series) -> pd.Series:
    """Bodies with a text after the content of a message: behind a string, or as a block more."""

    def one(body, place, text):
        if text is None or pd.isna(place):
            return body
        held = json.loads(body)
        message = held["messages"][int(place)]
        content = message["content"]
        message["content"] = [*content, {"type": "text", "text": text}] if isinstance(content, list) else f"{content}\n\n{text}"
        return json.dumps(held, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(*row) for row in zip(bodies, places, texts, strict=True)])


def inject_memories(requests: DataFrame, found: DataFrame, key: str = "request_id") -> DataFrame:
    """``requests`` with what was recalled for them (key, memories) after their last user message; others stay byte for byte."""
    at = questions_of(requests, key).select(key, F.col("message").alias("_at"))
    told = found.where(F.trim(F.coalesce("memories", F.lit(""))) != "").groupBy(key).agg(F.max("memories").alias("_told")).join(at, key)
    return requests.join(told, key, "left").withColumn("body", _with_memories("body", "_at", "_told")).drop("_at", "_told")
