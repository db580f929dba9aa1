"""What models and runs wrote: memories and verdicts as JSON inside prose, evaluation runs, the state of a recall.

Outputs are read leniently and without failing: an output that holds no JSON is a row with an error, not an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of distilled memories, those that show that a project was distilled, questions kept, outcomes.
MEMORY_TYPES = ("decision", "bugfix", "lesson", "snippet", "preference", "fact")
DISTILLED = ("decision", "lesson", "snippet", "bugfix")
MAX_QUESTIONS = 3
OUTCOMES, DOUBT = ("win", "tie", "loss"), 0.5
NO_JSON = "no JSON"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _string(value: Column, path: str) -> Column:
    """The string at a path; other JSON values are none."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def fenced_json(raw: Column) -> Column:
    """VARIANT of the first fenced block, or of the whole text without one; null if that is no JSON."""
    fence = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
    return F.try_parse_json(_trimmed(F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).otherwise(raw)))


def braced_json(raw: Column) -> Column:
    """VARIANT from the first opening brace to the last closing one, or of the whole text without them; null if that is no JSON."""
    braces = r"(?s)\{.*\}"
    return F.try_parse_json(F.when(raw.rlike(braces), F.regexp_extract(raw, braces, 0)).otherwise(raw))


def memories_in(outputs: DataFrame, with_questions: bool = False, key: str = "id") -> DataFrame:
    """(key, place, type, value, fact, questions, error) of the memories in (key, raw).

    A memory needs a known type and a value and a fact that are not blank; others are left out. An output without
    JSON is one row with an error and no place.
    """
    read = outputs.select(key, fenced_json(F.col("raw")).alias("v"))
    m = F.col("m")
    rows = read.select(key, F.posexplode(F.try_variant_get("v", "$.memories", "array<variant>")).alias("place", "m"))
    string = lambda q: F.when(F.schema_of_variant(q) == "STRING", _trimmed(q.cast("string")))
    asked = F.filter(F.transform(F.try_variant_get(m, "$.questions", "array<variant>"), string), lambda q: F.coalesce(q, F.lit("")) != "")
    questions = F.coalesce(F.slice(asked, 1, MAX_QUESTIONS), F.array().cast("array<string>")) if with_questions else F.array().cast("array<string>")
    found = rows.select(key, "place", _string(m, "$.type").alias("type"), _trimmed(_string(m, "$.value")).alias("value"), _trimmed(_string(m, "$.fact")).alias("fact"), questions.alias("questions"))
    found = found.where(F.col("type").isin(*MEMORY_TYPES) & (F.col("value") != "") & (F.col("fact") != "")).withColumn("error", F.lit(None).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    failed = read.where("v IS NULL").select(key, none("int").alias("place"), *[none("string").alias(c) for c in ("type", "value", "fact")], F.array().cast("array<string>").alias("questions"), F.lit(NO_JSON).alias("error"))
    return found.unionByName(failed)


def verdicts_in(outputs: DataFrame, key: str = "id") -> DataFrame:
    """(key, outcome, reasoning, confidence, error) of (key, raw): unknown outcomes are ties, a missing confidence is one half."""
    read = outputs.select(key, braced_json(F.col("raw")).alias("v"))
    told = F.lower(_trimmed(F.coalesce(_string(F.col("v"), "$.outcome"), F.lit("tie"))))
    known = F.col("v").isNotNull()
    return read.select(
        key, F.when(known, F.when(told.isin(*OUTCOMES), told).otherwise("tie")).alias("outcome"),
        F.when(known, F.coalesce(_string(F.col("v"), "$.reasoning"), F.lit(""))).alias("reasoning"),
        F.when(known, F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(DOUBT))).alias("confidence"),
        F.when(~known, NO_JSON).alias("error"),
    )


def recall_status(recalls: DataFrame, store: DataFrame) -> DataFrame:
    """``recalls`` (project, hits_count, ...) with ``served_status``: ok, extractive_only or no_hits.

    A recall with hits is ok where its project has an active memory of a distilled type in ``store``.
    """
    distilled = store.where((F.col("kind") == "memory") & F.col("active") & F.col("mem_type").isin(*DISTILLED)).groupBy("project").agg(F.lit(True).alias("_distilled"))
    status = F.when(F.coalesce("hits_count", F.lit(0)) <= 0, "no_hits").when(F.col("_distilled"), "ok").otherwise("extractive_only")
    return recalls.join(distilled, "project", "left").withColumn("served_status", status).drop("_distilled")


def status_line(status: Column, project: Column, hits: Column, tokens: Column, score: Column) -> Column:
    """The line under recalled context that says how the recall went."""
    found = F.format_string("recalled %d memories (%d tokens, %.2f top score)", hits, tokens, score)
    return (
        F.when(status.isin("ok", "extractive_only"), found).when(status == "no_hits", F.concat(F.lit('no relevant memories for project "'), project, F.lit('" yet')))
        .when(status == "empty_db", "the memory store is empty").when(status == "no_embedder", "inactive without an embedding model")
        .when(status == "skipped_trivial", "skipped a trivial prompt").otherwise(F.concat(F.lit("status="), status))
    )


def latest_evaluations(runs: DataFrame) -> DataFrame:
    """(type, id, created_at, metrics): the last run (id, created_at, config, metrics as JSON) of every type that a config names."""
    typed = runs.withColumn("type", F.get_json_object("config", "$.type")).where("type IS NOT NULL")
    return typed.groupBy("type").agg(F.max_by(F.struct("id", "created_at", "metrics"), F.struct("created_at", "id")).alias("r")).select("type", "r.*")


def is_real_prompt(kind: Column, content: Column) -> Column:
    """True for what a person typed: content (JSON) that is a non-blank string, or a list with text and without tool results."""
    types = F.transform(F.from_json(F.when(content.startswith("["), content), "array<struct<type:string>>"), lambda b: b["type"])
    typed = F.coalesce(F.array_contains(types, "text") & ~F.exists(types, lambda t: t.eqNullSafe("tool_result")), F.lit(False))
    plain = content.startswith('"') & F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"].rlike(r"\S")
    return F.coalesce((kind == "user") & (plain | typed), F.lit(False))
