"""Registered queries over model outputs, evaluation runs and the state of recalls, on rows that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import outputs as O
from tracemill.plans import bindings as B
from tracemill.plans import ingest_queries as I
from tracemill.sources import transcripts as T

KINDS = (*O.MEMORY_TYPES, "rumour")


def distilled_outputs(s, d):
    """Documents as what a model made of them: JSON in a fence or bare, every fifth broken off."""
    n = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, KINDS)), (n % 7).cast("int"))
    memory = F.struct(kind.alias("type"), F.col("text").alias("value"), F.concat(F.lit(" fact "), n.cast("string")).alias("fact"), F.array(F.lit("why?"), F.lit(" "), F.lit("how?")).alias("questions"))
    body = F.to_json(F.struct(F.array(memory).alias("memories")))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))
    return B.table(s, d, "documents").select(n.alias("id"), F.when(n % 5 == 0, F.substring(body, F.lit(1), F.length(body) - 3)).when(n % 2 == 0, fenced).otherwise(body).alias("raw"))


def judged_outputs(s, d):
    """Events as verdicts of a judge in prose."""
    n = F.col("event_id")
    told = F.get(F.array(*map(F.lit, (" Win ", "tie", "LOSS", "draw"))), (n % 4).cast("int"))
    full = F.to_json(F.struct(told.alias("outcome"), F.col("event_type").alias("reasoning"), F.col("value").alias("confidence")))
    bare = F.to_json(F.struct(told.alias("outcome")))
    raw = F.when(n % 11 == 0, "I can not tell").when(n % 3 == 0, bare).otherwise(F.concat(F.lit("So "), full, F.lit(" as I said")))
    return B.table(s, d, "events").select(n.alias("id"), raw.alias("raw"))


def _prompts(s, d):
    r = T.records(I.transcript_lines(s, d))
    return r.where(O.is_real_prompt(F.col("type"), F.col("content"))).groupBy("session_id").agg(F.count("*").alias("prompts"))


def _runs(s, d):
    o = B.table(s, d, "orders")
    config = F.to_json(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("type")))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), config.alias("config"), F.to_json(F.struct(F.col("o_custkey").alias("cases"))).alias("metrics"))


QUERIES = {
    "model_memories": lambda s, d: O.memories_in(distilled_outputs(s, d), True).select("id", "type", F.sha2("value", 256).alias("value_sha256"), "fact", F.array_join("questions", "|").alias("questions"), "error"),
    "model_verdicts": lambda s, d: O.verdicts_in(judged_outputs(s, d)).select("id", "outcome", "reasoning", F.round("confidence", 6).alias("confidence"), "error"),
    "recall_status": lambda s, d: O.recall_status(B.recalls(s, d), B.memory_store(s, d)).groupBy("project", "served_status").agg(F.count("*").alias("recalls")),
    "real_prompts": _prompts,
    "latest_evaluations": lambda s, d: O.latest_evaluations(_runs(s, d)).select("type", "id", F.get_json_object("metrics", "$.cases").cast("long").alias("cases")),
}

ORACLE_SQL = {
    "model_memories": r"""WITH t AS (SELECT doc_id AS id, (ARRAY['decision', 'bugfix', 'lesson', 'snippet', 'preference', 'fact', 'rumour'])[doc_id % 7 + 1] AS type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM documents)
SELECT id, type, sha256(v) AS value_sha256, 'fact ' || id AS fact, 'why?|how?' AS questions, NULL::VARCHAR AS error FROM t WHERE id % 5 <> 0 AND type <> 'rumour' AND v <> '' AND NOT (id % 2 = 0 AND contains(v, '```'))
UNION ALL SELECT id, NULL, NULL, NULL, '', 'no JSON' FROM t WHERE id % 5 = 0""",
    "model_verdicts": """SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (ARRAY['win', 'tie', 'loss', 'tie'])[event_id % 4 + 1] END AS outcome,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS reasoning, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 0.5 ELSE round(value, 6) END AS confidence,
  CASE WHEN event_id % 11 = 0 THEN 'no JSON' END AS error FROM events""",
    "recall_status": B.with_tables("recalls chunks memories", """SELECT project, CASE WHEN hits_count <= 0 THEN 'no_hits' WHEN project IN (SELECT project FROM memories WHERE mem_type IN ('decision', 'lesson', 'snippet', 'bugfix')) THEN 'ok' ELSE 'extractive_only' END AS served_status,
  count(*) AS recalls FROM recalls GROUP BY 1, 2"""),
    "real_prompts": r"""SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS prompts FROM conversations WHERE role = 'user' AND regexp_matches(text, '\S') GROUP BY 1""",
    "latest_evaluations": """SELECT o_orderpriority AS type, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS cases FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
}
