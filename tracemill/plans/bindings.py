"""How the supplied tables stand in for the engine's own: once as DataFrames, once as SQL for the oracle.

All times are UTC; ``AS_OF`` takes the place of the current time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.curation import classify

AS_OF = "2024-02-01 00:00:00"
AS_OF_LEDGER = "2001-12-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall ledger, from ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    hits = F.col("k") % 9
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("agent"),
        F.col("user_id").alias("session_id"),
        hits.alias("hits_count"),
        (F.col("value") / 500).alias("top_score"),
        (F.col("k") * 10).alias("tokens_injected"),
        F.col("value").alias("latency_ms"),
        F.when(hits == 0, "no_hits").when(hits % 2 == 0, "ok").otherwise("extractive_only").alias("status"),
    )


def turn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"),
        F.col("event_id").alias("turn_idx"),
        F.col("ts").alias("user_timestamp"),
        (k % 6).alias("tool_call_count"),
        (k % 2 == 0).alias("had_recall"),
    )


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The savings ledger, from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("log", "json", "search", "code:python", "text"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return li.select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("agent"),
        F.floor("l_extendedprice").cast("long").alias("tokens_before"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("tokens_after"),
        (F.col("l_linestatus") == "O").alias("passthrough"),
        F.create_map(kind, F.col("l_linenumber").cast("long")).alias("content_types"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict ledger, from ``orders``."""
    o = table(spark, sf_dir, "orders")
    outcome = (
        F.when(F.col("o_orderstatus") == "F", "used")
        .when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderkey") % 2 == 0, "rejected")
        .otherwise("unused")
    )
    return o.select(
        F.col("o_orderkey").alias("recall_id"),
        F.col("o_custkey").alias("artifact_id"),
        outcome.alias("outcome"),
        F.col("o_orderdate").alias("created_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session chunks, from ``conversations`` without system turns."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit("session_chunk").alias("kind"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("ord"),
        "role",
        "text",
        F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("token_count"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))).alias("created_at"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("note").alias("kind"),
        F.col("source").alias("project"),
        "text",
        F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("token_count"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).drop("session_id", "ord", "role").unionByName(notes(spark, sf_dir))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories, one per assistant turn of at least 15 tokens, typed by its cues."""
    c = chunks(spark, sf_dir).where("role = 'assistant' AND token_count >= 15")
    return c.select(
        F.concat(F.lit("mem:"), F.col("id")).alias("id"), F.lit("memory").alias("kind"), "project", "session_id", "ord", "text", "token_count", "created_at",
        classify(F.col("text")).alias("mem_type"),
    )


def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and memories, all active."""
    kept = ["id", "kind", "project", "text", "token_count", "created_at", "mem_type"]
    c = chunks(spark, sf_dir).withColumn("mem_type", F.lit(None).cast("string"))
    return c.select(*kept).unionByName(memories(spark, sf_dir).select(*kept)).withColumn("active", F.lit(True))


def note_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as memories: the source is the project, the label the quality, one half without one."""
    rated = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("rated"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").join(rated, "doc_id", "left")
    return d.select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("project"),
        "text",
        F.col("doc_id").alias("ord"),
        F.coalesce("rated", F.lit(0.5)).alias("quality"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
    )


#: The same, as common table expressions.
CTE = {
    "recalls": """recalls AS (SELECT event_id AS id, ts AS timestamp, 'p' || (user_id % 7) AS project,
  CASE WHEN event_type <> 'view' THEN event_type END AS agent, user_id AS session_id, k % 9 AS hits_count,
  value / 500 AS top_score, k * 10 AS tokens_injected, value AS latency_ms,
  CASE WHEN k % 9 = 0 THEN 'no_hits' WHEN k % 9 % 2 = 0 THEN 'ok' ELSE 'extractive_only' END AS status
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))""",
    "turn_metrics": """turn_metrics AS (SELECT user_id AS session_id, 'p' || (user_id % 7) AS project, event_id AS turn_idx,
  ts AS user_timestamp, k % 6 AS tool_call_count, k % 2 = 0 AS had_recall
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))""",
    "savings": """savings AS (SELECT l_shipdate AS timestamp, l_returnflag AS agent,
  CAST(floor(l_extendedprice) AS BIGINT) AS tokens_before,
  CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS tokens_after, l_linestatus = 'O' AS passthrough,
  ['log', 'json', 'search', 'code:python', 'text'][l_linenumber % 5 + 1] AS content_type,
  CAST(l_linenumber AS BIGINT) AS content_count FROM lineitem)""",
    "verdicts": """verdicts AS (SELECT o_orderkey AS recall_id, o_custkey AS artifact_id,
  CASE WHEN o_orderstatus = 'F' THEN 'used' WHEN o_orderstatus = 'O' THEN 'pending'
       WHEN o_orderkey % 2 = 0 THEN 'rejected' ELSE 'unused' END AS outcome, o_orderdate AS created_at FROM orders)""",
    "chunks": """chunks AS (SELECT conv_id || ':' || turn AS id, 'session_chunk' AS kind, 'p' || (conv_id % 5) AS project,
  conv_id AS session_id, turn AS ord, role, text, greatest(1, length(text) // 4) AS token_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at
  FROM conversations WHERE role <> 'system')""",
    "notes": """notes AS (SELECT 'd:' || doc_id AS id, 'note' AS kind, source AS project, text,
  greatest(1, length(text) // 4) AS token_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at FROM documents)""",
    "memories": """memories AS (SELECT 'mem:' || id AS id, 'memory' AS kind, project, session_id, ord, text, token_count, created_at,
  CASE WHEN regexp_matches(text, '(?i)(the fix is|root cause|the bug was|the issue was|caused by|the problem is|this fails because|the error occurs)') THEN 'bugfix'
       WHEN regexp_matches(text, '(?i)(we decided|the approach is|instead of|switched to|chose .+ over|trade-?off|architecture:|design decision)') THEN 'decision'
       WHEN regexp_matches(text, '(?i)(always use|never use|never do|important:|note:|pattern:|best practice|lesson learned|rule of thumb|should always|should never)') THEN 'lesson'
       WHEN contains(text, '```') AND length(text) > 200 THEN 'snippet' ELSE 'extract' END AS mem_type
  FROM chunks WHERE role = 'assistant' AND token_count >= 15)""",
    "note_memories": """note_memories AS (SELECT 'd:' || doc_id AS id, source AS project, text, doc_id AS ord, coalesce(rated, 0.5) AS quality,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents LEFT JOIN (SELECT doc_id, CAST(max(quality) AS DOUBLE) AS rated FROM labels GROUP BY 1) USING (doc_id) WHERE text IS NOT NULL)""",
    "artifacts": """artifacts AS (SELECT id, kind, project, text, token_count, created_at FROM chunks
  UNION ALL SELECT id, kind, project, text, token_count, created_at FROM notes)""",
}


def with_tables(names: str, query: str) -> str:
    """``query`` after the named table expressions; it may begin with a comma and more of them."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + query
