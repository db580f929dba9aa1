"""Registered queries over episodes and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import episodes as E
from tracemill.plans import bindings as B

BOUNDARY = "2024-01-03 00:00:00"
RECALL_BOUNDARY = "2024-01-15 00:00:00"


def records(spark, sf):
    c = B.table(spark, sf, "conversations")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    chars = F.length("text").cast("long")
    assistant = F.col("role") == "assistant"
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", (F.col("role") == "user").alias("is_prompt"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"), at.alias("ts"), (F.col("conv_id") % 2 == 0).alias("had_recall"),
        chars.alias("chars"), F.when(assistant, chars % 15).otherwise(0).alias("tool_calls"),
        F.when(assistant, chars % 7 * 100).otherwise(0).alias("cache_read_tokens"), F.when(assistant, chars % 3 * 10).otherwise(0).alias("cache_creation_tokens"),
        F.when(assistant, 0).otherwise(F.floor(chars / 4)).cast("long").alias("input_tokens"), F.when(assistant, F.floor(chars / 4)).otherwise(0).cast("long").alias("output_tokens"),
    )


def _eps(s, d):
    return E.episodes(records(s, d))


def _signups(s, d):
    e = B.table(s, d, "events")
    return e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("started_at"), F.col("event_id").alias("episode_id"))


def _errors(s, d):
    return B.table(s, d, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("recall_id"), "ts")


def _keyed(s, d):
    """Recalls of every session with a click and every conversation key of a signed-up user, whatever their number."""
    r = B.recalls(s, d).withColumn("conversation_key", F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
    e = B.table(s, d, "events")
    sessions = e.where("event_type = 'click'").select(F.col("user_id").alias("session_id"), F.lit(None).cast("string").alias("conversation_key"))
    keys = e.where("event_type = 'signup'").select(F.lit(None).cast("long").alias("session_id"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("conversation_key"))
    return E.recalls_of(r, sessions.unionByName(keys)).groupBy("project").agg(F.count("*").alias("recalls"), F.sum("id").alias("ids"))


QUERIES = {
    "episodes": _eps,
    "episode_arm_stats": lambda s, d: E.arm_stats(_eps(s, d)),
    "episode_arm_compare": lambda s, d: E.compare_arms(_eps(s, d)),
    "stratified_deltas": lambda s, d: E.stratified_deltas(_eps(s, d)),
    "stratum_verdict": lambda s, d: E.stratum_verdict(_eps(s, d)),
    "cost_compare": lambda s, d: E.cost_compare(_eps(s, d), BOUNDARY),
    "cost_verdict": lambda s, d: E.cost_verdict(_eps(s, d), BOUNDARY),
    "recall_did": lambda s, d: E.recall_did(B.recalls(s, d), _eps(s, d), BOUNDARY),
    "retrieval_health": lambda s, d: E.retrieval_health(B.recalls(s, d), RECALL_BOUNDARY),
    "recall_asof_episode": lambda s, d: E.asof_join(_errors(s, d), _signups(s, d), "user_id", "ts", "started_at", "episode_id").select("recall_id", "episode_id"),
    "recall_interval_turns": lambda s, d: E.near_in_time(
        B.table(s, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts"), B.table(s, d, "events").where("event_type = 'view'").select("user_id", "ts"), "user_id", 3600, "ts", "ts"
    ).select("event_id"),
    "conversation_key_join": _keyed,
    "turn_pairs": lambda s, d: E.pair_turns(records(s, d)).select("session_id", "ord", "user_ord"),
}

REC_SQL = """rec AS (SELECT conv_id AS session_id, turn AS ord, role, role = 'user' AS is_prompt, 'p' || (conv_id % 5) AS project,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS ts, conv_id % 2 = 0 AS had_recall, length(text) AS chars,
  CASE WHEN role = 'assistant' THEN length(text) % 15 ELSE 0 END AS tool_calls,
  CASE WHEN role = 'assistant' THEN length(text) % 7 * 100 ELSE 0 END AS cache_read_tokens,
  CASE WHEN role = 'assistant' THEN length(text) % 3 * 10 ELSE 0 END AS cache_creation_tokens,
  CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS input_tokens,
  CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS output_tokens FROM conversations)"""
_EP = """ep AS (SELECT *, input_tokens + cache_read_tokens + cache_creation_tokens + output_tokens AS total_tokens,
  round(input_tokens + 1.25::DOUBLE * cache_creation_tokens + 0.1::DOUBLE * cache_read_tokens + 5.0::DOUBLE * output_tokens, 6) AS cost_units
  FROM (SELECT session_id, episode, min(project) AS project, min(ts) AS started_at, max(ts) AS ended_at,
  bool_or(had_recall) AS had_recall, max(chars) FILTER (WHERE is_prompt) AS prompt_chars, count(*) FILTER (WHERE role = 'assistant') AS assistant_steps,
  sum(tool_calls)::BIGINT AS tool_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
  sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(output_tokens)::BIGINT AS output_tokens
  FROM (SELECT *, sum(is_prompt::INT) OVER (PARTITION BY session_id ORDER BY ord) AS episode FROM rec) WHERE episode > 0 GROUP BY 1, 2)),
use AS (SELECT * FROM ep WHERE assistant_steps > 0)"""
_W, _O = "FILTER (WHERE had_recall)", "FILTER (WHERE NOT had_recall)"
#: Written from the rules: positive is less work with recall, or less cost after the boundary.
_ARMS = f"""arms AS (SELECT project, overall, n_with, n_without, n_with >= 20 AND n_without >= 20 AS scored,
  CASE WHEN n_with >= 20 AND n_without >= 20 THEN round(CASE WHEN overall THEN (mo - mw) / nullif(mo, 0) ELSE (o - w) / nullif(o, 0) END * 100, 1) END AS tool_call_delta_pct,
  CASE WHEN n_with >= 20 AND n_without >= 20 THEN round((ton - tw) / nullif(ton, 0) * 100, 1) END AS token_delta_pct
  FROM (SELECT project, grouping(project) = 1 AS overall, count(*) {_W} AS n_with, count(*) {_O} AS n_without, median(tool_calls) {_W} AS w, median(tool_calls) {_O} AS o,
    avg(tool_calls) {_W} AS mw, avg(tool_calls) {_O} AS mo, median(total_tokens) {_W} AS tw, median(total_tokens) {_O} AS ton
    FROM use GROUP BY GROUPING SETS ((project), ())))"""
_STRATA = f"""strata AS (SELECT b.i AS stratum, b.name AS prompt_chars, coalesce(n_with, 0) AS n_with, coalesce(n_without, 0) AS n_without,
  coalesce(n_with >= 20 AND n_without >= 20, false) AS scored, CASE WHEN n_with >= 20 AND n_without >= 20 THEN round(100 * (o - w) / nullif(o, 0), 1) END AS tool_call_delta_pct
  FROM (VALUES (0, '0-60', 0, 60), (1, '60-150', 60, 150), (2, '150-400', 150, 400), (3, '400-+', 400, 1000000000)) b(i, name, lo, hi)
  LEFT JOIN (SELECT CASE WHEN prompt_chars < 60 THEN 0 WHEN prompt_chars < 150 THEN 1 WHEN prompt_chars < 400 THEN 2 ELSE 3 END AS i,
    count(*) {_W} AS n_with, count(*) {_O} AS n_without, avg(tool_calls) {_W} AS w, avg(tool_calls) {_O} AS o FROM use GROUP BY 1) c ON c.i = b.i)"""
_AT = f"started_at >= TIMESTAMP '{BOUNDARY}'"
_BANDS = f"""bands AS (SELECT b.i AS tool_band, b.name AS tool_calls, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after,
  coalesce(n_before >= 15 AND n_after >= 15, false) AS scored, round(coalesce(b, 0), 6) AS median_cost_before, round(coalesce(a, 0), 6) AS median_cost_after,
  CASE WHEN n_before >= 15 AND n_after >= 15 THEN round(100 * (b - a) / nullif(b, 0), 1) END AS cost_delta_pct
  FROM (VALUES (0, '0-1'), (1, '1-4'), (2, '4-12'), (3, '12-+')) b(i, name)
  LEFT JOIN (SELECT CASE WHEN tool_calls < 1 THEN 0 WHEN tool_calls < 4 THEN 1 WHEN tool_calls < 12 THEN 2 ELSE 3 END AS i,
    count(*) FILTER (WHERE NOT {_AT}) AS n_before, count(*) FILTER (WHERE {_AT}) AS n_after,
    median(cost_units) FILTER (WHERE NOT {_AT}) AS b, median(cost_units) FILTER (WHERE {_AT}) AS a FROM use GROUP BY 1) c ON c.i = b.i)"""


def _q(query, *parts):
    return "WITH " + ",\n".join([REC_SQL, _EP, *parts]) + "\n" + query


def _gap(side):
    n = "count(*) FILTER (WHERE {side} AND {no} had_recall)"
    m = "median(tool_calls) FILTER (WHERE {side} AND {no} had_recall)"
    with_, without = (x.format(side=side, no="") for x in (n, m)), (x.format(side=side, no="NOT") for x in (n, m))
    (nw, mw), (no, mo) = with_, without
    return f"CASE WHEN {nw} >= 30 AND {no} >= 30 THEN round(100 * ({mo} - {mw}) / nullif({mo}, 0), 1) END"


ORACLE_SQL = {
    "episodes": _q("SELECT * FROM ep"),
    "episode_arm_stats": _q("SELECT had_recall, count(*) AS n, " + ", ".join(f"round(median({c})::DOUBLE, 6) AS median_{c}" for c in ("tool_calls", "total_tokens", "assistant_steps", "prompt_chars")) + ", round(avg(tool_calls), 2) AS mean_tool_calls, round(avg(total_tokens)) AS mean_total_tokens FROM use GROUP BY 1"),
    "episode_arm_compare": _q("SELECT * FROM arms", _ARMS),
    "stratified_deltas": _q("SELECT * FROM strata", _STRATA),
    "stratum_verdict": _q("""SELECT scored, n AS scored_cells, d AS tool_call_delta_pct, CASE WHEN NOT scored OR n < 2 THEN 'insufficient_data' WHEN signs > 1 OR d IS NULL OR abs(d) < 10 THEN 'no_effect'
  WHEN d > 0 THEN 'saves' ELSE 'costs' END AS verdict FROM (SELECT scored, tool_call_delta_pct AS d FROM arms WHERE overall),
  (SELECT count(*) AS n, count(DISTINCT tool_call_delta_pct > 0) AS signs FROM strata WHERE scored AND tool_call_delta_pct IS NOT NULL)""", _ARMS, _STRATA),
    "cost_compare": _q("SELECT * FROM bands", _BANDS),
    "cost_verdict": _q(f"""SELECT n_before, n_after, n AS scored_cells, d AS cost_delta_pct, CASE WHEN n < 2 THEN 'insufficient_data' WHEN signs > 1 OR d IS NULL OR abs(d) < 10 THEN 'no_effect'
  WHEN d > 0 THEN 'cheaper' ELSE 'dearer' END AS verdict FROM (SELECT n_before, n_after, round(100 * (b - a) / nullif(b, 0), 1) AS d FROM (
    SELECT count(*) FILTER (WHERE NOT {_AT}) AS n_before, count(*) FILTER (WHERE {_AT}) AS n_after, median(cost_units) FILTER (WHERE NOT {_AT}) AS b,
    median(cost_units) FILTER (WHERE {_AT}) AS a FROM use)), (SELECT count(*) AS n, count(DISTINCT cost_delta_pct > 0) AS signs FROM bands WHERE scored AND cost_delta_pct IS NOT NULL)""", _BANDS),
    "recall_did": _q(f"""SELECT *, CASE WHEN recalls_after = 0 THEN 'no_data_yet' WHEN recalls_after < 50 THEN 'too_early' WHEN did_pp IS NULL THEN 'retrieval_only'
  WHEN abs(did_pp) < 6 THEN 'no_effect' WHEN did_pp > 0 THEN 'improved' ELSE 'regressed' END AS verdict FROM (SELECT *, round(gap_after - gap_before, 1) AS did_pp
  FROM (SELECT count(*) FILTER (WHERE timestamp < TIMESTAMP '{BOUNDARY}') AS recalls_before, count(*) FILTER (WHERE timestamp >= TIMESTAMP '{BOUNDARY}') AS recalls_after FROM recalls),
       (SELECT count(*) FILTER (WHERE NOT {_AT}) AS episodes_before, count(*) FILTER (WHERE {_AT}) AS episodes_after,
               {_gap("NOT " + _AT)} AS gap_before, {_gap(_AT)} AS gap_after FROM use))""", B.CTE["recalls"]),
    "retrieval_health": B.with_tables("recalls", f"""SELECT CASE WHEN timestamp < TIMESTAMP '{RECALL_BOUNDARY}' THEN 'before' ELSE 'after' END AS side, count(*) AS recalls,
  round(count(*) FILTER (WHERE hits_count > 0) / count(*)::DOUBLE, 3) AS hit_rate, round(coalesce(median(coalesce(top_score, 0)) FILTER (WHERE hits_count > 0), 0), 3) AS median_top_score,
  round(coalesce((median(coalesce(tokens_injected, 0)) FILTER (WHERE hits_count > 0))::DOUBLE, 0), 1) AS median_tokens, count(*) >= 50 AS scored FROM recalls GROUP BY 1"""),
    "recall_asof_episode": """SELECT l.event_id AS recall_id, r.event_id AS episode_id FROM (SELECT * FROM events WHERE event_type = 'error') l
  ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "recall_interval_turns": """SELECT event_id FROM events t WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = t.user_id
  AND abs(epoch_us(r.ts) - epoch_us(t.ts)) < 3600000000)""",
    "conversation_key_join": B.with_tables("recalls", """SELECT project, count(*) AS recalls, sum(id) AS ids FROM recalls
  WHERE session_id IN (SELECT user_id FROM events WHERE event_type = 'click') OR id % 97 IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1"""),
    "turn_pairs": _q("""SELECT session_id, ord, user_ord FROM (SELECT session_id, ord, role, lag(role) OVER w AS b, lag(ord) OVER w AS user_ord FROM rec
  WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY ord)) WHERE role = 'assistant' AND b = 'user'"""),
}
