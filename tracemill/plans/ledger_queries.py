"""Registered ledger queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import ledger as L
from tracemill.plans import bindings as B
from tracemill.plans.bindings import AS_OF, AS_OF_LEDGER, with_tables
from tracemill.plans.episode_queries import REC_SQL, records

DAY = "strftime({}, '%Y-%m-%d')"


def _quality(spark, sf):
    return L.quality_from_verdicts(B.verdicts(spark, sf))


def _stored(spark, sf):
    """Customers stand in for the artifacts that orders' verdicts speak of."""
    c = B.table(spark, sf, "customer")
    created = F.to_timestamp(F.lit("1995-01-01 00:00:00")) + F.make_dt_interval((F.col("c_custkey") * 2).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), created.alias("created_at"))


def _broken(spark, sf):
    q = _quality(spark, sf)
    bad = F.col("artifact_id") % 3 == 0
    return q.withColumns({"used": F.when(bad, F.col("used") + 2000).otherwise(F.col("used")), "quality": F.when(F.col("artifact_id") % 5 == 0, F.lit(1.7)).otherwise(F.col("quality"))}).select("artifact_id", "returned", "used", "rejected", "quality")


def _attribution(spark, sf):
    s = B.savings(spark, sf).withColumn("protocol", F.when(F.col("passthrough"), "anthropic").otherwise("openai"))
    s = s.withColumn("agent", F.when(F.col("agent") == "N", "unknown").otherwise(F.col("agent")))
    known = s.where("agent <> 'unknown' AND (protocol = 'openai' OR agent = 'A')").select("protocol", "agent").distinct()
    return L.attribute_unknown(s, known).groupBy("protocol", "agent").agg(F.count("*").alias("requests"))


def _settled(spark, sf):
    v = B.verdicts(spark, sf)
    turn = F.col("artifact_id") % 3
    decided = v.select("recall_id", "artifact_id", F.when(turn == 0, "used").when(turn == 1, "unused").otherwise("rejected").alias("outcome"))
    return L.settle(v, decided).groupBy("outcome").agg(F.count("*").alias("verdicts"), F.sum("recall_id").alias("ids"))


QUERIES = {
    "ledger_recall_stats": lambda s, d: L.recall_totals(B.recalls(s, d)),
    "ledger_project_stats": lambda s, d: L.recalls_by_project(B.recalls(s, d)),
    "ledger_agent_breakdown": lambda s, d: L.recalls_by_agent(B.recalls(s, d)),
    "ledger_recall_trend": lambda s, d: L.recall_trend(B.recalls(s, d), AS_OF),
    "ledger_recent_recalls": lambda s, d: L.recent_recalls(B.recalls(s, d)),
    "ledger_agent_desk": lambda s, d: L.agent_desk(B.recalls(s, d), B.savings(s, d)),
    "context_efficiency": lambda s, d: L.context_efficiency(B.recalls(s, d)),
    "context_totals": lambda s, d: L.context_totals(B.recalls(s, d)),
    "session_efficiency": lambda s, d: L.session_efficiency(L.session_stats(records(s, d))),
    "recent_sessions": lambda s, d: L.recent_sessions(L.session_stats(records(s, d))),
    "roi_overall": lambda s, d: L.roi_overall(B.turn_metrics(s, d)),
    "roi_trend": lambda s, d: L.roi_trend(B.turn_metrics(s, d)),
    "onboarding_status": lambda s, d: L.onboarding_status(B.memory_store(s, d)),
    "savings_summary": lambda s, d: L.savings_summary(B.savings(s, d)),
    "savings_series": lambda s, d: L.savings_series(B.savings(s, d)),
    "savings_by_agent": lambda s, d: L.savings_by_agent(B.savings(s, d)),
    "savings_by_type": lambda s, d: L.savings_by_type(B.savings(s, d)),
    "savings_liveness": lambda s, d: L.liveness(B.savings(s, d), True, "1998-01-01 00:00:00"),
    "savings_attribution": _attribution,
    "corpus_summary": lambda s, d: L.corpus_summary(B.artifacts(s, d)),
    "project_rollup": lambda s, d: L.project_rollup(B.artifacts(s, d), B.recalls(s, d)),
    "context_saved": lambda s, d: L.context_saved(B.artifacts(s, d), B.recalls(s, d)),
    "quality_from_verdicts": _quality,
    "quality_leaderboard": lambda s, d: L.quality_leaderboard(_quality(s, d)),
    "verdict_shares": lambda s, d: L.verdict_shares(B.verdicts(s, d)),
    "verdict_settlement": _settled,
    "quality_decay": lambda s, d: L.decay_quality(_quality(s, d), AS_OF_LEDGER),
    "stale_memories": lambda s, d: L.stale_memories(_stored(s, d), _quality(s, d), "2001-06-01 00:00:00"),
    "count_repair": lambda s, d: L.repair_counts(_broken(s, d)),
    "recall_counts": lambda s, d: L.record_recalls(B.verdicts(s, d)),
}

_QUALITY = """quality AS (SELECT *, CASE WHEN used > judged OR rejected > judged THEN 0.5e0
    ELSE greatest(0e0, least(1e0, (used - rejected + 1)::DOUBLE / (judged + 2))) END AS quality
  FROM (SELECT artifact_id, count(*) AS returned, count(*) FILTER (WHERE outcome <> 'pending') AS judged,
          count(*) FILTER (WHERE outcome = 'used') AS used, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
          max(created_at) AS last_recalled FROM verdicts GROUP BY 1))"""
_TURN_AVG = "avg(tool_call_count) FILTER (WHERE {}had_recall)"
_AGENTS = """by_agent AS (SELECT agent, count(*) FILTER (WHERE NOT passthrough) AS requests,
  count(*) FILTER (WHERE passthrough) AS passed_through,
  coalesce(sum(tokens_before) FILTER (WHERE NOT passthrough), 0) AS tokens_before,
  coalesce(sum(tokens_before - tokens_after) FILTER (WHERE NOT passthrough), 0) AS tokens_saved,
  count(*) FILTER (WHERE NOT passthrough) < 30 AS low_sample FROM savings GROUP BY 1)"""


_STATS = """, stats AS (SELECT session_id, min(project) AS project, count(*) FILTER (WHERE is_prompt) AS turn_count,
  count(*) FILTER (WHERE is_prompt AND had_recall) AS recall_turn_count, sum(input_tokens + cache_read_tokens + cache_creation_tokens)::BIGINT AS total_input_tokens,
  sum(output_tokens)::BIGINT AS total_output_tokens, sum(tool_calls)::BIGINT AS tool_call_count, max(ts) AS last_turn_at FROM rec GROUP BY 1)"""


def _q(names, query, *extra):
    return "WITH " + ",\n".join([B.CTE[n] for n in names.split()] + list(extra)) + "\n" + query


ORACLE_SQL = {
    "ledger_recall_stats": with_tables("recalls", """SELECT count(*) AS total, sum(tokens_injected) AS tokens,
  round(avg(latency_ms), 3) AS avg_latency_ms, round(count(*) FILTER (WHERE hits_count > 0) / count(*)::DOUBLE, 3) AS hit_rate FROM recalls"""),
    "ledger_project_stats": with_tables("recalls", """SELECT project, count(*) AS recalls, sum(tokens_injected) AS tokens,
  round(avg(top_score) FILTER (WHERE hits_count > 0), 6) AS avg_score, count(*) FILTER (WHERE status = 'ok') AS ok,
  count(*) FILTER (WHERE status = 'extractive_only') AS extractive_only, count(*) FILTER (WHERE status = 'no_hits') AS no_hits
  FROM recalls GROUP BY project"""),
    "ledger_agent_breakdown": with_tables("recalls", """SELECT coalesce(agent, 'claude') AS agent, count(*) AS recalls,
  sum(tokens_injected) AS tokens, count(*) FILTER (WHERE hits_count > 0) AS with_hits FROM recalls GROUP BY 1"""),
    "ledger_recall_trend": with_tables("recalls", f"""SELECT {DAY.format('timestamp')} AS day, count(*) AS recalls,
  sum(tokens_injected) AS tokens, round(avg(latency_ms), 6) AS avg_latency_ms FROM recalls
  WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1"""),
    "ledger_recent_recalls": with_tables("recalls", "SELECT id, project, hits_count, status FROM recalls ORDER BY timestamp DESC, id DESC LIMIT 50"),
    "ledger_agent_desk": _q("recalls savings", """SELECT coalesce(r.agent, s.agent) AS agent, coalesce(recalls, 0) AS recalls,
  coalesce(tokens_injected, 0) AS tokens_injected, coalesce(sessions, 0) AS sessions, coalesce(requests, 0) AS requests,
  coalesce(tokens_saved, 0) AS tokens_saved
  FROM (SELECT coalesce(agent, 'claude') AS agent, count(*) AS recalls, sum(tokens_injected) AS tokens_injected,
               count(DISTINCT session_id) AS sessions FROM recalls GROUP BY 1) r
  FULL JOIN by_agent s ON r.agent = s.agent""", _AGENTS),
    "context_efficiency": with_tables("recalls", """SELECT session_id, count(*) AS prompts, sum(tokens_injected) AS injected,
  round(count(*) FILTER (WHERE hits_count > 0) / count(*)::DOUBLE, 3) AS coverage,
  round(100.0 * sum(tokens_injected) / 200000, 6) AS overhead_pct, rtrim(rtrim(strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS first_seen
  FROM recalls GROUP BY session_id ORDER BY max(timestamp) DESC, session_id LIMIT 50"""),
    "context_totals": with_tables("recalls", """SELECT count(DISTINCT session_id) AS sessions, count(*) AS prompts, sum(tokens_injected) AS injected,
  round(sum(tokens_injected) / count(*)::DOUBLE, 6) AS per_prompt FROM recalls"""),
    "session_efficiency": "WITH " + REC_SQL + _STATS + """ SELECT *, CASE WHEN avg_input_per_turn_without_recall > 0
    THEN round((1 - avg_input_per_turn_with_recall / avg_input_per_turn_without_recall) * 100, 1) ELSE 0.0 END AS efficiency_gain_pct
  FROM (SELECT count(*) AS total_sessions, count(*) FILTER (WHERE recall_turn_count > 0) AS sessions_with_recall, count(*) FILTER (WHERE recall_turn_count = 0) AS sessions_without_recall,
    coalesce(round(sum(total_input_tokens) / sum(turn_count)), 0) AS avg_input_per_turn,
    coalesce(round(sum(total_input_tokens) FILTER (WHERE recall_turn_count > 0) / sum(turn_count) FILTER (WHERE recall_turn_count > 0)), 0) AS avg_input_per_turn_with_recall,
    coalesce(round(sum(total_input_tokens) FILTER (WHERE recall_turn_count = 0) / sum(turn_count) FILTER (WHERE recall_turn_count = 0)), 0) AS avg_input_per_turn_without_recall,
    coalesce(round(sum(tool_call_count) FILTER (WHERE recall_turn_count > 0) / sum(turn_count) FILTER (WHERE recall_turn_count > 0), 1), 0) AS avg_tool_calls_with_recall,
    coalesce(round(sum(tool_call_count) FILTER (WHERE recall_turn_count = 0) / sum(turn_count) FILTER (WHERE recall_turn_count = 0), 1), 0) AS avg_tool_calls_without_recall
    FROM stats WHERE turn_count > 0)""",
    "recent_sessions": "WITH " + REC_SQL + _STATS + """ SELECT session_id, project, turn_count, recall_turn_count, tool_call_count,
  round(total_input_tokens / turn_count) AS avg_input_per_turn, recall_turn_count > 0 AS has_recall
  FROM stats WHERE turn_count > 0 ORDER BY last_turn_at DESC, session_id LIMIT 50""",
    "roi_overall": with_tables("turn_metrics", f"""SELECT count(*) FILTER (WHERE had_recall) AS turns_with, count(*) FILTER (WHERE NOT had_recall) AS turns_without,
  round({_TURN_AVG.format('')}, 6) AS avg_with, round({_TURN_AVG.format('NOT ')}, 6) AS avg_without,
  round(100 * ({_TURN_AVG.format('NOT ')} - {_TURN_AVG.format('')}) / ({_TURN_AVG.format('NOT ')}), 6) AS reduction_pct FROM turn_metrics"""),
    "roi_trend": with_tables("turn_metrics", f"""SELECT {DAY.format('user_timestamp')} AS day, count(*) FILTER (WHERE had_recall) AS turns_with,
  count(*) FILTER (WHERE NOT had_recall) AS turns_without, round({_TURN_AVG.format('')}, 6) AS avg_with,
  round({_TURN_AVG.format('NOT ')}, 6) AS avg_without FROM turn_metrics GROUP BY 1
  HAVING count(*) FILTER (WHERE had_recall) > 0 AND count(*) FILTER (WHERE NOT had_recall) > 0"""),
    "onboarding_status": with_tables("chunks memories", """SELECT chunks, memories, distilled, CASE WHEN chunks = 0 THEN 'no_data' WHEN memories = 0 THEN 'ingesting'
  WHEN distilled > 0 THEN 'full' ELSE 'extractive' END AS status FROM (SELECT count(*) AS chunks FROM chunks),
  (SELECT count(*) AS memories, count(*) FILTER (WHERE mem_type IN ('decision', 'lesson', 'snippet', 'bugfix')) AS distilled FROM memories)"""),
    "savings_summary": with_tables("savings", """SELECT count(*) AS requests, sum(tokens_before) AS tokens_before, sum(tokens_after) AS tokens_after,
  count(*) FILTER (WHERE passthrough) AS passed_through,
  round(100.0 * (sum(tokens_before) - sum(tokens_after)) / sum(tokens_before), 6) AS saved_pct FROM savings"""),
    "savings_series": with_tables("savings", f"""SELECT *, sum(saved) OVER (ORDER BY day) AS running FROM (
  SELECT {DAY.format('timestamp')} AS day, count(*) AS requests, sum(greatest(0, tokens_before - tokens_after)) AS saved
  FROM savings WHERE NOT passthrough GROUP BY 1)"""),
    "savings_by_agent": _q("savings", "SELECT * FROM by_agent", _AGENTS),
    "savings_by_type": with_tables("savings", """SELECT content_type, sum(content_count) AS payloads, count(*) AS requests,
  count(*) FILTER (WHERE NOT passthrough) AS compressed FROM savings GROUP BY 1"""),
    "savings_liveness": with_tables("savings", """SELECT requests, code_payloads, CASE WHEN requests = 0 THEN 'pending' WHEN code_payloads = 0 AND requests >= 40 THEN 'not_taking_effect'
  WHEN code_payloads = 0 THEN 'pending' ELSE 'live' END AS state FROM (SELECT count(*) AS requests, coalesce(sum(content_count) FILTER (WHERE starts_with(content_type, 'code')), 0) AS code_payloads
  FROM savings WHERE timestamp >= TIMESTAMP '1998-01-01')"""),
    "savings_attribution": with_tables("savings", """, s AS (SELECT CASE WHEN passthrough THEN 'anthropic' ELSE 'openai' END AS protocol,
  CASE WHEN agent = 'N' THEN 'unknown' ELSE agent END AS agent FROM savings),
  known AS (SELECT DISTINCT protocol, agent FROM s WHERE agent <> 'unknown' AND (protocol = 'openai' OR agent = 'A')),
  sole AS (SELECT protocol, any_value(agent) AS sole FROM known GROUP BY 1 HAVING count(*) = 1)
  SELECT s.protocol, CASE WHEN agent = 'unknown' THEN coalesce(sole, agent) ELSE agent END AS agent, count(*) AS requests
  FROM s LEFT JOIN sole ON s.protocol = sole.protocol GROUP BY 1, 2"""),
    "corpus_summary": with_tables("chunks notes artifacts", """SELECT kind, count(*) AS artifacts, sum(token_count) AS tokens,
  count(DISTINCT project) AS projects, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM artifacts GROUP BY 1"""),
    "project_rollup": with_tables("chunks notes artifacts recalls", """SELECT coalesce(s.project, r.project) AS project, coalesce(artifacts, 0) AS artifacts,
  coalesce(chunks, 0) AS chunks, coalesce(notes, 0) AS notes, coalesce(tokens, 0) AS tokens, coalesce(recalls, 0) AS recalls
  FROM (SELECT project, count(*) AS artifacts, count(*) FILTER (WHERE kind = 'session_chunk') AS chunks,
               count(*) FILTER (WHERE kind = 'note') AS notes, sum(token_count) AS tokens FROM artifacts GROUP BY 1) s
  FULL JOIN (SELECT project, count(*) AS recalls FROM recalls GROUP BY 1) r ON s.project = r.project"""),
    "context_saved": with_tables("chunks notes artifacts recalls", """SELECT u.project, recalled_tokens, full_tokens, greatest(0, full_tokens - recalled_tokens) AS saved_tokens
  FROM (SELECT project, sum(tokens_injected) AS recalled_tokens FROM recalls WHERE hits_count > 0 GROUP BY 1) u
  JOIN (SELECT project, sum(token_count) AS full_tokens FROM artifacts GROUP BY 1) f ON u.project = f.project"""),
    "quality_from_verdicts": _q("verdicts", "SELECT * FROM quality", _QUALITY),
    "quality_leaderboard": _q("verdicts", "SELECT * FROM quality ORDER BY judged DESC, quality DESC, artifact_id LIMIT 50", _QUALITY),
    "verdict_shares": with_tables("verdicts", "SELECT count(*) AS verdicts, count(*) FILTER (WHERE outcome <> 'pending') AS judged, " + ", ".join(
        f"round(count(*) FILTER (WHERE outcome = '{o}') / (count(*) FILTER (WHERE outcome <> 'pending'))::DOUBLE, 6) AS {o}_share" for o in ("used", "unused", "rejected")) + " FROM verdicts"),
    "verdict_settlement": with_tables("verdicts", """SELECT CASE WHEN outcome <> 'pending' THEN outcome WHEN artifact_id % 3 = 0 THEN 'used' WHEN artifact_id % 3 = 1 THEN 'unused' ELSE 'rejected' END AS outcome,
  count(*) AS verdicts, sum(recall_id) AS ids FROM verdicts GROUP BY 1"""),
    "quality_decay": _q("verdicts", f"""SELECT artifact_id, quality, round(d, 12) AS decayed, d < 0.03 AS retired FROM (
  SELECT *, quality * power(0.5e0, greatest(0, floor(date_diff('day', last_recalled::DATE, DATE '{AS_OF_LEDGER[:10]}') / 14e0))) AS d FROM quality)""", _QUALITY),
    "stale_memories": _q("verdicts", """SELECT id, created_at, last_recalled FROM (SELECT c_custkey AS id,
  TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(c_custkey * 2 AS INTEGER)) AS created_at FROM customer) c LEFT JOIN quality q ON c.id = q.artifact_id
  WHERE (last_recalled IS NULL OR last_recalled < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY) AND created_at < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY""", _QUALITY),
    "count_repair": _q("verdicts", """SELECT artifact_id, returned, CASE WHEN bad THEN 0 ELSE used END AS used, CASE WHEN bad THEN 0 ELSE rejected END AS rejected,
  CASE WHEN bad THEN greatest(0e0, least(1e0, 1e0 / (returned + 2)))
       WHEN quality > 1 THEN CASE WHEN used > returned OR rejected > returned THEN 0.5e0 ELSE greatest(0e0, least(1e0, (used - rejected + 1)::DOUBLE / (returned + 2))) END
       ELSE quality END AS quality, bad OR quality > 1 AS repaired
  FROM (SELECT *, used > returned OR rejected > returned AS bad FROM (SELECT artifact_id, returned, rejected,
          CASE WHEN artifact_id % 3 = 0 THEN used + 2000 ELSE used END AS used,
          CASE WHEN artifact_id % 5 = 0 THEN 1.7e0 ELSE quality END AS quality FROM quality))""", _QUALITY),
    "recall_counts": with_tables("verdicts", "SELECT artifact_id, count(*) AS recall_count, max(created_at) AS last_recalled FROM verdicts GROUP BY 1"),
}
ORACLE_SQL["savings_attribution"] = ORACLE_SQL["savings_attribution"].replace("\n, s AS", ",\n s AS")
