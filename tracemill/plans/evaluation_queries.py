"""Registered queries over verdicts and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.operators import evaluation as V
from tracemill.plans import bindings as B
from tracemill.plans import retrieval_queries as R
from tracemill.plans import upkeep_queries as U_SQL


def verdicts(s, d):
    """Every user turn was served its own text; what the session says from then on settles it."""
    c = B.chunks(s, d)
    pending = c.where("role = 'user'").select(F.col("id").alias("recall_id"), F.col("id").alias("artifact_id"), "session_id", F.col("created_at").alias("since"), "text")
    return V.feedback_verdicts(pending, c.select("session_id", "role", F.col("created_at").alias("ts"), "text"))


def lexical_found(s, d):
    """The lexical channel, written once: labels and what is held against them are both read from it."""
    return Workspace(s, "found").table("lexical", R.lexical(s, d))


def relevant(lexical):
    """The five best of the lexical channel stand in for labels."""
    return lexical.where("rank <= 5")


def metrics(s, d):
    return V.ranking_metrics(R.dense(s, d), relevant(lexical_found(s, d)), 10)


def compared(s, d):
    lexical = lexical_found(s, d)
    labels = relevant(lexical)
    return V.win_tie_loss(V.ranking_metrics(R.dense(s, d), labels, 10), V.ranking_metrics(lexical, labels, 10), "ndcg")


def suite(s, d):
    lexical = lexical_found(s, d)
    dense = Workspace(s, "found").table("dense", R.dense(s, d))
    labels, tokens = relevant(lexical), B.chunks(s, d).select("id", "token_count")
    out = None
    for name, found in (("dense", dense), ("lexical", lexical)):
        sent = found.where("rank <= 10").join(tokens, "id").groupBy("query_id").agg(F.sum("token_count").alias("tokens_sent"))
        rows = V.ranking_metrics(found, labels, 10).join(sent, "query_id", "left").select(
            F.lit(name).alias("strategy"), "query_id", "recall", "ndcg", F.coalesce("tokens_sent", F.lit(0)).alias("tokens_sent"), (F.col("query_id") % 17).cast("double").alias("latency_ms")
        )
        out = rows if out is None else out.unionByName(rows)
    return V.suite_summary(out, F.lit(5000.0))


QUERIES = {
    "feedback_verdicts": verdicts,
    "ranking_metrics": metrics,
    "eval_suite": suite,
    "win_tie_loss": compared,
    "eval_cases": lambda s, d: V.eval_cases(B.chunks(s, d)),
}


def _any(text, phrases):
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in (q.replace("'", "''") for q in phrases)) + ")"


_REJECT = _any("lower(t.text)", (
    "no that's wrong", "that's not right", "that's incorrect", "that's outdated", "no, we", "no we", "actually we", "actually, we", "we switched", "we moved", "we changed",
    "we no longer", "that's not how", "not what i meant", "wrong approach", "we don't use", "we stopped using", "we dropped",
))
_CONTRA = _any("lower(t.text)", (
    "however, looking at the current code", "but the current implementation", "actually use", "actually uses", "instead of what the memory", "contrary to the recalled",
    "the memory is outdated", "this is no longer",
))
_METRICS = f"""{R._FUSED}, wanted AS (SELECT query_id, id FROM lexical WHERE rank <= 5), n AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY 1),
metrics AS (SELECT strategy, n.query_id, round(coalesce(hits / n.n::DOUBLE, 0), 9) AS recall,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n.n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg
  FROM n CROSS JOIN (VALUES ('dense'), ('lexical')) s(strategy) LEFT JOIN (SELECT strategy, query_id, count(DISTINCT id) AS hits, sum(1 / log2(rank + 1)) AS dcg
    FROM (SELECT 'dense' AS strategy, query_id, id, rank FROM dense UNION ALL SELECT 'lexical', query_id, id, rank FROM lexical) JOIN wanted USING (query_id, id)
    WHERE rank <= 10 GROUP BY ALL) g USING (strategy, query_id))"""

ORACLE_SQL = {
    "feedback_verdicts": B.with_tables("chunks", f""", p AS (SELECT id, session_id, created_at AS since, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w
  FROM chunks WHERE role = 'user' AND text <> ''),
j AS (SELECT p.id, p.w, t.role, lower(t.text) AS said, {_REJECT} AS rej, {_CONTRA} AS con FROM p JOIN chunks t ON t.session_id = p.session_id AND t.created_at >= p.since),
f AS (SELECT id, bool_or(role = 'user' AND rej) AS rejected, bool_or(role = 'assistant' AND con) AS contradicted FROM j GROUP BY id),
g AS (SELECT id, len(any_value(w)) - 2 AS n, count(DISTINCT k) AS found FROM (SELECT id, w, k, said FROM (SELECT id, w, said, unnest(range(1, len(w) - 1)) AS k FROM j WHERE role = 'assistant' AND len(w) >= 4)
  WHERE contains(said, array_to_string(w[k:k + 2], ' '))) GROUP BY id),
v AS (SELECT id, n, {U_SQL._VEC.format('du')} AS u, {U_SQL._VEC.format('da')} AS a FROM (SELECT p.id, any_value(len(p.w)) AS n, any_value({U_SQL._DIGITS.format("array_to_string(p.w, ' ')")}) AS du,
  {U_SQL._DIGITS.format("string_agg(j.said, ' ')")} AS da FROM p JOIN j USING (id) WHERE j.role = 'assistant' GROUP BY p.id)),
x AS (SELECT id, n >= 4 AND round(coalesce(list_sum(list_transform(range(1, 17), lambda i: u[i] * a[i])) / nullif(sqrt(list_sum(list_transform(u, lambda k: k * k))) * sqrt(list_sum(list_transform(a, lambda k: k * k))), 0), 0), 9) >= 0.45 AS alike FROM v),
o AS (SELECT p.id, coalesce(rejected, false) OR coalesce(contradicted, false) AS against, coalesce(found >= greatest(1, ceil(n * 0.1)), false) AS used, coalesce(alike, false) AS alike
  FROM p LEFT JOIN f USING (id) LEFT JOIN g USING (id) LEFT JOIN x USING (id))
SELECT id AS recall_id, id AS artifact_id, CASE WHEN against THEN 'rejected' WHEN used OR alike THEN 'used' ELSE 'unused' END AS outcome,
  CASE WHEN against THEN 'phrase' WHEN used THEN 'ngram' WHEN alike THEN 'semantic' ELSE '' END AS method FROM o"""),
    "ranking_metrics": B.with_tables("chunks", f", {_METRICS} SELECT query_id, recall, ndcg FROM metrics WHERE strategy = 'dense'"),
    "eval_suite": B.with_tables("chunks", f""", {_METRICS}, sent AS (SELECT strategy, query_id, sum(token_count) AS tokens_sent
  FROM (SELECT 'dense' AS strategy, query_id, id, rank FROM dense UNION ALL SELECT 'lexical', query_id, id, rank FROM lexical) JOIN chunks USING (id) WHERE rank <= 10 GROUP BY ALL),
r AS (SELECT m.*, coalesce(tokens_sent, 0) AS tokens_sent, (query_id % 17)::DOUBLE AS latency_ms FROM metrics m LEFT JOIN sent USING (strategy, query_id))
SELECT strategy, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(tokens_sent), 6) AS tokens_sent, round(1 - avg(tokens_sent) / 5000.0, 6) AS token_savings_vs_full,
  list_sort(list(latency_ms))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS latency_p50, list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS latency_p95 FROM r GROUP BY 1"""),
    "win_tie_loss": B.with_tables("chunks", f""", {_METRICS}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a.ndcg > b.ndcg) AS w, count(*) FILTER (WHERE a.ndcg = b.ndcg) AS t,
  count(*) FILTER (WHERE a.ndcg < b.ndcg) AS l FROM metrics a JOIN metrics b ON a.query_id = b.query_id AND a.strategy = 'dense' AND b.strategy = 'lexical')
SELECT n AS n_cases, w AS win_count, t AS tie_count, l AS loss_count, round(100 * w / n::DOUBLE, 1) AS win_pct, round(100 * t / n::DOUBLE, 1) AS tie_pct,
  round(100 * l / n::DOUBLE, 1) AS loss_pct, round(100 * (w + t) / n::DOUBLE, 1) AS do_no_harm_pct FROM c"""),
    "eval_cases": B.with_tables("chunks", """, s AS (SELECT project, session_id, arg_min(id, (ord, id)) AS opening_id, arg_min(created_at, (ord, id)) AS began, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY ALL),
p AS (SELECT *, count(*) OVER w AS prior_sessions, coalesce(sum(tokens) OVER w, 0)::BIGINT AS full_tokens FROM s
  WINDOW w AS (PARTITION BY project ORDER BY began, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT project, session_id, opening_id, prior_sessions, full_tokens FROM p WHERE prior_sessions >= 1"""),
}
