"""Registered queries over keys, sessions' questions and the upkeep of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import curation as C
from tracemill.operators import upkeep as K
from tracemill.plans import bindings as B
from tracemill.plans import curation_queries as C_SQL


def _enriched(s, d):
    asked = B.chunks(s, d).where("role = 'user'").select("session_id", "ord", "id", "text")
    return K.enriched_queries(asked).select("id", F.sha2("enriched", 256).alias("enriched_sha256"))


def _votes(s, d):
    e = B.table(s, d, "events")
    return e.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("project"))


def _store(s, d):
    return B.artifacts(s, d).withColumn("active", F.lit(True)).withColumn("superseded_by", F.lit(None).cast("string"))


def _losers(s, d):
    """Repeated contents give way to their first row."""
    return C.duplicates(B.artifacts(s, d)).select("id", F.col("kept_id").alias("successor"))


def _memories(s, d):
    c = B.chunks(s, d)
    found = K.memories_of(c, C.chunk_scores(c), c.where("role = 'assistant'"))
    return found.select("id", "session_id", "project", "mem_type", "chunk_id")


def _paraphrases(s, d):
    c = B.chunks(s, d)
    asked = c.where("role = 'user'").select("session_id", F.col("ord").alias("_o"), F.col("text").alias("source"))
    said = c.where("role = 'assistant'").select("id", "session_id", (F.col("ord") - 1).alias("_o"), F.col("text").alias("answer"))
    return K.paraphrases(said.join(asked, ["session_id", "_o"])).select("id", "paraphrased")


QUERIES = {
    "conversation_keys": lambda s, d: K.conversation_keys(B.table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", "text")),
    "session_enrichment": _enriched,
    "project_vote": lambda s, d: K.majority(_votes(s, d), "session_id", "project"),
    "extractive_memories": _memories,
    "deactivate_duplicates": lambda s, d: K.deactivate(_store(s, d), _losers(s, d)).select("id", "active", "superseded_by"),
    "supersedes_edges": lambda s, d: K.supersedes_edges(_store(s, d), _losers(s, d)),
    "store_health": lambda s, d: K.store_health(B.memory_store(s, d)),
    "paraphrase_reuse": _paraphrases,
}

_STORE = """artifacts AS (SELECT id, kind, project, text, created_at FROM chunks UNION ALL SELECT id, kind, project, text, created_at FROM memories)"""
_COMPLEX = r"""CASE WHEN t = '' OR lower(rtrim(rtrim(t, '?!.,'))) IN ('yes', 'no', 'ok', 'okay', 'sure', 'thanks', 'thank you', 'ty', 'looks good', 'lgtm', 'continue', 'go ahead', 'do it', 'proceed',
    'correct', 'right', 'yep', 'yup', 'nope', 'agreed', 'sounds good', 'perfect', 'great', 'nice', 'cool', 'done', 'got it', 'k', 'yes please', 'no thanks') THEN 0.0::DOUBLE
  ELSE round(least(1.0::DOUBLE, 0.45::DOUBLE * n * n / (n * n + 36) + 0.2::DOUBLE * least(len(regexp_extract_all(t, '[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+|[A-Z]{2,}|\b\w+\.\w+\.\w+|\w+::\w+')) / 3.0::DOUBLE, 1.0)
  + 0.2::DOUBLE * least(len(regexp_extract_all(t, '[a-zA-Z0-9_\-]+/|\.\w{1,5}\b')) / 2.0::DOUBLE, 1.0) + CASE WHEN ends_with(t, '?') THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN regexp_matches(t, '(?i)(Error|Exception|Traceback|FAIL|panic|segfault|undefined|NaN|null|nil)\b') THEN 0.15::DOUBLE ELSE 0.0 END), 9) END"""
_VEC = """list_transform(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], lambda h: length({0}) - length(replace({0}, h, '')))"""
_DIGITS = "array_to_string(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda t: t <> ''), lambda t: right(sha256(t), 1)), '')"

ORACLE_SQL = {
    "conversation_keys": r"""SELECT conv_id AS session_id, CASE WHEN p = '' THEN '' ELSE substring(sha256(substring(p, 1, 4000)), 1, 16) END AS conversation_key
  FROM (SELECT conv_id, regexp_replace(regexp_replace(coalesce(arg_min_null(text, turn), ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS p FROM conversations WHERE role = 'user' GROUP BY 1)""",
    "session_enrichment": B.with_tables("chunks", rf""", q AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, lag(text, 2) OVER w AS b2, lag(text, 1) OVER w AS b1 FROM chunks WHERE role = 'user'
  WINDOW w AS (PARTITION BY session_id ORDER BY ord)), m AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))::DOUBLE AS n FROM q)
SELECT id, sha256(CASE WHEN {_COMPLEX} >= 0.35 THEN text ELSE concat_ws(' | ', b2, b1, text) END) AS enriched_sha256 FROM m"""),
    "project_vote": """SELECT user_id AS session_id, event_type AS project FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k
  FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2)) WHERE k = 1""",
    "extractive_memories": C_SQL.ORACLE_SQL["chunk_scores"].replace("SELECT session_id, id, CASE WHEN h <= -1.0", ", sco AS (SELECT session_id, id, CASE WHEN h <= -1.0").rstrip()
    + f""") SELECT 'mem:' || session_id || ':' || substring(sha1(text), 1, 8) AS id, session_id, project, {C_SQL.CLASS_SQL} AS mem_type, id AS chunk_id
  FROM chunks JOIN (SELECT id, score FROM sco WHERE score >= 0.3) USING (id) WHERE role = 'assistant'""",
    "deactivate_duplicates": B.with_tables("chunks notes artifacts", f", {C_SQL._DUPES} SELECT id, kept_id IS NULL AS active, kept_id AS superseded_by FROM artifacts LEFT JOIN (SELECT id, kept_id FROM dupes) USING (id)"),
    "supersedes_edges": B.with_tables("chunks notes artifacts", f", {C_SQL._DUPES} SELECT DISTINCT kept_id AS src_id, id AS dst_id, 'supersedes' AS type FROM dupes"),
    "store_health": B.with_tables("chunks memories", f", {_STORE} SELECT kind, count(*) AS active, max(created_at) AS last_ingest FROM artifacts GROUP BY 1"),
    "paraphrase_reuse": B.with_tables("chunks", rf""", p AS (SELECT a.id, u.text AS source, {_DIGITS.format('u.text')} AS du, {_DIGITS.format('a.text')} AS da FROM chunks a
  JOIN chunks u ON u.session_id = a.session_id AND u.ord = a.ord - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
v AS (SELECT id, source, {_VEC.format('du')} AS u, {_VEC.format('da')} AS a FROM p)
SELECT id, len(list_filter(regexp_split_to_array(source, '\s+'), lambda w: w <> '')) >= 4 AND round(coalesce(list_sum(list_transform(range(1, 17), lambda i: u[i] * a[i]))
  / nullif(sqrt(list_sum(list_transform(u, lambda x: x * x))) * sqrt(list_sum(list_transform(a, lambda x: x * x))), 0), 0), 9) >= 0.45 AS paraphrased FROM v"""),
}
