"""Registered queries over request bodies, which Spark writes from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.operators import requests as Q
from tracemill.plans import bindings as B


def bodies(s, d):
    """One body a conversation: even ones in blocks, odd ones in messages; every user turn answers a call of the turn before it."""
    c = B.table(s, d, "conversations")
    turn, text, role = F.col("turn"), F.col("text"), F.col("role")
    own = F.concat(F.lit("c"), turn.cast("string"))
    before = F.concat(F.lit("c"), (turn - 1).cast("string"))
    source = F.concat(F.lit("src/f"), (turn % 3).cast("string"), F.lit(".md"))
    log = F.concat(F.lit('{"path": "f'), (turn % 2).cast("string"), F.lit('.log"}'))
    struct = lambda **fields: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in fields.items()])
    asked = struct(role=role, content=F.array(F.to_json(struct(type="text", text=F.concat(F.lit("turn "), turn.cast("string")))), F.to_json(struct(type="tool_result", tool_use_id=before, content=text))))
    in_blocks = F.concat(F.lit('{"role":"user","content":['), F.array_join(asked["content"], ","), F.lit("]}"))
    called = F.to_json(struct(role=role, content=F.array(struct(type="tool_use", id=own, name="Read", input=struct(file_path=source)))))
    tool_calls = F.to_json(struct(role=role, tool_calls=F.array(struct(id=own, type="function", function=struct(name="Read", arguments=log)))))
    plain = F.to_json(struct(role=role, content=text))
    even = F.col("conv_id") % 2 == 0
    message = (
        F.when((role == "user") & even, in_blocks).when((role == "user") & (turn >= 2), F.to_json(struct(role="tool", tool_call_id=before, content=text)))
        .when((role == "assistant") & even, called).when(role == "assistant", tool_calls).otherwise(plain)
    )
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text", message.alias("message"))))  # the turns of one conversation
    rows = c.groupBy(F.col("conv_id").alias("request_id")).agg(listed.alias("m"))
    joined = F.array_join(F.transform("m", lambda x: x["message"]), ",")
    return rows.select(
        "request_id", F.when(F.col("request_id") % 2 == 0, Q.BLOCKS).otherwise(Q.MESSAGES).alias("provider"),
        F.concat(F.lit('{"model":"m","max_tokens":1024,"messages":['), joined, F.lit("]}")).alias("body"),
    )


def _payloads(latest_only):
    def run(s, d):
        found = Q.payloads_of(Workspace(s, "requests").table("bodies", bodies(s, d)), latest_only)
        return found.select("request_id", "message", "place", F.sha2("text", 256).alias("text_sha256"), "tool", "file_path", "is_latest")

    return run


def _savings(s, d):
    work = Workspace(s, "requests")
    _, summary, _ = Q.compress_requests(work.table("given", bodies(s, d)), work, latest_only=False)
    return summary.select("request_id", "tokens_before", "tokens_after", "passthrough")


def _round_trip(s, d):
    """Bodies after compression and the way back; each must be what it was."""
    work = Workspace(s, "requests")
    given = work.table("given", bodies(s, d))
    done, _, stored = Q.compress_requests(given, work, latest_only=False)
    back = work.table("back", Q.restored(done, work.table("stored", stored)))
    same = F.try_parse_json("body").cast("string")
    return given.select("request_id", same.alias("a")).join(back.select("request_id", same.alias("b")), "request_id").select("request_id", (F.col("a") == F.col("b")).alias("same"))


QUERIES = {
    "request_payloads": _payloads(False),
    "request_latest_payloads": _payloads(True),
    "request_questions": lambda s, d: Q.questions_of(bodies(s, d)).select("request_id", "message", F.sha2("query", 256).alias("query_sha256")),
    "request_savings": _savings,
    "request_round_trip": _round_trip,
}

_M = """WITH m AS (SELECT conv_id AS r, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) - 1 AS message FROM conversations),
c AS (SELECT DISTINCT r, 'c' || turn AS call_id, CASE WHEN r % 2 = 0 THEN 'src/f' || (turn % 3) || '.md' ELSE 'f' || (turn % 2) || '.log' END AS file_path FROM m WHERE role = 'assistant'),
p AS (SELECT m.r, message, CASE WHEN m.r % 2 = 0 THEN 1 END AS place, text, CASE WHEN file_path IS NOT NULL THEN 'Read' END AS tool, file_path
  FROM m LEFT JOIN c ON c.r = m.r AND call_id = 'c' || (turn - 1) WHERE role = 'user' AND text IS NOT NULL AND (m.r % 2 = 0 OR turn >= 2)),
q AS (SELECT r AS request_id, message, place, sha256(text) AS text_sha256, tool, file_path,
  file_path IS NULL OR row_number() OVER (PARTITION BY r, file_path ORDER BY message DESC) = 1 AS is_latest FROM p),
e AS (SELECT r, max(message) FILTER (WHERE role = 'user' AND (r % 2 = 0 OR turn < 2)) AS last_user, coalesce(max(message) FILTER (WHERE NOT (role = 'user' AND r % 2 = 1 AND turn >= 2)), -1) AS last_other FROM m GROUP BY r)
"""
ORACLE_SQL = {
    "request_payloads": _M + "SELECT * FROM q",
    "request_latest_payloads": _M + "SELECT q.* FROM q JOIN e ON e.r = q.request_id WHERE CASE WHEN request_id % 2 = 0 THEN message = last_user ELSE message > last_other END",
    "request_questions": _M + r"""SELECT e.r AS request_id, last_user AS message, sha256(x) AS query_sha256 FROM (SELECT e.*, CASE WHEN e.r % 2 = 0 THEN 'turn ' || turn ELSE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') END AS x
  FROM e JOIN m ON m.r = e.r AND message = last_user) e WHERE x <> ''""",
    "request_round_trip": "SELECT DISTINCT conv_id AS request_id, true AS same FROM conversations",
}
