"""Registered queries over hybrid retrieval: all ``benchmark`` items are questions to all session chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import retrieval as R
from tracemill.plans import bindings as B

K = 20


def questions(s, d):
    b = B.table(s, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string")).alias("project"))


def edges(s, d):
    c = B.chunks(s, d)
    after = F.concat_ws(":", F.col("session_id").cast("string"), (F.col("ord") + 1).cast("string"))
    return c.select(F.col("id").alias("src_id"), after.alias("dst_id"), F.lit("part_of").alias("type"))


def dense(s, d):
    return R.dense_topk(R.embed(questions(s, d), "query"), R.embed(B.chunks(s, d)), K)


def lexical(s, d):
    return R.bm25_topk(questions(s, d), B.chunks(s, d), K)


def fused(s, d):
    return R.rrf(dense(s, d), lexical(s, d))


def scored(s, d):
    return R.blended(fused(s, d), B.chunks(s, d), B.AS_OF).select("query_id", "id", "kind", "project", "token_count", "score")


def given_vectors(s, d):
    e = B.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vector")  # the stated query set, against all rows
    return R.dense_topk(asked, e, 10, digits=6).select("query_id", "id", "similarity")


def best_memories(s, d):
    stored = R.embed(B.chunks(s, d)).select("id", "vector", F.col("session_id").cast("string").alias("memory_id"))
    near = R.dense_topk(R.embed(questions(s, d), "query"), stored, 50).join(stored.select("id", "memory_id"), "id")
    return R.best_per_memory(near.select("query_id", "memory_id", "similarity"), 5)


def facts(s, d):
    stored = R.embed(B.chunks(s, d).where("role = 'assistant'"))
    return R.nearest_fact(R.embed(questions(s, d), "query"), stored, 0.8)


def budgeted(s, d):
    return R.within_budget(R.ranked(scored(s, d), "score", 8), 300).select("query_id", "id", "rank", "spent")


def end_to_end(s, d):
    return R.recall(questions(s, d), B.chunks(s, d), edges(s, d), B.AS_OF)


def walked(s, d):
    starts = B.chunks(s, d).where("ord = 1").select("id")
    return R.walk(edges(s, d), starts, 3)


def in_project(s, d):
    return R.scoped_topk(R.embed(questions(s, d), "query"), R.embed(B.memory_store(s, d)), K, -0.05, ("memory",)).select("query_id", "id", "similarity", "rank")


def fresh(s, d):
    """What is left of each question's best when its session and what the session was served are left out."""
    asked = questions(s, d).withColumn("session_id", F.col("query_id") % 50)
    served = B.chunks(s, d).where("ord % 3 = 0").select((F.col("session_id") % 50).alias("session_id"), "id")
    return R.without_known(R.ranked(scored(s, d), "score", 10), asked, B.chunks(s, d), served).select("query_id", "id", "rank")


def hashed(s, d):
    """Counts of the buckets; the digits have a column of their own, or a function over arrays would make them 32 times a row."""
    digits = B.chunks(s, d).select("id", R.hash_digits(F.col("text")).alias("digits"))
    return digits.select("id", F.array_join(F.transform(R.digit_counts(F.col("digits")), lambda x: x.cast("string")), ",").alias("counts"))


QUERIES = {
    "scoped_topk": in_project,
    "artifacts_in_scope": lambda s, d: R.in_scope(B.artifacts(s, d), "p1", "2024-01-01 06:00:00", "2024-01-20 00:00:00", ("session_chunk", "note")).select("id", "kind", "project"),
    "unserved_hits": fresh,
    "mmr_rerank": lambda s, d: R.mmr(
        R.ranked(scored(s, d), "score", 32).join(R.embed(B.chunks(s, d)).select("id", "vector"), "id").select("query_id", "id", "score", "vector"), 8
    ),
    "recent_in_project": lambda s, d: R.recent(B.memory_store(s, d), 20),
    "other_projects": lambda s, d: R.other_projects(B.memory_store(s, d), "p1"),
    "hash_embed": hashed,
    "dense_topk": dense,
    "vector_topk_given": given_vectors,
    "bm25_topk": lexical,
    "rrf_hybrid": fused,
    "blended_scores": lambda s, d: scored(s, d).select("query_id", "id", "score"),
    "edge_expand": lambda s, d: R.expand(R.ranked(scored(s, d), "score", 5), edges(s, d), B.chunks(s, d)).select("query_id", "id", "score"),
    "token_budget": budgeted,
    "key_surface_topk": best_memories,
    "nearest_fact": facts,
    "graph_walk": walked,
    "recall_end_to_end": end_to_end,
    "recall_render": lambda s, d: R.render(end_to_end(s, d), B.chunks(s, d)),
}

_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda t: t <> '')"
_EMBEDDED = """e{0} AS (SELECT {1}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM
  (SELECT *, list_transform(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], lambda h: length(j) - length(replace(j, h, ''))) AS c FROM
  (SELECT *, array_to_string(list_transform(""" + _TERMS.format("{2}") + """, lambda t: right(sha256(t), 1)), '') AS j FROM {3}))),
v{0} AS (SELECT {1}, list_transform(c, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END) AS vector FROM e{0})"""
_STORE = _EMBEDDED.format("s", "id, project, role, session_id", "text", "chunks")
_ASKED = "questions AS (SELECT item_id AS query_id, text AS query, 'p' || (item_id % 5) AS project FROM benchmark),\n" + _EMBEDDED.format("q", "query_id, project", "query", "questions")
_SIM = """sim AS (SELECT query_id, vs.id, vs.project, vs.role, vs.session_id, vq.project AS asked, round(list_dot_product(vs.vector, vq.vector), 9) AS similarity FROM vs, vq)"""
_DENSE = _STORE + ",\n" + _ASKED + ",\n" + _SIM + f""",
dense AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim QUALIFY rank <= {K})"""
_LEXICAL = f"""st AS (SELECT id, {_TERMS.format('text')} AS t FROM chunks),
ix AS (SELECT term, id, length, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM st) GROUP BY ALL),
size AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_length FROM st),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
asked AS (SELECT query_id, unnest(list_distinct({_TERMS.format('query')})) AS term FROM questions),
bm AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5)))
         * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avg_length)))), 9) AS bm25
       FROM ix JOIN asked USING (term) JOIN df USING (term), size GROUP BY query_id, id),
lexical AS (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM bm QUALIFY rank <= {K})"""
_FUSED = _DENSE + ",\n" + _LEXICAL + """,
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf FROM
  (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM lexical) GROUP BY query_id, id)"""
_SCORED = _FUSED + f""",
norm AS (SELECT *, min(rrf) OVER (PARTITION BY query_id) AS lo, max(rrf) OVER (PARTITION BY query_id) AS hi FROM fused JOIN chunks USING (id)),
scored AS (SELECT query_id, id, kind, project, token_count, round(
    0.50::DOUBLE * (rrf - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END
  + 0.25::DOUBLE * exp(-0.693::DOUBLE * (epoch(TIMESTAMP '{B.AS_OF}' - created_at) / 86400.0::DOUBLE) / 14.0)
  + 0.10::DOUBLE * 0.5, 9) AS score FROM norm)"""
_TOP = """top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""

_MEM = _EMBEDDED.format("m", "id, kind, project", "text", "store")
ORACLE_SQL = {
    "artifacts_in_scope": B.with_tables("chunks notes artifacts", """SELECT id, kind, project FROM artifacts WHERE project IN ('p1', '_global')
  AND created_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND kind IN ('session_chunk', 'note')"""),
    "scoped_topk": B.with_tables("chunks memories", f""", store AS (SELECT id, kind, project, text FROM chunks UNION ALL SELECT id, kind, project, text FROM memories), {_MEM}, {_ASKED},
near AS (SELECT query_id, vq.project AS asked, vm.id, vm.kind, vm.project, round(list_dot_product(vm.vector, vq.vector), 9) AS similarity FROM vm, vq
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 400),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near WHERE project IN (asked, '_global') AND similarity >= -0.05 QUALIFY rank <= {K})
SELECT query_id, id, similarity, rank FROM top WHERE kind = 'memory'"""),
    "unserved_hits": B.with_tables("chunks", f""", {_SCORED}, {_TOP}
SELECT query_id, t.id, rank FROM top t JOIN chunks c ON c.id = t.id WHERE rank <= 10 AND c.session_id <> query_id % 50
  AND NOT EXISTS (SELECT 1 FROM chunks x WHERE x.id = t.id AND x.ord % 3 = 0 AND x.session_id % 50 = query_id % 50)"""),
    "recent_in_project": B.with_tables("chunks memories", """, store AS (SELECT id, project, created_at FROM chunks UNION ALL SELECT id, project, created_at FROM memories)
SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, id) AS rank FROM store QUALIFY rank <= 20"""),
    "other_projects": B.with_tables("chunks memories", """SELECT project, count(*) AS memories FROM memories WHERE project NOT IN ('p1', '_global') GROUP BY 1 ORDER BY memories DESC, project LIMIT 6"""),
    "hash_embed": B.with_tables("chunks", f", {_STORE} SELECT id, array_to_string(c, ',') AS counts FROM es"),
    "dense_topk": B.with_tables("chunks", f", {_DENSE} SELECT * FROM dense"),
    "vector_topk_given": """SELECT query_id, id, similarity FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10""",
    "bm25_topk": B.with_tables("chunks", f", {_ASKED}, {_LEXICAL} SELECT * FROM lexical"),
    "rrf_hybrid": B.with_tables("chunks", f", {_FUSED} SELECT * FROM fused"),
    "blended_scores": B.with_tables("chunks", f", {_SCORED} SELECT query_id, id, score FROM scored"),
    "edge_expand": B.with_tables("chunks", f""", {_SCORED}, {_TOP},
hits AS (SELECT * FROM top WHERE rank <= 5),
near AS (SELECT DISTINCT h.query_id, n.id FROM hits h JOIN chunks c USING (id) JOIN chunks n ON n.id = c.session_id || ':' || (c.ord + 1)
         WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.query_id = h.query_id AND x.id = n.id))
SELECT query_id, id, score FROM hits
UNION ALL SELECT query_id, id, round(0.5 * best, 9) FROM near JOIN (SELECT query_id, max(score) AS best FROM hits GROUP BY query_id) USING (query_id)"""),
    "token_budget": B.with_tables("chunks", f""", {_SCORED}, {_TOP}
SELECT query_id, id, rank, spent FROM (SELECT *, (sum(token_count) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS spent FROM top WHERE rank <= 8)
WHERE spent <= 300 OR rank = 1"""),
    "key_surface_topk": B.with_tables("chunks", f""", {_STORE}, {_ASKED}, {_SIM},
near AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 50),
best AS (SELECT query_id, CAST(session_id AS VARCHAR) AS id, max(similarity) AS similarity FROM near GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM best QUALIFY rank <= 5"""),
    "nearest_fact": B.with_tables("chunks", f""", {_STORE}, {_ASKED}, {_SIM}
SELECT query_id, id, similarity FROM sim WHERE role = 'assistant' AND project = asked AND similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) = 1"""),
    "graph_walk": B.with_tables("chunks", """, edges AS (SELECT id AS src, session_id || ':' || (ord + 1) AS dst FROM chunks),
one AS (SELECT s.id AS start, e.dst AS id, 1 AS depth FROM chunks s JOIN edges e ON e.src = s.id WHERE s.ord = 1),
two AS (SELECT start, e.dst AS id, 2 AS depth FROM one JOIN edges e ON e.src = one.id),
three AS (SELECT start, e.dst AS id, 3 AS depth FROM two JOIN edges e ON e.src = two.id)
SELECT start, id, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY start, id"""),
}
