"""Keys and ids of stored rows, what a session asked before, and keeping the store: successors, stale rows, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.curation import classify, complexity
from tracemill.operators.retrieval import embed, similarity

#: Characters of an opening message that make its key, and of the key.
KEY_HEAD, KEY_CHARS = 4000, 16
#: Below this complexity a question takes the session's last ones along, so many of them.
SPARSE, HISTORY = 0.35, 2
#: Least score of a chunk that becomes a memory; least cosine of a paraphrase; least words of a reuse.
MIN_MEMORY_SCORE, PARAPHRASE, MIN_WORDS = 0.3, 0.45, 4


def conversation_key(first_text: Column) -> Column:
    """A key of 16 hex digits of how a conversation opened, white space apart; empty for a blank opening."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(first_text, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(plain == "", "").otherwise(F.substring(F.sha2(F.substring(plain, 1, KEY_HEAD), 256), 1, KEY_CHARS))


def conversation_keys(turns: DataFrame) -> DataFrame:
    """(session_id, conversation_key) by the first user turn; the turn is found by an aggregate."""
    first = turns.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "ord").alias("first"))
    return first.select("session_id", conversation_key(F.col("first")).alias("conversation_key"))


def enriched_queries(asked: DataFrame) -> DataFrame:
    """Questions (session_id, ord, id, text) with ``enriched``: sparse ones after the session's last two."""
    w = Window.partitionBy("session_id").orderBy("ord")
    before = [F.lag("text", k).over(w) for k in range(HISTORY, 0, -1)]
    joined = F.concat_ws(" | ", *before, "text")
    return asked.withColumn("enriched", F.when(complexity(F.col("text")) >= SPARSE, F.col("text")).otherwise(joined))


def majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of every key, ties to the smaller; nulls do not vote."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col(value).alias("v"))).alias("best")).select(key, F.col("best.v").alias(value))


def memories_of(chunks: DataFrame, scores: DataFrame, keys: DataFrame) -> DataFrame:
    """Memories of the key chunks (keys: session_id, id) whose score is high enough: id, session, type, text and source chunk."""
    rows = chunks.join(keys.select("session_id", "id"), ["session_id", "id"], "left_semi").join(scores, ["session_id", "id"]).where(F.col("score") >= MIN_MEMORY_SCORE)
    own = F.concat_ws(":", F.lit("mem"), F.col("session_id").cast("string"), F.substring(F.sha1("text"), 1, 8))
    return rows.select(own.alias("id"), "session_id", "project", classify(F.col("text")).alias("mem_type"), "text", F.col("id").alias("chunk_id"))


def deactivate(store: DataFrame, losers: DataFrame) -> DataFrame:
    """``store`` (id, active, superseded_by) with the active rows among ``losers`` (id, successor) off; a null successor only switches off."""
    by = losers.groupBy("id").agg(F.min("successor").alias("_successor"), F.lit(True).alias("_gone"))
    rows = store.join(by, "id", "left")
    off = F.col("active") & F.coalesce("_gone", F.lit(False))
    return rows.withColumn("superseded_by", F.when(off, F.col("_successor")).otherwise(F.col("superseded_by"))).withColumn("active", F.col("active") & ~off).drop("_successor", "_gone")


def supersedes_edges(store: DataFrame, losers: DataFrame) -> DataFrame:
    """Edges from successors to the active rows that they replace."""
    active = store.where("active").select("id")
    return losers.where("successor IS NOT NULL").join(active, "id", "left_semi").select(F.col("successor").alias("src_id"), F.col("id").alias("dst_id"), F.lit("supersedes").alias("type")).distinct()


def store_health(store: DataFrame) -> DataFrame:
    """Active rows per kind, and when a row of the kind last came in."""
    return store.groupBy("kind").agg(F.count_if("active").alias("active"), F.max("created_at").alias("last_ingest"))


def paraphrases(pairs: DataFrame) -> DataFrame:
    """Pairs (id, source, answer) with ``paraphrased``: the texts' embeddings lie near, and the source has words enough."""
    a = embed(pairs, "source").withColumnRenamed("vector", "_a")
    both = embed(a, "answer")
    words = F.size(F.filter(F.split("source", r"\s+"), lambda w: w != ""))
    near = F.round(similarity(F.col("_a"), F.col("vector")), 9) >= PARAPHRASE
    return both.withColumn("paraphrased", near & (words >= MIN_WORDS)).drop("_a", "vector")
