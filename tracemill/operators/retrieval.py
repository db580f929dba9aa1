"""Hybrid retrieval for batches of questions.

Questions are rows too: (query_id, query). Dense and lexical channels rank candidates per question, reciprocal
ranks fuse them, and recency, kind and quality blend in; a greedy pass diversifies the small pool that is left.
A block of questions is scored against all rows by joins on what they share (terms), or, for vectors, by one
scan per block with its vectors at hand (the questions are counted first).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace, spread_lookup

#: Fusion constant, half life in days, blend weights, diversity trade-off and duplicate bound.
RRF_K = 60
HALF_LIFE_DAYS = 14.0
WEIGHTS = {"relevance": 0.50, "recency": 0.25, "kind": 0.15, "quality": 0.10}
KIND_BOOST = {"memory": 0.3, "note": 0.1}
MMR_LAMBDA, DUPLICATE = 0.7, 0.92
BM25_K1, BM25_B = 1.2, 0.75
DIM = 16
#: Bytes of question vectors that one scan holds at a time; more questions are dealt into blocks.
MAX_QUESTION_BYTES = 16 << 20
#: Asked terms, and pairs of a term and a question, that may be broadcast to the texts; beyond it they meet in a shuffle.
MAX_ASKED_TERMS, MAX_ASKED_PAIRS = 200_000, 2_000_000
#: Scores that a task holds at a time, of rows and questions and of their terms.
SCORES_AT_A_TIME = 4_000_000
EDGE_TYPES = ("fixes", "supersedes", "part_of", "derived_from")


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")


def hash_counts(text: Column, dim: int = DIM) -> Column:
    """Bag of words over ``dim`` = 16 buckets: the last hex digit of each term's SHA-256."""
    if dim != 16:
        raise ValueError("the hash embedding has 16 dimensions")
    return digit_counts(hash_digits(text))


def hash_digits(text: Column) -> Column:
    """The bucket of every term, one hex digit each."""
    return F.array_join(F.transform(terms(text), lambda t: F.substring(F.sha2(t, 256), 64, 1)), "")


def digit_counts(digits: Column) -> Column:
    return F.array(*[F.length(digits) - F.length(F.translate(digits, d, "")) for d in "0123456789abcdef"])


def norm_of(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def over_norm(counts: Column, norm: Column) -> Column:
    return F.transform(counts, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def normalized(counts: Column) -> Column:
    return over_norm(counts, norm_of(counts))


def embed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``vector``; digits and norm have columns of their own, or they would be made once an entry."""
    counted = rows.withColumn("_digits", hash_digits(F.col(text))).withColumn("_counts", digit_counts(F.col("_digits")))
    sized = counted.withColumn("_norm", norm_of(F.col("_counts")))
    return sized.withColumn("vector", over_norm(F.col("_counts"), F.col("_norm"))).drop("_digits", "_counts", "_norm")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Of unit vectors: the cosine, or one minus the Euclidean distance."""
    if metric == "cosine":
        return dot(a, b)
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b)))


def ranked(rows: DataFrame, score: str, k: int | None = None, by: str = "query_id", name: str = "rank") -> DataFrame:
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), "id")))
    return out if k is None else out.where(F.col(name) <= k)


def dense_topk(queries: DataFrame, store: DataFrame, k: int, floor: float | None = None, metric: str = "cosine", digits: int = 9, within: str | None = None) -> DataFrame:
    """Top k rows per question by vector similarity: one scan of the store per block of questions.

    queries: query_id, vector; store: id, vector. A task multiplies its rows, batch by batch, with the block's
    vectors and passes on, per question, only what still reaches the best k of a batch it has seen; the ranks are
    drawn from those. ``within`` names a column that must be equal on both sides. Scores are rounded so that equal
    ones tie alike everywhere; rows and questions without a vector have no partner. The vectors are measured
    before they are sent: beyond ``MAX_QUESTION_BYTES`` a hash of the id deals the questions into blocks, and each
    block's result is written before the next scan.
    """
    spark = store.sparkSession
    more = [within] if within else []
    work = Workspace(spark, "dense")
    asked = work.table("questions", queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *more))
    size = asked.agg(F.sum(8 * F.size("vector").cast("long") + 64)).first()[0] or 0
    blocks = max(1, -(-11 * size // (10 * MAX_QUESTION_BYTES)))
    rows = store.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"), *more)
    if blocks > 1:
        rows = work.table("store", rows)
    found = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        top = ranked(_block_scores(block, rows, k, floor, metric, digits), "similarity", k)
        top = work.table(f"top{b}", top) if blocks > 1 else top
        found = top if found is None else found.unionByName(top)
    return found


def _block_scores(block: DataFrame, rows: DataFrame, k: int, floor: float | None, metric: str, digits: int) -> DataFrame:
    """(query_id, id, similarity) of all pairs that can be among a question's best k."""
    held = block.toArrow()
    numbers = held["query_id"].combine_chunks()
    matrix = np.stack(held["vector"].to_numpy()) if len(numbers) else np.zeros((0, 1))
    keys = held[2].to_numpy() if held.num_columns > 2 else None
    sent = rows.sparkSession.sparkContext.broadcast((numbers, matrix, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, matrix, keys = sent.value
        best = np.full(len(matrix), -np.inf if floor is None else floor)
        for batch in batches:
            vectors = batch.column(1)
            if not len(matrix) or not len(vectors):
                continue
            flat = np.asarray(vectors.flatten()).reshape(len(vectors), -1)
            for low in range(0, len(flat), BATCH_ROWS):
                part = flat[low : low + BATCH_ROWS]
                own = None if keys is None else batch.column(2).to_numpy(zero_copy_only=False)[low : low + BATCH_ROWS, None]
                for first in range(0, len(matrix), BATCH_QUESTIONS):
                    some = slice(first, first + BATCH_QUESTIONS)
                    scores = part @ matrix[some].T
                    if metric != "cosine":
                        scores = 1 - np.sqrt(np.maximum(0.0, 2 - 2 * scores))
                    scores = np.round(scores, digits)
                    if keys is not None:
                        scores[own != keys[None, some]] = -np.inf
                    if len(scores) > k:
                        best[some] = np.maximum(best[some], np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                    row, question = np.nonzero((scores >= best[some]) & (scores > -np.inf))
                    yield pa.RecordBatch.from_arrays(
                        [numbers.take(pa.array(question + first)), batch.column(0).take(pa.array(row + low)), pa.array(scores[row, question])], names=["query_id", "id", "similarity"]
                    )

    kinds = f"query_id {block.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, similarity double"
    return rows.mapInArrow(run, kinds)


#: Rows and questions that are multiplied at a time, whatever the number of questions.
BATCH_ROWS, BATCH_QUESTIONS = 2048, 512


def postings(store: DataFrame, text: str = "text") -> DataFrame:
    """(term, id, tf, length): the lexical index."""
    split = store.select("id", terms(F.col(text)).alias("t"))
    return split.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def bm25_topk(queries: DataFrame, store: DataFrame, k: int, text: str = "text", digits: int = 9) -> DataFrame:
    """Top k rows per question by BM25 over all rows; terms of a question count once.

    Only asked terms are counted in the texts: they are counted first and sent to the texts within
    ``MAX_ASKED_TERMS`` and ``MAX_ASKED_PAIRS``, else they meet them in a shuffle. Postings combine before the
    shuffle and are then dealt by row, so all scores of a row are added up in one task, which passes on what can be
    among a question's best k. Where the asked terms are too many to send, the postings of a common term, and the questions that
    ask it, are split by ``spread_lookup`` and every sum is shuffled.
    """
    work = Workspace(store.sparkSession, "bm25")
    asked = work.table("asked", queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).groupBy("term").agg(F.collect_set("query_id").alias("askers")))
    sent = asked.agg(F.count("*").alias("terms"), F.coalesce(F.sum(F.size("askers")), F.lit(0)).alias("pairs")).first()
    few = sent["terms"] <= MAX_ASKED_TERMS and sent["pairs"] <= MAX_ASKED_PAIRS
    words = asked.select("term")
    split = store.select("id", terms(F.col(text)).alias("t"))
    size = split.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avg_length"))
    single = split.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).join(F.broadcast(words) if few else words, "term", "left_semi")
    index = work.table("postings", single.groupBy("term", "id", "length").agg(F.count("*").alias("tf")))
    terms_asked = index.groupBy("term").agg(F.count("*").alias("df")).join(asked, "term")
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("avg_length")))
    if few:
        return ranked(_row_scores(index, terms_asked, size, idf, tf, k, digits), "bm25", k)
    scores = (
        spread_lookup(index, terms_asked, "term", F.col("id")).join(F.broadcast(size))
        .select(F.explode("askers").alias("query_id"), "id", (idf * tf).alias("part"))
        .groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("bm25"))
    )
    return ranked(scores, "bm25", k)


def _row_scores(index: DataFrame, terms_asked: DataFrame, size: DataFrame, idf: Column, tf: Column, k: int, digits: int) -> DataFrame:
    """(query_id, id, bm25) of all pairs that can be among a question's best k; a row's terms meet in one task.

    The asked terms and who asks them are at hand there; nothing is shuffled for each question.
    """
    spark = index.sparkSession
    held = terms_asked.select("term", "df", "askers").toArrow()
    askers = held["askers"].combine_chunks()
    starts = np.concatenate(([0], np.cumsum(askers.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    coded = askers.flatten().dictionary_encode()
    sent = spark.sparkContext.broadcast((coded.dictionary, starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)))
    numbered = spark.createDataFrame(list(enumerate(held["term"].to_pylist())), "number int, term string").join(terms_asked.select("term", "df"), "term")
    weights = index.join(F.broadcast(numbered), "term").join(F.broadcast(size)).select("id", "number", (idf * tf).alias("weight"))
    rows = weights.groupBy("id").agg(F.collect_list(F.struct("number", "weight")).alias("t")).select("id", F.col("t.number").alias("numbers"), F.col("t.weight").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, asking = sent.value
        many, width = np.diff(starts), len(ids)
        best = np.zeros(width)
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            term, weight = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            reach = np.concatenate(([0], np.cumsum(many[term])))[ends]  # scores of terms up to each row
            low = 0
            while low < len(ends):
                done = reach[low - 1] if low else 0
                high = min(int(np.searchsorted(reach, done + SCORES_AT_A_TIME, "right")), low + max(1, SCORES_AT_A_TIME // width))
                high = max(low + 1, high)
                first = ends[low - 1] if low else 0
                t, w = term[first : ends[high - 1]], weight[first : ends[high - 1]]
                row = np.repeat(np.arange(high - low), np.diff(ends[low:high], prepend=first))
                n = many[t]
                question = asking[np.repeat(starts[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                scores = np.bincount(np.repeat(row, n) * width + question, np.repeat(w, n), (high - low) * width).reshape(-1, width)
                if len(scores) > k:
                    best = np.maximum(best, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                # what may be rounded to the same as the k-th best stays
                at, question = np.nonzero((scores > 0) & (scores >= best - 2 * 10.0**-digits))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(question)), batch.column(0).take(pa.array(at + low)), pa.array(scores[at, question])], names=["query_id", "id", "bm25"])
                low = high

    kinds = f"query_id {terms_asked.schema['askers'].dataType.elementType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, bm25 double"
    return rows.mapInArrow(run, kinds).withColumn("bm25", F.round("bm25", digits))


def gated(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Lexical candidates only of questions whose dense channel found something."""
    return lexical.join(dense.select("query_id").distinct(), "query_id", "left_semi")


def rrf(*channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of channels (query_id, id, rank)."""
    both = None
    for c in channels:
        c = c.select("query_id", "id", "rank")
        both = c if both is None else both.unionByName(c)
    return both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"))


def blended(candidates: DataFrame, store: DataFrame, as_of: str, quality: DataFrame | None = None) -> DataFrame:
    """Min-max relevance within a question's candidates, recency, kind and quality, weighted.

    With a single candidate, or all equal, the range counts as one and relevance is 0.
    """
    rows = candidates.join(store.select("id", "kind", "project", "created_at", "token_count"), "id")
    if quality is not None:
        rows = rows.join(quality.select("id", "quality"), "id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("double"))
    w = Window.partitionBy("query_id")
    low, high = F.min("rrf").over(w), F.max("rrf").over(w)
    relevance = (F.col("rrf") - low) / F.when(high > low, high - low).otherwise(1.0)
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("created_at")) / 86400.0
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_BOOST.items() for x in kv]), F.col("kind")), F.lit(0.0))
    quality_term = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("quality", F.lit(0.5))))
    score = (
        WEIGHTS["relevance"] * relevance
        + WEIGHTS["recency"] * F.exp(-0.693 * age / HALF_LIFE_DAYS)
        + WEIGHTS["kind"] * kind
        + WEIGHTS["quality"] * quality_term
    )
    return rows.withColumn("score", F.round(score, 9)).drop("quality")


def expand(hits: DataFrame, edges: DataFrame, store: DataFrame, types: tuple[str, ...] = EDGE_TYPES, share: float = 0.5) -> DataFrame:
    """Neighbours one step along typed edges join at half of the question's best score, unless already there."""
    # read four times, so written once
    hits = Workspace(store.sparkSession, "expand").table("hits", hits.select("query_id", "id", "kind", "project", "token_count", "score"))
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    steps = edges.where(F.col("type").isin(*types)).select(F.col("src_id").alias("id"), "dst_id")
    near = hits.select("query_id", "id").join(steps, "id").select("query_id", F.col("dst_id").alias("id")).distinct()
    near = near.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    near = near.join(best, "query_id").join(store.select("id", "kind", "project", "created_at", "token_count"), "id")
    return hits.select("query_id", "id", "kind", "project", "token_count", "score").unionByName(
        near.select("query_id", "id", "kind", "project", "token_count", F.round(share * F.col("_best"), 9).alias("score"))
    )


def within_budget(hits: DataFrame, budget: int, cost: str = "token_count") -> DataFrame:
    """The longest prefix by rank whose cost fits; the first row always stays."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("spent", F.sum(cost).over(w)).where((F.col("spent") <= budget) | (F.col("rank") == 1))


def mmr(pool: DataFrame, k: int, trade: float = MMR_LAMBDA, duplicate: float = DUPLICATE) -> DataFrame:
    """Greedy maximal marginal relevance over each question's pool (query_id, id, score, vector): rank and id of the chosen.

    The pool is what a limit has left (a few times k), so a question's group is small. A row's value is its share
    of the best score less its largest cosine with a chosen row, weighted; a near copy of a chosen row loses one
    more, unless relevance alone counts (``trade`` 1). Rows without a vector compete on relevance alone; ties go to
    the higher score, then the smaller id.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        score = pdf["score"].to_numpy()
        value = trade * score / (score.max() or 1.0)
        have = np.array([v is not None for v in pdf["vector"]])
        width = max((len(v) for v in pdf["vector"] if v is not None), default=1)
        unit = np.stack([np.asarray(v, float) if v is not None else np.zeros(width) for v in pdf["vector"]])
        unit = unit / np.maximum(np.sqrt((unit**2).sum(1, keepdims=True)), 1e-300)
        near, left, chosen = np.zeros(len(pdf)), np.ones(len(pdf), dtype=bool), []
        while left.any() and len(chosen) < k:
            worth = value - (1 - trade) * near - (near >= duplicate if trade < 1 else 0.0)
            i = int(np.argmax(np.where(left, worth, -np.inf)))
            left[i] = False
            chosen.append(i)
            if have[i]:
                near = np.maximum(near, np.where(have, unit @ unit[i], 0.0))
        out = pdf.loc[chosen, ["query_id", "id", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    kinds = f"query_id {pool.schema['query_id'].dataType.simpleString()}, id {pool.schema['id'].dataType.simpleString()}, score double, rank long"
    return pool.groupBy("query_id").applyInPandas(pick, kinds)


def best_per_memory(keys: DataFrame, k: int) -> DataFrame:
    """Several keys lead to one memory: its best key counts."""
    best = keys.groupBy("query_id", F.col("memory_id").alias("id")).agg(F.max("similarity").alias("similarity"))
    return ranked(best, "similarity", k)


def nearest_fact(queries: DataFrame, memories: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """The one nearest row of the same project at or above the threshold, if any."""
    return dense_topk(queries, memories, 1, threshold, metric, within="project").select("query_id", "id", "similarity")


#: Fixed value: rows of this project are in scope of every project.
GLOBAL_PROJECT = "_global"


def in_scope(store: DataFrame, project: str | None = None, since: str | None = None, until: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Active rows (where there is such a column) of a project or the global one, in a span of time, of some kinds; None sets no bound."""
    tests = [F.col("active")] if "active" in store.columns else []
    if project is not None:
        tests.append(F.col("project").isin(project, GLOBAL_PROJECT))
    if since is not None:
        tests.append(F.col("created_at") >= F.to_timestamp(F.lit(since)))
    if until is not None:
        tests.append(F.col("created_at") <= F.to_timestamp(F.lit(until)))
    if kinds is not None:
        tests.append(F.col("kind").isin(*kinds))
    return store.where(reduce(lambda a, b: a & b, tests)) if tests else store


def scoped(found: DataFrame, queries: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates (query_id, id, ...) whose row is of the question's project, or global; questions without a project see all."""
    ask, rows = queries.select("query_id", F.col("project").alias("_asked")), store.select("id", F.col("project").alias("_project"))
    inside = F.col("_asked").isNull() | F.col("_project").isin(GLOBAL_PROJECT) | (F.col("_project") == F.col("_asked"))
    return found.join(ask, "query_id").join(rows, "id").where(inside).drop("_asked", "_project")


def prefetch(k: int) -> int:
    """Rows that are ranked before scope cuts them: 20 for each wanted, at least 200, at most 4,096."""
    return min(max(20 * k, 200), 4096)


def scoped_topk(queries: DataFrame, store: DataFrame, k: int, floor: float | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Dense search as a store does it: the nearest rows of all, then scope, then the cut to k, then kinds."""
    near = dense_topk(queries, store, prefetch(k), floor).drop("rank")
    top = ranked(scoped(near, queries, store), "similarity", k)
    if kinds is None:
        return top
    return top.join(store.where(F.col("kind").isin(*kinds)).select("id"), "id", "left_semi").select(*top.columns)


def without_known(hits: DataFrame, queries: DataFrame, store: DataFrame, served: DataFrame) -> DataFrame:
    """Hits less rows of the question's own session and rows already served in it (session_id, id)."""
    ask = queries.select("query_id", F.col("session_id").alias("_session"))
    own = store.select("id", F.col("session_id").alias("_own"))
    rows = hits.join(ask, "query_id").join(own, "id", "left").where(F.col("_session").isNull() | F.col("_own").isNull() | (F.col("_own") != F.col("_session")))
    known = served.select(F.col("session_id").alias("_session"), "id").distinct()
    return rows.join(known, ["_session", "id"], "left_anti").select(*hits.columns)


def recent(store: DataFrame, k: int, by: str = "project") -> DataFrame:
    """The k newest rows of every project."""
    w = Window.partitionBy(by).orderBy(F.col("created_at").desc(), "id")
    return store.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, "rank", "id")


def other_projects(store: DataFrame, project: str, limit: int = 6) -> DataFrame:
    """Other projects with memories, the largest first."""
    rows = store.where((F.col("kind") == "memory") & ~F.col("project").isin(project, GLOBAL_PROJECT))
    return rows.groupBy("project").agg(F.count("*").alias("memories")).orderBy(F.col("memories").desc(), "project").limit(limit)


def walk(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, depth): what each start reaches in at most ``hops`` steps, each node at its least depth."""
    reached = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    front = reached
    for depth in range(1, hops + 1):
        front = front.join(edges.select(F.col("src_id").alias("id"), "dst_id"), "id").select("start", F.col("dst_id").alias("id")).distinct().withColumn("depth", F.lit(depth))
        reached = reached.unionByName(front)
    return reached.groupBy("start", "id").agg(F.min("depth").alias("depth")).where("depth > 0")


def recall(
    queries: DataFrame, store: DataFrame, edges: DataFrame, as_of: str, k: int = 8, budget: int = 1500, floor: float = -0.05, threshold: float = 0.3,
    quality: DataFrame | None = None, served: DataFrame | None = None, candidates: int = 200,
) -> DataFrame:
    """Questions (query_id, query) to what is worth injecting, in order: query_id, rank, id, score, spent.

    Where questions have a project, rows of other projects are out of scope; where they have a session, rows of it
    and rows already served in it (``served``: session_id, id) are left out.
    """
    work = Workspace(store.sparkSession, "recall")
    stored = work.table("store", embed(store))
    asked = embed(queries, "query")
    dense = dense_topk(asked, stored, candidates, floor)
    lexical = bm25_topk(queries, stored, candidates)
    if "project" in queries.columns:
        dense = ranked(scoped(dense.drop("rank"), queries, stored), "similarity")
        lexical = ranked(scoped(lexical.drop("rank"), queries, stored), "bm25")
    dense = work.table("dense", dense)
    hits = expand(blended(rrf(dense, gated(lexical, dense)), stored, as_of, quality), edges, stored)
    if "session_id" in queries.columns and served is not None:
        hits = without_known(hits, queries, stored, served)
    pool = ranked(hits, "score", 4 * k).join(stored.select("id", "vector"), "id", "left").select("query_id", "id", "score", "vector")
    chosen = mmr(pool, k).where(F.col("score") >= threshold).join(stored.select("id", "token_count"), "id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return within_budget(chosen.withColumn("rank", F.row_number().over(order)), budget).select("query_id", "rank", "id", "score", "spent")


def render(hits: DataFrame, store: DataFrame, width: int = 600) -> DataFrame:
    """One text per question: numbered entries of at most ``width`` characters and a footer."""
    text = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    entry = F.format_string("### %d. [%s] %s\nsource: %s", F.col("rank"), F.col("kind"), text, F.col("project"))
    rows = hits.select("query_id", "rank", "id").join(store.select("id", "kind", "text", "project"), "id").withColumn("entry", entry)
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("e"))
    return listed.select(
        "query_id",
        F.concat(F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n"), F.format_string("\n\n[%d recalled]", F.size("e"))).alias("rendered"),
    )
