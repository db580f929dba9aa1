"""Distilling sessions into their key chunks, without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace

#: Extracts of a session, rounds of clustering; sessions above so many tokens are cut to head and tail.
MAX_EXTRACTS, ROUNDS = 12, 8
LONG_SESSION, HEAD, TAIL = 4000, 10, 5


def head_and_tail(chunks: DataFrame, most: int = LONG_SESSION, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """Whole sessions up to ``most`` tokens; of longer ones the first and the last chunks (one may be both, and is listed twice).

    Only the first and last few of a session are ranked, which Spark cuts in every task before the shuffle.
    """
    total = chunks.groupBy("session_id").agg(F.sum("token_count").alias("total"))
    rows = chunks.join(total, "session_id")
    short = rows.where(F.col("total") <= most)
    long = rows.where(F.col("total") > most)
    first = long.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "id"))).where(F.col("_k") <= head)
    last = long.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("ord").desc(), F.col("id").desc()))).where(F.col("_k") <= tail)
    return short.unionByName(first.drop("_k")).unionByName(last.drop("_k")).select("session_id", "id", "ord")


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cluster_representatives(points: DataFrame, most: int = MAX_EXTRACTS, rounds: int = ROUNDS) -> DataFrame:
    """Of (session_id, id, ord, vector), at most ``most`` per session: the one nearest to each centre of a k-means with fixed rounds.

    Centres start at evenly spaced points. A round pairs points with the few centres of their session; means are
    aggregates, so a session of any size spreads. Ties go to the lower centre and the earlier point.
    """
    work = Workspace(points.sparkSession, "cluster")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "id")) - 1
    sizes = points.groupBy("session_id").agg(F.count("*").alias("n"))
    rows = work.table("points", points.select("session_id", "id", "ord", F.col("vector").cast("array<double>").alias("vector"), place.alias("i")).join(sizes, "session_id"))
    few, many = rows.where(F.col("n") <= most), rows.where(F.col("n") > most)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most)).cast("int")
    centres = many.where((F.col("i") % step == 0) & (F.col("i") / step < most)).select("session_id", (F.col("i") / step).cast("int").alias("j"), "vector")
    centres = work.table("centres", centres)
    seeds = centres.select("session_id", "j")
    dimensions = (many.agg(F.max(F.size("vector"))).first()[0]) or 0

    def nearest(centres: DataFrame) -> DataFrame:
        pairs = many.join(centres.select("session_id", "j", F.col("vector").alias("c")), "session_id")
        return pairs.groupBy("session_id", "id", "i", "ord", "vector").agg(F.min(F.struct(_squares(F.col("vector"), F.col("c")).alias("d"), "j")).alias("best"))

    assigned = None
    for k in range(rounds):
        assigned = work.table(f"assigned-{k}", nearest(centres).select("session_id", "id", "i", "ord", "vector", "best.j"))
        means = assigned.groupBy("session_id", "j").agg(F.array(*[F.avg(F.get("vector", F.lit(x))) for x in range(dimensions)]).alias("mean"))
        moved = seeds.join(means, ["session_id", "j"], "left")
        zero = F.array(*[F.lit(0.0)] * dimensions)
        centres = work.table(f"centres-{k}", moved.select("session_id", "j", F.coalesce("mean", zero).alias("vector")))
    final = assigned.join(centres.select("session_id", "j", F.col("vector").alias("c")), ["session_id", "j"])
    chosen = final.groupBy("session_id", "j").agg(F.min(F.struct(_squares(F.col("vector"), F.col("c")).alias("d"), "i", "id", "ord")).alias("best"))
    return few.select("session_id", "id", "ord").unionByName(chosen.select("session_id", "best.id", "best.ord"))


def key_chunks(chunks: DataFrame, scores: DataFrame, most: int = MAX_EXTRACTS) -> DataFrame:
    """The key chunks of every session (chunks: session_id, id, ord, vector; scores: session_id, id, score), numbered in their order.

    Chunks with a score above 0 compete, or all if a session has none.
    """
    rows = chunks.join(scores.select("session_id", "id", "score"), ["session_id", "id"])
    good = rows.groupBy("session_id").agg(F.bool_or(F.col("score") > 0).alias("_good"))
    viable = rows.join(good, "session_id").where(~F.col("_good") | (F.col("score") > 0)).select("session_id", "id", "ord", "vector")
    order = Window.partitionBy("session_id").orderBy("ord", "id")
    return cluster_representatives(viable, most).withColumn("place", F.row_number().over(order)).select("session_id", "place", "id")
