"""Settling what recall was worth: verdicts from what followed it, and retrieval metrics over labelled questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.retrieval import digit_counts, dot, hash_digits, normalized


#: Phrases with which a user rejects, and an assistant contradicts, what was recalled.
REJECTIONS = (
    "no that's wrong", "that's not right", "that's incorrect", "that's outdated", "no, we", "no we", "actually we", "actually, we",
    "we switched", "we moved", "we changed", "we no longer", "that's not how", "not what i meant", "wrong approach",
    "we don't use", "we stopped using", "we dropped",
)
CONTRADICTIONS = (
    "however, looking at the current code", "but the current implementation", "actually use", "actually uses",
    "instead of what the memory", "contrary to the recalled", "the memory is outdated", "this is no longer",
)


#: Least words of a text that can be used, the share of its trigrams that shows it, and the least likeness.
MIN_WORDS, MATCH_SHARE, SEMANTIC = 4, 0.1, 0.45
HEX = "0123456789abcdef"


def says_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | text.contains(p), phrases, F.lit(False))


def later_bags(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(recall_id, artifact_id, bag) per row of (recall_id, artifact_id, session_id, since): summed word counts of later answers.

    answers: session_id, at, digits (the buckets of its words). Counts add up, so every row needs one running sum and no
    pair with an answer: sums of days are added up per session, and only a day's rows are put in order in one place.
    """
    size = len(HEX)
    parts = lambda prefix: [F.col(f"{prefix}{k}") for k in range(size)]
    said = answers.select("session_id", F.col("at").alias("t"), F.lit(0).alias("asks"), *[(F.length("digits") - F.length(F.translate("digits", d, ""))).cast("long").alias(f"c{k}") for k, d in enumerate(HEX)])
    points = asked.select("session_id", F.col("since").alias("t"), F.lit(1).alias("asks"), *[F.lit(0).cast("long").alias(f"c{k}") for k in range(size)]).distinct()
    rows = said.unionByName(points).withColumn("day", F.to_date("t"))
    days = rows.groupBy("session_id", "day").agg(*[F.sum(c).alias(f"d{k}") for k, c in enumerate(parts("c"))])
    after = Window.partitionBy("session_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("session_id", "day", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"d{k}") for k, c in enumerate(parts("d"))])
    within = Window.partitionBy("session_id", "day").orderBy(F.desc("t"))  # with its peers: answers of the same time count
    sums = rows.select("session_id", "day", "t", "asks", *[F.sum(c).over(within).alias(f"w{k}") for k, c in enumerate(parts("c"))]).where("asks = 1")
    bags = sums.join(days, ["session_id", "day"]).select("session_id", F.col("t").alias("since"), F.array(*[w + d for w, d in zip(parts("w"), parts("d"), strict=True)]).alias("bag"))
    return asked.select("recall_id", "artifact_id", "session_id", "since").join(bags, ["session_id", "since"]).drop("session_id", "since")


def phrases_used(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(recall_id, artifact_id) whose text (of four words or more) has a tenth of its word trigrams in later answers.

    asked: recall_id, artifact_id, session_id, since, text; answers: session_id, at, answer, lower-cased. A trigram
    stands in a text if its middle word stands between two spaces there, after its first and before its last. So
    answers are cut at spaces and kept once per session with the latest time, and meet the trigrams on the middle
    word and the letters beside it: no answer is held against every recall.
    """
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    rows = asked.withColumn("w", w).where(F.size("w") >= MIN_WORDS)
    word = lambda k: F.get("w", F.col("i") + k)
    ours = rows.select("recall_id", "artifact_id", "session_id", "since", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i"))
    ours = ours.select("recall_id", "artifact_id", "session_id", "since", (F.size("w") - 2).alias("n"), "i", word(0).alias("a"), word(1).alias("b"), word(2).alias("c"))
    ours = ours.withColumns({"x": F.right("a", F.lit(1)), "y": F.left("c", F.lit(1))})
    cut = answers.select("session_id", "at", F.split("answer", " ").alias("s")).where(F.size("s") >= 3)
    token = lambda k: F.get("s", F.col("j") + k)
    theirs = cut.select("session_id", "at", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 3)).alias("j")).select("session_id", "at", token(0).alias("p"), token(1).alias("b"), token(2).alias("q"))
    theirs = theirs.where("p <> '' AND b <> '' AND q <> ''").groupBy("session_id", "p", "b", "q").agg(F.max("at").alias("at"))
    theirs = theirs.withColumns({"x": F.right("p", F.lit(1)), "y": F.left("q", F.lit(1))})
    met = ours.join(theirs, ["session_id", "b", "x", "y"]).where((F.col("at") >= F.col("since")) & F.col("p").endswith(F.col("a")) & F.col("q").startswith(F.col("c")))
    found = met.groupBy("recall_id", "artifact_id", "n").agg(F.countDistinct("i").alias("found"))
    return found.where(F.col("found") >= F.greatest(F.lit(1), F.ceil(F.col("n") * MATCH_SHARE))).select("recall_id", "artifact_id")


def feedback_verdicts(pending: DataFrame, turns: DataFrame, semantic: bool = True) -> DataFrame:
    """(recall_id, artifact_id, outcome, method) of pending verdicts (recall_id, artifact_id, session_id, since, text).

    Only turns (session_id, role, ts, text) of the recall's session at or after it count; turns without a time
    always do. A rejection by the user or a contradiction by the assistant outranks use. Use is shared word trigrams
    with what the assistant wrote, or else the likeness of the memory to all of that together. What was served and
    not used is unused, also where nobody answered; rows stay pending only if their session says nothing at all, or
    their text is empty.
    """
    lower = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull()).withColumn("text", F.lower(F.col("text")))
    endless = F.coalesce("ts", F.to_timestamp(F.lit("9999-01-01 00:00:00")))
    last = lower.groupBy("session_id").agg(
        F.max(F.when((F.col("role") == "user") & says_any(F.col("text"), REJECTIONS), endless)).alias("rejected"),
        F.max(F.when((F.col("role") == "assistant") & says_any(F.col("text"), CONTRADICTIONS), endless)).alias("contradicted"),
    )
    asked = pending.where(F.coalesce("text", F.lit("")) != "")
    answers = lower.where("role = 'assistant'").select("session_id", endless.alias("at"), F.col("text").alias("answer"))
    used = phrases_used(asked, answers).withColumn("used", F.lit(True))
    rows = asked.join(last, "session_id").join(used, ["recall_id", "artifact_id"], "left")
    alike = F.lit(False)
    if semantic:
        # exploded, so that a text is hashed once and not for each of its counts
        once = lambda text: F.explode(F.array(hash_digits(F.col(text))))
        bags = later_bags(asked, answers.select("session_id", "at", once("answer").alias("digits")))
        own = asked.select("recall_id", "artifact_id", once("text").alias("_digits"))
        rows = rows.join(bags, ["recall_id", "artifact_id"], "left").join(own, ["recall_id", "artifact_id"], "left").withColumn("_own", normalized(digit_counts(F.col("_digits"))))
        words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
        near = F.round(dot(F.col("_own"), normalized(F.col("bag"))), 9) >= SEMANTIC
        alike = F.coalesce((words >= MIN_WORDS) & near, F.lit(False))
    against = F.coalesce(F.col("rejected") >= F.col("since"), F.lit(False)) | F.coalesce(F.col("contradicted") >= F.col("since"), F.lit(False))
    outcome = F.when(against, "rejected").when(F.col("used") | alike, "used").otherwise("unused")
    method = F.when(against, "phrase").when(F.col("used"), "ngram").when(alike, "semantic").otherwise("")
    return rows.select("recall_id", "artifact_id", outcome.alias("outcome"), method.alias("method"))


def ranking_metrics(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, ndcg) at k for every question with relevant rows; gains are 0 or 1, discounted by log2(rank + 1)."""
    wanted = relevant.select("query_id", "id").distinct()
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = found.where(F.col("rank") <= k).join(wanted, ["query_id", "id"])
    got = hits.groupBy("query_id").agg(F.countDistinct("id").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    rows = total.join(got, "query_id", "left")
    return rows.select(
        "query_id",
        F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), 9).alias("recall"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 9).alias("ndcg"),
    )


def suite_summary(results: DataFrame, full_tokens: Column) -> DataFrame:
    """Per strategy of (strategy, query_id, recall, ndcg, tokens_sent, latency_ms): means, tokens saved, latencies at half and at 95 %.

    Percentiles are the values at these places of the sorted latencies, not between two of them.
    """
    order = Window.partitionBy("strategy").orderBy("latency_ms", "query_id")
    placed = results.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("strategy")))
    at = lambda share: F.max(F.when(F.col("i") == F.floor(F.col("n") * share), F.col("latency_ms")))
    tokens = F.avg("tokens_sent")
    return placed.groupBy("strategy").agg(
        F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(tokens, 6).alias("tokens_sent"),
        F.round(F.when(F.avg(full_tokens) > 0, 1 - tokens / F.avg(full_tokens)).otherwise(0.0), 6).alias("token_savings_vs_full"),
        at(0.5).alias("latency_p50"), at(0.95).alias("latency_p95"),
    )


def win_tie_loss(treated: DataFrame, base: DataFrame, metric: str = "recall") -> DataFrame:
    """How often the treated strategy did better, as well and worse than the base on the same questions."""
    pairs = treated.select("query_id", F.col(metric).alias("t")).join(base.select("query_id", F.col(metric).alias("b")), "query_id")
    counts = pairs.agg(F.count("*").alias("n_cases"), F.count_if(F.expr("t > b")).alias("win_count"), F.count_if(F.expr("t = b")).alias("tie_count"), F.count_if(F.expr("t < b")).alias("loss_count"))
    pct = lambda c: F.coalesce(F.round(100 * c / F.nullif(F.col("n_cases"), F.lit(0)), 1), F.lit(0.0))
    return counts.select(
        "*", *[pct(F.col(f"{c}_count")).alias(f"{c}_pct") for c in ("win", "tie", "loss")],
        F.when(F.col("n_cases") == 0, 100.0).otherwise(pct(F.col("win_count") + F.col("tie_count"))).alias("do_no_harm_pct"),
    )


def eval_cases(chunks: DataFrame, min_prior_sessions: int = 1) -> DataFrame:
    """Per session after the first ones: its opening chunk as question, and the tokens of all sessions before it.

    Sessions go by the time of their opening chunk. Their table, one row each, is summed by day first, so that no
    more than a day's sessions are put in order in one place.
    """
    opening = F.min(F.struct("ord", "id", "created_at"))
    sessions = chunks.groupBy("project", "session_id").agg(opening.alias("first"), F.sum("token_count").alias("tokens"))
    rows = sessions.select("project", "session_id", F.col("first.id").alias("opening_id"), F.col("first.created_at").alias("at"), "tokens")
    rows = rows.withColumn("day", F.to_date("at"))
    before = Window.partitionBy("project").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("project", "day").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    days = days.select("project", "day", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("project", "day").orderBy("at", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("t1", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn("n1", F.count("*").over(inside)).join(days, ["project", "day"])
    return placed.select(
        "project", "session_id", "opening_id", (F.col("n0") + F.col("n1")).alias("prior_sessions"), (F.col("t0") + F.col("t1")).alias("full_tokens")
    ).where(F.col("prior_sessions") >= min_prior_sessions)


