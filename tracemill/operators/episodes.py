"""Episodes of work, their cost, and comparisons with and without recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands of prompt length and of tool calls, with their names.
PROMPT_BANDS, PROMPT_NAMES = (0, 60, 150, 400), ("0-60", "60-150", "150-400", "400-+")
TOOL_BANDS, TOOL_NAMES = (0, 1, 4, 12), ("0-1", "1-4", "4-12", "12-+")
#: Least episodes per arm, per cell of a prompt band and per cell of a tool band.
MIN_ARM, MIN_STRATUM, MIN_BAND = 20, 20, 15
#: Least recalls and episodes per side and arm, and what a shift must exceed, in points and in percent.
MIN_RECALLS, MIN_EPISODES = 50, 30
NOISE_POINTS = 6.0
EFFECT_PCT = 10.0


def band(value: Column, bounds: tuple[int, ...]) -> Column:
    """Index of the half-open band that holds a value; the last one has no end."""
    out = F.when(value < bounds[1], 0)
    for i in range(1, len(bounds) - 1):
        out = out.when(value < bounds[i + 1], i)
    return out.otherwise(len(bounds) - 1)


def sessionize(records: DataFrame) -> DataFrame:
    """Number the episodes of every session: a prompt opens one, rows before the first prompt are dropped.

    records: session_id, ord, is_prompt and anything else.
    """
    w = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("episode", F.sum(F.col("is_prompt").cast("int")).over(w)).where("episode > 0")


def reduction_pct(base: Column, treated: Column) -> Column:
    """Percent by which ``treated`` lies below ``base``: positive for less; null for a null or zero base."""
    return F.round(100 * (base - treated) / F.nullif(base.cast("double"), F.lit(0.0)), 1)


def episodes(records: DataFrame) -> DataFrame:
    """One row per episode; cost units are input + 1.25 cache writes + 0.1 cache reads + 5 output tokens."""
    prompt = F.col("is_prompt")
    tokens = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")
    out = sessionize(records).groupBy("session_id", "episode").agg(
        F.min("project").alias("project"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.bool_or("had_recall").alias("had_recall"),
        F.max(F.when(prompt, F.col("chars"))).alias("prompt_chars"),
        F.count_if(F.col("role") == "assistant").alias("assistant_steps"),
        F.sum("tool_calls").alias("tool_calls"),
        *[F.sum(c).alias(c) for c in tokens],
    )
    context = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    cost = F.col("input_tokens") + 1.25 * F.col("cache_creation_tokens") + 0.1 * F.col("cache_read_tokens") + 5.0 * F.col("output_tokens")
    return out.withColumns({"total_tokens": context + F.col("output_tokens"), "cost_units": F.round(cost, 6)})


def usable(found: DataFrame) -> DataFrame:
    """Episodes in which the assistant did something."""
    return found.where("assistant_steps > 0")


def arm_stats(found: DataFrame) -> DataFrame:
    """Usable episodes with and without recall: exact medians and means."""
    return usable(found).groupBy("had_recall").agg(
        F.count("*").alias("n"),
        *[F.round(F.median(c).cast("double"), 6).alias(f"median_{c}") for c in ("tool_calls", "total_tokens", "assistant_steps", "prompt_chars")],
        F.round(F.avg("tool_calls"), 2).alias("mean_tool_calls"),
        F.round(F.avg("total_tokens")).alias("mean_total_tokens"),
    )


def compare_arms(found: DataFrame, min_per_arm: int = MIN_ARM) -> DataFrame:
    """Reductions of tool calls and tokens with recall, overall and by project, once both arms are large enough.

    Tool calls are compared by median within a project and by mean overall, tokens by median.
    """
    with_recall = F.col("had_recall")

    def arm(aggregate, column: str, flag: bool) -> Column:
        return aggregate(F.when(with_recall == flag, F.col(column)))

    sides = [
        arm(f, c, flag).alias(f"{n}{int(flag)}")
        for n, f, c in (("median", F.median, "tool_calls"), ("mean", F.avg, "tool_calls"), ("tokens", F.median, "total_tokens"))
        for flag in (False, True)
    ]
    grouped = usable(found).groupingSets([["project"], []], "project").agg(
        F.count_if(with_recall).alias("n_with"), F.count_if(~with_recall).alias("n_without"), F.grouping("project").alias("whole"), *sides
    )
    scored = (F.col("n_with") >= min_per_arm) & (F.col("n_without") >= min_per_arm)
    tools = F.when(F.col("whole") == 1, reduction_pct(F.col("mean0"), F.col("mean1"))).otherwise(reduction_pct(F.col("median0"), F.col("median1")))
    return grouped.select(
        F.when(F.col("whole") == 0, F.col("project")).alias("project"), (F.col("whole") == 1).alias("overall"), "n_with", "n_without", scored.alias("scored"),
        F.when(scored, tools).alias("tool_call_delta_pct"), F.when(scored, reduction_pct(F.col("tokens0"), F.col("tokens1"))).alias("token_delta_pct"),
    )


def stratified_deltas(found: DataFrame, min_per_cell: int = MIN_STRATUM) -> DataFrame:
    """Reduction of mean tool calls with recall per band of prompt length; cells that are too small are kept, unscored."""
    with_recall = F.col("had_recall")
    cells = usable(found).groupBy(band(F.col("prompt_chars"), PROMPT_BANDS).alias("stratum")).agg(
        F.count_if(with_recall).alias("n_with"),
        F.count_if(~with_recall).alias("n_without"),
        F.avg(F.when(with_recall, F.col("tool_calls"))).alias("w"),
        F.avg(F.when(~with_recall, F.col("tool_calls"))).alias("o"),
    )
    every = found.sparkSession.createDataFrame(list(enumerate(PROMPT_NAMES)), "stratum int, prompt_chars string")
    rows = every.join(cells, "stratum", "left").withColumns({"n_with": F.coalesce("n_with", F.lit(0)), "n_without": F.coalesce("n_without", F.lit(0))})
    scored = (F.col("n_with") >= min_per_cell) & (F.col("n_without") >= min_per_cell)
    return rows.select("stratum", "prompt_chars", "n_with", "n_without", scored.alias("scored"), F.when(scored, reduction_pct(F.col("o"), F.col("w"))).alias("tool_call_delta_pct"))


def effect(cells: DataFrame, delta: str) -> DataFrame:
    """Cells that count (``scored_cells``) and whether their deltas differ in being positive (``mixed``)."""
    counts = F.col("scored") & F.col(delta).isNotNull()
    positive = F.when(counts, F.col(delta) > 0)
    return cells.agg(F.count_if(counts).alias("scored_cells"), F.coalesce(F.min(positive) != F.max(positive), F.lit(False)).alias("mixed"))


def stratum_verdict(found: DataFrame, min_per_arm: int = MIN_ARM, min_per_cell: int = MIN_STRATUM) -> DataFrame:
    """saves or costs only if the overall reduction is large and no stratum points the other way."""
    overall = compare_arms(found, min_per_arm).where("overall").select("scored", "tool_call_delta_pct")
    strata = effect(stratified_deltas(found, min_per_cell), "tool_call_delta_pct")
    delta = F.col("tool_call_delta_pct")
    verdict = (
        F.when(~F.col("scored") | (F.col("scored_cells") < 2), "insufficient_data")
        .when(F.col("mixed") | delta.isNull() | (F.abs(delta) < EFFECT_PCT), "no_effect")
        .when(delta > 0, "saves")
        .otherwise("costs")
    )
    # one row each
    return overall.join(strata).select("scored", "scored_cells", delta.alias("tool_call_delta_pct"), verdict.alias("verdict"))


def cost_compare(found: DataFrame, boundary: str, min_per_cell: int = MIN_BAND) -> DataFrame:
    """Median cost before and after a boundary per band of tool calls; cells that are too small are kept, unscored."""
    after = F.col("started_at") >= F.to_timestamp(F.lit(boundary))
    cells = usable(found).groupBy(band(F.col("tool_calls"), TOOL_BANDS).alias("tool_band")).agg(
        F.count_if(~after).alias("n_before"),
        F.count_if(after).alias("n_after"),
        F.median(F.when(~after, F.col("cost_units"))).alias("b"),
        F.median(F.when(after, F.col("cost_units"))).alias("a"),
    )
    every = found.sparkSession.createDataFrame(list(enumerate(TOOL_NAMES)), "tool_band int, tool_calls string")
    rows = every.join(cells, "tool_band", "left").withColumns({"n_before": F.coalesce("n_before", F.lit(0)), "n_after": F.coalesce("n_after", F.lit(0))})
    scored = (F.col("n_before") >= min_per_cell) & (F.col("n_after") >= min_per_cell)
    return rows.select(
        "tool_band", "tool_calls", "n_before", "n_after", scored.alias("scored"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("median_cost_before"),
        F.round(F.coalesce("a", F.lit(0.0)), 6).alias("median_cost_after"), F.when(scored, reduction_pct(F.col("b"), F.col("a"))).alias("cost_delta_pct"),
    )


def cost_verdict(found: DataFrame, boundary: str, min_per_cell: int = MIN_BAND) -> DataFrame:
    """cheaper or dearer only if the overall shift is large and no band points the other way."""
    after = F.col("started_at") >= F.to_timestamp(F.lit(boundary))
    overall = usable(found).agg(
        F.count_if(~after).alias("n_before"), F.count_if(after).alias("n_after"),
        reduction_pct(F.median(F.when(~after, F.col("cost_units"))), F.median(F.when(after, F.col("cost_units")))).alias("cost_delta_pct"),
    )
    bands = effect(cost_compare(found, boundary, min_per_cell), "cost_delta_pct")
    delta = F.col("cost_delta_pct")
    verdict = (
        F.when(F.col("scored_cells") < 2, "insufficient_data").when(F.col("mixed") | delta.isNull() | (F.abs(delta) < EFFECT_PCT), "no_effect")
        .when(delta > 0, "cheaper").otherwise("dearer")
    )
    return overall.join(bands).select("n_before", "n_after", "scored_cells", "cost_delta_pct", verdict.alias("verdict"))


def recall_did(recalls: DataFrame, found: DataFrame, boundary: str, min_recalls: int = MIN_RECALLS, min_episodes: int = MIN_EPISODES) -> DataFrame:
    """Difference in differences, in points: how the gap in median tool calls without and with recall moved at a boundary."""
    at = F.to_timestamp(F.lit(boundary))
    gate = recalls.agg(F.count_if(F.col("timestamp") < at).alias("recalls_before"), F.count_if(F.col("timestamp") >= at).alias("recalls_after"))

    def gap(after: bool) -> Column:
        side = F.col("started_at") >= at if after else F.col("started_at") < at
        arm = {flag: side & (F.col("had_recall") == flag) for flag in (False, True)}
        enough = F.least(*[F.count_if(c) for c in arm.values()]) >= min_episodes
        medians = {flag: F.median(F.when(c, F.col("tool_calls"))) for flag, c in arm.items()}
        return F.when(enough, reduction_pct(medians[False], medians[True]))

    ep = usable(found).agg(
        F.count_if(F.col("started_at") < at).alias("episodes_before"), F.count_if(F.col("started_at") >= at).alias("episodes_after"),
        gap(False).alias("gap_before"), gap(True).alias("gap_after"),
    )
    did = F.round(F.col("gap_after") - F.col("gap_before"), 1)
    verdict = (
        F.when(F.col("recalls_after") == 0, "no_data_yet").when(F.col("recalls_after") < min_recalls, "too_early").when(did.isNull(), "retrieval_only")
        .when(F.abs(did) < NOISE_POINTS, "no_effect").when(did > 0, "improved").otherwise("regressed")
    )
    return gate.join(ep).select("recalls_before", "recalls_after", "episodes_before", "episodes_after", "gap_before", "gap_after", did.alias("did_pp"), verdict.alias("verdict"))


def retrieval_health(recalls: DataFrame, boundary: str, min_recalls: int = MIN_RECALLS) -> DataFrame:
    """Both sides of a boundary: recalls, hit rate and exact medians over hits (0 without hits)."""
    hit = F.col("hits_count") > 0
    median = lambda c, digits: F.round(F.coalesce(F.median(F.when(hit, F.coalesce(c, F.lit(0)))).cast("double"), F.lit(0.0)), digits)
    return recalls.groupBy(F.when(F.col("timestamp") < F.to_timestamp(F.lit(boundary)), "before").otherwise("after").alias("side")).agg(
        F.count("*").alias("recalls"), F.round(F.count_if(hit) / F.count("*"), 3).alias("hit_rate"), median("top_score", 3).alias("median_top_score"),
        median("tokens_injected", 1).alias("median_tokens"), (F.count("*") >= min_recalls).alias("scored"),
    )


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_id: str) -> DataFrame:
    """Every left row with the last right row of its key at or before it; left rows without one are dropped.

    One sorted pass over the union instead of a range join: no key's rows are paired.
    """
    l = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"))
    r = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(right_id).alias("_id"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_found", F.last("_id", ignorenulls=True).over(w))
    return both.where("_side = 1 AND _found IS NOT NULL").select("_row.*", F.col("_found").alias(right_id))


def near_in_time(turns: DataFrame, recalls: DataFrame, key: str, seconds: int, turn_at: str = "user_timestamp", recall_at: str = "timestamp") -> DataFrame:
    """Turns with a recall of the same key less than ``seconds`` away, by the neighbours on a sorted timeline."""
    t = turns.select(key, F.col(turn_at).alias("_at"), F.struct(*turns.columns).alias("_row"))
    r = recalls.select(key, F.col(recall_at).alias("_at"), F.lit(None).cast(t.schema["_row"].dataType).alias("_row"))
    line = t.unionByName(r).withColumn("_recall", F.when(F.col("_row").isNull(), F.col("_at")))
    order = Window.partitionBy(key).orderBy("_at")
    before = F.last("_recall", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_recall", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = lambda a, b: micros(a) - micros(b)
    limit = seconds * 1_000_000
    near = line.withColumns({"_b": before, "_a": after}).where(F.col("_row").isNotNull())
    return near.where((gap(F.col("_at"), F.col("_b")) < limit) | (gap(F.col("_a"), F.col("_at")) < limit)).select("_row.*")


def recalls_of(recalls: DataFrame, keys: DataFrame) -> DataFrame:
    """Recalls whose session or conversation is asked for: a union of two equality joins, each recall once."""
    by_session = recalls.join(keys.select("session_id").distinct(), "session_id", "left_semi")
    by_conversation = recalls.join(keys.select("conversation_key").distinct(), "conversation_key", "left_semi")
    return by_session.unionByName(by_conversation).dropDuplicates(["id"])


def pair_turns(records: DataFrame) -> DataFrame:
    """The first assistant record after each user record."""
    w = Window.partitionBy("session_id").orderBy("ord")
    rows = records.where(F.col("role").isin("user", "assistant"))
    return rows.withColumn("_before", F.lag("role").over(w)).withColumn("user_ord", F.lag("ord").over(w)).where("role = 'assistant' AND _before = 'user'").drop("_before")
