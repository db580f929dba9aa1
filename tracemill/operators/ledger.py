"""Analytics over the recall, savings and verdict ledgers and over the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Context window, requests below which a sample is small, neutral quality.
CONTEXT_WINDOW = 200_000
LOW_SAMPLE = 30
NEUTRAL_QUALITY = 0.5


def _rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def recall_totals(recalls: DataFrame) -> DataFrame:
    return recalls.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("tokens_injected"), F.lit(0)).alias("tokens"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        _rate(F.count_if(F.col("hits_count") > 0), F.count("*")).alias("hit_rate"),
    )


def recalls_by_project(recalls: DataFrame) -> DataFrame:
    """Scores are averaged over hits only."""
    return recalls.groupBy("project").agg(
        F.count("*").alias("recalls"),
        F.sum("tokens_injected").alias("tokens"),
        F.round(F.avg(F.when(F.col("hits_count") > 0, F.col("top_score"))), 6).alias("avg_score"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "extractive_only", "no_hits")],
    )


def recalls_by_agent(recalls: DataFrame, unnamed: str = "claude") -> DataFrame:
    return recalls.groupBy(F.coalesce("agent", F.lit(unnamed)).alias("agent")).agg(
        F.count("*").alias("recalls"), F.sum("tokens_injected").alias("tokens"), F.count_if(F.col("hits_count") > 0).alias("with_hits")
    )


def recall_trend(recalls: DataFrame, as_of: str, days: int = 30, agent: str | None = None) -> DataFrame:
    since = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    rows = recalls.where(F.col("timestamp") >= since)
    if agent is not None:
        rows = rows.where(F.coalesce("agent", F.lit("claude")) == agent)
    return rows.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(
        F.count("*").alias("recalls"), F.sum("tokens_injected").alias("tokens"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms")
    )


def recent_recalls(recalls: DataFrame, limit: int = 50, project: str | None = None, agent: str | None = None) -> DataFrame:
    """The most recent recalls; a limit is the point of this report."""
    rows = recalls
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if agent is not None:
        rows = rows.where(F.coalesce("agent", F.lit("claude")) == agent)
    return rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit).select("id", "project", "hits_count", "status")


def agent_desk(recalls: DataFrame, savings: DataFrame) -> DataFrame:
    """Recall figures per agent beside its savings, agents of either ledger."""
    r = recalls.groupBy(F.coalesce("agent", F.lit("claude")).alias("agent")).agg(
        F.count("*").alias("recalls"), F.sum("tokens_injected").alias("tokens_injected"), F.countDistinct("session_id").alias("sessions")
    )
    s = savings_by_agent(savings).select("agent", "requests", "tokens_saved")
    return r.join(s, "agent", "full_outer").select(
        "agent", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("recalls", "tokens_injected", "sessions", "requests", "tokens_saved")]
    )


def context_efficiency(recalls: DataFrame, limit: int = 50) -> DataFrame:
    """Per session: what recalls cost of the context window; the most recent sessions."""
    return (
        recalls.groupBy("session_id")
        .agg(
            F.count("*").alias("prompts"),
            F.sum("tokens_injected").alias("injected"),
            _rate(F.count_if(F.col("hits_count") > 0), F.count("*")).alias("coverage"),
            F.round(100.0 * F.sum("tokens_injected") / CONTEXT_WINDOW, 6).alias("overhead_pct"),
            F.min("timestamp").cast("string").alias("first_seen"),
            F.max("timestamp").alias("last"),
        )
        .orderBy(F.col("last").desc(), "session_id")
        .limit(limit)
        .drop("last")
    )


def context_totals(recalls: DataFrame) -> DataFrame:
    return recalls.agg(
        F.countDistinct("session_id").alias("sessions"),
        F.count("*").alias("prompts"),
        F.sum("tokens_injected").alias("injected"),
        F.round(F.sum("tokens_injected") / F.count("*"), 6).alias("per_prompt"),
    )


def session_stats(records: DataFrame) -> DataFrame:
    """Per session of (session_id, project, is_prompt, had_recall, tool_calls, tokens, ts): turns, turns with recall, tokens and tool calls."""
    return records.groupBy("session_id").agg(
        F.min("project").alias("project"),
        F.count_if("is_prompt").alias("turn_count"),
        F.count_if(F.col("is_prompt") & F.col("had_recall")).alias("recall_turn_count"),
        F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")).alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("tool_calls").alias("tool_call_count"),
        F.max("ts").alias("last_turn_at"),
    )


def session_efficiency(stats: DataFrame) -> DataFrame:
    """Input tokens and tool calls per turn as ratios of sums, of all sessions and with and without recall, and the gain in percent."""
    arms = {"": F.lit(True), "_with_recall": F.col("recall_turn_count") > 0, "_without_recall": F.col("recall_turn_count") == 0}

    def ratio(column: str, arm: Column, digits: int) -> Column:
        turns = F.sum(F.when(arm, F.col("turn_count")))
        return F.coalesce(F.round(F.sum(F.when(arm, F.col(column))) / F.nullif(turns, F.lit(0)), digits), F.lit(0.0))

    out = stats.where("turn_count > 0").agg(
        F.count("*").alias("total_sessions"),
        *[F.count_if(arm).alias(f"sessions{name}") for name, arm in arms.items() if name],
        *[ratio("total_input_tokens", arm, 0).alias(f"avg_input_per_turn{name}") for name, arm in arms.items()],
        *[ratio("tool_call_count", arm, 1).alias(f"avg_tool_calls{name}") for name, arm in arms.items() if name],
    )
    base = F.col("avg_input_per_turn_without_recall")
    gain = F.when(base > 0, F.round((1 - F.col("avg_input_per_turn_with_recall") / base) * 100, 1)).otherwise(0.0)
    return out.withColumn("efficiency_gain_pct", gain)


def recent_sessions(stats: DataFrame, limit: int = 50) -> DataFrame:
    """The sessions that ended last, with their input per turn."""
    per_turn = F.round(F.col("total_input_tokens") / F.col("turn_count"))
    rows = stats.where("turn_count > 0").orderBy(F.col("last_turn_at").desc(), "session_id").limit(limit)
    return rows.select("session_id", "project", "turn_count", "recall_turn_count", "tool_call_count", per_turn.alias("avg_input_per_turn"), (F.col("recall_turn_count") > 0).alias("has_recall"))


def roi_overall(turns: DataFrame) -> DataFrame:
    return turns.agg(
        F.count_if("had_recall").alias("turns_with"),
        F.count_if(~F.col("had_recall")).alias("turns_without"),
        F.avg(F.when(F.col("had_recall"), F.col("tool_call_count"))).alias("w"),
        F.avg(F.when(~F.col("had_recall"), F.col("tool_call_count"))).alias("o"),
    ).select(
        "turns_with",
        "turns_without",
        F.round("w", 6).alias("avg_with"),
        F.round("o", 6).alias("avg_without"),
        F.round(F.when(F.col("o") > 0, 100 * (F.col("o") - F.col("w")) / F.col("o")), 6).alias("reduction_pct"),
    )


def roi_trend(turns: DataFrame) -> DataFrame:
    """Days on which turns with and without recall both occur; all days are covered."""
    return (
        turns.groupBy(F.to_date("user_timestamp").cast("string").alias("day"))
        .agg(
            F.count_if("had_recall").alias("turns_with"),
            F.count_if(~F.col("had_recall")).alias("turns_without"),
            F.round(F.avg(F.when(F.col("had_recall"), F.col("tool_call_count"))), 6).alias("avg_with"),
            F.round(F.avg(F.when(~F.col("had_recall"), F.col("tool_call_count"))), 6).alias("avg_without"),
        )
        .where("turns_with > 0 AND turns_without > 0")
    )


#: Types of memories that only a language model distils.
DISTILLED_TYPES = ("decision", "lesson", "snippet", "bugfix")


def onboarding_status(store: DataFrame) -> DataFrame:
    """How far a store of (kind, mem_type, active) has come: no_data, ingesting, extractive or full."""
    memory = F.col("active") & (F.col("kind") == "memory")
    return store.agg(
        F.count_if(F.col("active") & (F.col("kind") == "session_chunk")).alias("chunks"),
        F.count_if(memory).alias("memories"),
        F.count_if(memory & F.col("mem_type").isin(*DISTILLED_TYPES)).alias("distilled"),
    ).withColumn(
        "status",
        F.when(F.col("chunks") == 0, "no_data").when(F.col("memories") == 0, "ingesting").when(F.col("distilled") > 0, "full").otherwise("extractive"),
    )


def savings_summary(savings: DataFrame) -> DataFrame:
    """All requests, those passed through too."""
    return savings.agg(
        F.count("*").alias("requests"),
        F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"),
        F.count_if("passthrough").alias("passed_through"),
    ).withColumn("saved_pct", F.when(F.col("tokens_before") > 0, F.round(100.0 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"), 6)).otherwise(0.0))


def savings_series(savings: DataFrame) -> DataFrame:
    """Per day without passed-through requests, with a running total; the running sum is over days only."""
    days = (
        savings.where(~F.col("passthrough"))
        .groupBy(F.to_date("timestamp").cast("string").alias("day"))
        .agg(F.count("*").alias("requests"), F.sum(F.greatest(F.lit(0), F.col("tokens_before") - F.col("tokens_after"))).alias("saved"))
    )
    return days.withColumn("running", F.sum("saved").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def savings_by_agent(savings: DataFrame) -> DataFrame:
    active = ~F.col("passthrough")
    saved = F.col("tokens_before") - F.col("tokens_after")
    return savings.groupBy("agent").agg(
        F.count_if(active).alias("requests"),
        F.count_if("passthrough").alias("passed_through"),
        F.coalesce(F.sum(F.when(active, F.col("tokens_before"))), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum(F.when(active, saved)), F.lit(0)).alias("tokens_saved"),
        (F.count_if(active) < LOW_SAMPLE).alias("low_sample"),
    )


def savings_by_type(savings: DataFrame) -> DataFrame:
    """Payload counts per content type, from the map column."""
    return (
        savings.select("passthrough", F.explode("content_types").alias("content_type", "n"))
        .groupBy("content_type")
        .agg(F.sum("n").alias("payloads"), F.count("*").alias("requests"), F.count_if(~F.col("passthrough")).alias("compressed"))
    )


#: Fixed value: requests from which on it tells something that no code was compressed.
LIVENESS_REQUESTS = 40


def liveness(savings: DataFrame, enabled: bool, started_at: str | None) -> DataFrame:
    """Whether a switched-on compression takes effect: off, on (start unknown), pending, not_taking_effect or live.

    Counts requests since the start and the payloads of types that begin with ``code`` among them.
    """
    since = F.lit(False) if started_at is None else F.col("timestamp") >= F.to_timestamp(F.lit(started_at))
    code = F.aggregate(F.map_entries("content_types"), F.lit(0).cast("long"), lambda n, e: n + F.when(e["key"].startswith("code"), e["value"]).otherwise(0))
    state = (
        F.when(F.lit(not enabled), "off").when(F.lit(started_at is None), "on").when(F.col("requests") == 0, "pending")
        .when((F.col("code_payloads") == 0) & (F.col("requests") >= LIVENESS_REQUESTS), "not_taking_effect").when(F.col("code_payloads") == 0, "pending").otherwise("live")
    )
    counts = savings.agg(F.count_if(since).alias("requests"), F.coalesce(F.sum(F.when(since, code)), F.lit(0)).alias("code_payloads"))
    return counts.withColumn("state", state)


def corpus_summary(store: DataFrame) -> DataFrame:
    return store.groupBy("kind").agg(
        F.count("*").alias("artifacts"), F.sum("token_count").alias("tokens"), F.countDistinct("project").alias("projects"), F.max("created_at").cast("string").alias("newest")
    )


def project_rollup(store: DataFrame, recalls: DataFrame) -> DataFrame:
    """Artifacts per project beside its recalls; projects of either side."""
    s = store.groupBy("project").agg(
        F.count("*").alias("artifacts"),
        F.count_if(F.col("kind") == "session_chunk").alias("chunks"),
        F.count_if(F.col("kind") == "note").alias("notes"),
        F.sum("token_count").alias("tokens"),
    )
    r = recalls.groupBy("project").agg(F.count("*").alias("recalls"))
    return s.join(r, "project", "full_outer").select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("artifacts", "chunks", "notes", "tokens", "recalls")])


def context_saved(store: DataFrame, recalls: DataFrame) -> DataFrame:
    """Recalled against full tokens of each project that was recalled from."""
    full = store.groupBy("project").agg(F.sum("token_count").alias("full_tokens"))
    used = recalls.where("hits_count > 0").groupBy("project").agg(F.sum("tokens_injected").alias("recalled_tokens"))
    return used.join(full, "project").withColumn("saved_tokens", F.greatest(F.lit(0), F.col("full_tokens") - F.col("recalled_tokens")))


def quality_score(returned: Column, used: Column, rejected: Column) -> Column:
    """Laplace-smoothed quality in [0, 1]; impossible counts get the neutral value."""
    raw = (used - rejected + 1).cast("double") / (returned + 2)
    return F.when((used > returned) | (rejected > returned) | (returned < 0), NEUTRAL_QUALITY).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def quality_from_verdicts(verdicts: DataFrame) -> DataFrame:
    """Per artifact: how often returned, judged, used and rejected, and its score on judged returns."""
    counts = verdicts.groupBy("artifact_id").agg(
        F.count("*").alias("returned"),
        F.count_if(F.col("outcome") != "pending").alias("judged"),
        F.count_if(F.col("outcome") == "used").alias("used"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.max("created_at").alias("last_recalled"),
    )
    return counts.withColumn("quality", quality_score(F.col("judged"), F.col("used"), F.col("rejected")))


def quality_leaderboard(quality: DataFrame, limit: int = 50) -> DataFrame:
    return quality.orderBy(F.col("judged").desc(), F.col("quality").desc(), "artifact_id").limit(limit)


def verdict_shares(verdicts: DataFrame) -> DataFrame:
    judged = F.col("outcome") != "pending"
    share = lambda o: _rate(F.count_if(F.col("outcome") == o), F.count_if(judged), 6)
    return verdicts.agg(
        F.count("*").alias("verdicts"), F.count_if(judged).alias("judged"), *[share(o).alias(f"{o}_share") for o in ("used", "unused", "rejected")]
    )


def decay_quality(quality: DataFrame, as_of: str, interval_days: int = 14, factor: float = 0.5, floor: float = 0.03) -> DataFrame:
    """Halve the score for every full interval since the last recall; below the floor an artifact retires."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_recalled"))
    steps = F.greatest(F.lit(0), F.floor(days / interval_days))
    decayed = quality.withColumn("decayed", F.col("quality") * F.pow(F.lit(factor), steps))
    return decayed.select("artifact_id", "quality", F.round("decayed", 12).alias("decayed"), (F.col("decayed") < floor).alias("retired"))


def stale_memories(store: DataFrame, quality: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Artifacts created before the cutoff and not recalled since it, or never."""
    cut = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    q = quality.select(F.col("artifact_id").alias("id"), "last_recalled")
    return store.join(q, "id", "left").where((F.col("last_recalled").isNull() | (F.col("last_recalled") < cut)) & (F.col("created_at") < cut)).select("id", "created_at", "last_recalled")


def repair_counts(quality: DataFrame) -> DataFrame:
    """Use and reject counts that exceed the recalls are zeroed, scores outside [0, 1] computed anew."""
    impossible = (F.col("used") > F.col("returned")) | (F.col("rejected") > F.col("returned"))
    flagged = quality.withColumn("_bad", impossible).withColumn("repaired", F.col("_bad") | (F.col("quality") < 0) | (F.col("quality") > 1))
    fixed = flagged.withColumns({c: F.when(F.col("_bad"), 0).otherwise(F.col(c)) for c in ("used", "rejected")})
    score = quality_score(F.col("returned"), F.col("used"), F.col("rejected"))
    return fixed.withColumn("quality", F.when(F.col("repaired"), score).otherwise(F.col("quality"))).drop("_bad")


def record_recalls(served: DataFrame) -> DataFrame:
    """How often each artifact was served, and when last."""
    return served.groupBy("artifact_id").agg(F.count("*").alias("recall_count"), F.max("created_at").alias("last_recalled"))


def settle(pending: DataFrame, decided: DataFrame) -> DataFrame:
    """Move pending verdicts to what was decided; settled ones never change, so settling twice is harmless."""
    new = decided.select("recall_id", "artifact_id", F.col("outcome").alias("new_outcome")).dropDuplicates(["recall_id", "artifact_id"])
    merged = pending.join(new, ["recall_id", "artifact_id"], "left")
    outcome = F.when(F.col("outcome") == "pending", F.coalesce("new_outcome", "outcome")).otherwise(F.col("outcome"))
    return merged.withColumn("outcome", outcome).drop("new_outcome")


def attribute_unknown(savings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of agent 'unknown' get the one enabled agent that speaks their protocol, if it is only one."""
    sole = candidates.groupBy("protocol").agg(F.count("*").alias("n"), F.first("agent").alias("sole")).where("n = 1").drop("n")
    agent = F.when(F.col("agent") == "unknown", F.coalesce("sole", "agent")).otherwise(F.col("agent"))
    return savings.join(sole, "protocol", "left").withColumn("agent", agent).drop("sole")
