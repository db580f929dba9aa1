"""Streams of events and records: counts in windows with late rows, sessions as state, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracemill.functions.workspace import Workspace, distinct_name

#: Setting that names the state store; state of several kinds per key needs RocksDB.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, work: Workspace, name: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now, handing every batch to ``each``; a restart goes on where it stopped."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", work.path(f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def window_counts(events: DataFrame, window: str, late: str) -> DataFrame:
    """Counts and sums of (ts, kind, value) per window and kind; rows later than ``late`` behind the newest are dropped."""
    by = [F.window("ts", window).alias("w"), "kind"]
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    return grouped.groupBy(*by).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "events", "total")


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """Latest version of every key, from an append-only table of versions."""
    best = F.max_by(F.struct(*[F.col(c) for c in versions.columns if c != key]), F.col(order)).alias("v")
    return versions.groupBy(key).agg(best).select(key, "v.*")


def upsert_stream(stream: DataFrame, work: Workspace, name: str, key: str, order: str) -> DataFrame:
    """Append every batch of a stream as versions and give the latest of each key."""

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        batch.write.mode("overwrite").parquet(work.path(f"{name}/batch={number}"))

    run_available(stream, work, name, "append", append)
    return latest(stream.sparkSession.read.schema(stream.schema).parquet(work.path(f"{name}/batch=*")), key, order)


def sessions_by_gap(events: DataFrame, gap_seconds: float, late: str) -> DataFrame:
    """(session_id, first_at, last_at, events): runs of (session_id, ts) whose rows lie no more than the gap apart.

    Rows may come in any order, up to ``late`` behind the newest; a run is told once nothing can join it any more,
    and its state goes with it, so state holds open runs only. Rows later than that are dropped.
    """
    gap = f"{round(gap_seconds * 1_000_000) + 1} microseconds"  # a row exactly a gap later still belongs
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("events"))
    return found.select("session_id", "first_at", "last_at", "events")


CONTEXT = "session_id long, id string, enriched string, fresh array<string>, known long"
_NAMES = ["session_id", "id", "enriched", "fresh", "known"]
_PENDING = "ts timestamp, id string, query string, sparse boolean, hits array<string>"


class SessionContext(StatefulProcessor):
    """What a session asked before and was served before, kept per session in the order of event time.

    Rows wait until the watermark has passed them, so a batch that comes late changes nothing but when they are
    answered. ``idle_ms`` after a session's last row its state is dropped.
    """

    def __init__(self, keep: int, use: int, idle_ms: int):
        self.keep, self.use, self.idle_ms = keep, use, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.history = handle.getListState("history", "query string")
        self.served = handle.getMapState("served", "id string", "at long")
        self.last = handle.getValueState("last", "at long")

    @staticmethod
    def _ms(ts) -> int:
        return -int(-pd.Timestamp(ts).value // 1_000_000)  # the next whole millisecond

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for r in frame.itertuples(index=False):
                self.pending.appendValue((r.ts, r.id, r.query, bool(r.sparse), list(r.hits) if r.hits is not None else []))
                self.handle.registerTimer(self._ms(r.ts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, due, wait = expiredTimerInfo.getExpiryTimeInMs(), [], []
        for r in self.pending.get() if self.pending.exists() else ():
            (due if self._ms(r[0]) <= now else wait).append(tuple(r))
        if not due:
            if not wait and self.last.exists() and self.last.get()[0] + self.idle_ms <= now:
                for state in (self.pending, self.history, self.served, self.last):
                    state.clear()
            return iter(())
        history, out = [h[0] for h in self.history.get()] if self.history.exists() else [], []
        for ts, own, query, sparse, hits in sorted(due, key=lambda r: (r[0], r[1])):
            fresh = [h for h in hits if not self.served.containsKey((h,))]
            out.append((key[0], own, " | ".join([*history[-self.use :], query]) if sparse else query, fresh, len(hits) - len(fresh)))
            for h in fresh:
                self.served.updateValue((h,), (self._ms(ts),))
            history = [*history, query][-self.keep :]
        self.history.put([(q,) for q in history])
        self.pending.clear()
        if wait:
            self.pending.put(wait)
        self.last.update((now,))
        self.handle.registerTimer(now + self.idle_ms)
        return iter((pd.DataFrame(out, columns=_NAMES),))


def session_context(asked: DataFrame, late: str, keep: int = 5, use: int = 2, idle: int = 30 * 86400) -> DataFrame:
    """Streaming context of questions (session_id, ts, id, query, sparse, hits): one row each once ``late`` has passed.

    enriched: a sparse question behind the session's last ``use`` ones of the ``keep`` remembered; fresh: the hits
    that the session was not served before; known: how many it was. Questions of no session are left out. State is kept by RocksDB, which the session must
    name as its state store; sessions are forgotten after ``idle`` seconds of event time.
    """
    rows = asked.where("session_id IS NOT NULL").withWatermark("ts", late).groupBy("session_id")  # a null key would turn whole ones of its batch into floats
    return rows.transformWithStateInPandas(SessionContext(keep, use, idle * 1000), CONTEXT, "Append", "EventTime")


def session_context_batch(asked: DataFrame, use: int = 2) -> DataFrame:
    """The same of a table: questions before by a window, first servings by an aggregate."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    before = [F.lag("query", k).over(w) for k in range(use, 0, -1)]
    place = F.struct("ts", "id")
    served = asked.select("session_id", place.alias("place"), F.explode("hits").alias("hit")).groupBy("session_id", "hit").agg(F.min("place").alias("first"))
    new = served.groupBy("session_id", F.col("first.id").alias("id")).agg(F.sort_array(F.collect_list("hit")).alias("fresh"))
    rows = asked.withColumn("enriched", F.when(F.col("sparse"), F.concat_ws(" | ", *before, "query")).otherwise(F.col("query")))
    return rows.join(new, ["session_id", "id"], "left").select(
        "session_id", "id", "enriched", F.coalesce("fresh", F.array().cast("array<string>")).alias("fresh"), (F.size("hits") - F.size(F.coalesce("fresh", F.array().cast("array<string>")))).cast("long").alias("known")
    )


def stream_of(spark: SparkSession, frame: DataFrame, work: Workspace, name: str, files: int = 4, by: Column | None = None, at_once: int = 2) -> DataFrame:
    """A table written as files and read back as a stream, ``at_once`` files a batch.

    With ``by``, files hold ranges of it and are read in its order, oldest first.
    """
    if by is None:
        frame.repartition(files).write.mode("overwrite").parquet(work.path(name))
    else:
        order = distinct_name(frame, "_order")
        dealt = work.table(f"{name}-dealt", frame.withColumn(order, by).repartitionByRange(files, order).withColumn("_part", F.spark_partition_id()))
        for part in range(files):  # one after the other, as a source reads files by their time
            dealt.where(F.col("_part") == part).drop(order, "_part").coalesce(1).write.mode("append").parquet(work.path(name))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", at_once).parquet(work.path(name))


def run_appended(stream: DataFrame, work: Workspace, name: str) -> DataFrame:
    """All that a stream of append mode tells over what is there now; a batch that runs again replaces what it wrote."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(work.path(f"{name}/batch={number}"))

    run_available(stream, work, name, "append", keep)
    return stream.sparkSession.read.schema(stream.schema).parquet(work.path(f"{name}/batch=*"))


@contextmanager
def rocks_state(spark: SparkSession):
    """RocksDB as state store for the streams that start inside; what the session had before comes back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
