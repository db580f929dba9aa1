"""Shared working tables and joins that stay even under hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table of at most this many rows may be broadcast; its size is counted first.
MAX_BROADCAST_ROWS = 20_000

#: A key with more rows than this is split over several partitions by ``spread_lookup``.
ROWS_PER_PART = 1_000

#: Setting under which Spark deletes the shuffle files of a query that has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of an Arrow batch; with long texts, Spark's 10,000 rows take a hundred megabytes in a task.
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Small Arrow batches for the session, whose executors then need less memory beside the heap; what the user has set stays."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) == 10000:
        spark.conf.set(ARROW_ROWS, str(rows))
        spark.conf.set(ARROW_BYTES, str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Without it, one of this machine serves a local master, whose threads all see it; on a cluster that is an error, as
    every executor would write files of its own.
    """
    for read in (
        lambda: spark.conf.get("spark.checkpoint.dir", None),
        lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir", None),
    ):
        found = read()
        if found:
            return found.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/tracemill-local"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """``SHUFFLE_CLEANUP`` for what runs inside; what the session had before comes back after."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Workspace:
    """Parquet tables under the shared folder that cut lineage between the steps of one job.

    A written table survives lost executors, as no step before it has to run again. The shuffle files of a step
    go once its table is written, so a job's disk use is that of its largest step, not of all of them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracemill-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no result still reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(root):
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)


def salted_lookup(
    rows: DataFrame, table: DataFrame, key: str, spread: Column, salts: int = 32, how: str = "left"
) -> DataFrame:
    """Join ``rows`` with a table of one row per key where a key may hold a third of all rows.

    Every row draws a salt from ``spread``; the table is repeated once per salt, so a hot key's rows
    meet in ``salts`` partitions instead of one.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def checked_lookup(
    rows: DataFrame, table: DataFrame, key: str, spread: Column, max_rows: int = MAX_BROADCAST_ROWS, how: str = "left"
) -> DataFrame:
    """Broadcast ``table`` if its counted size is within ``max_rows``, else a salted join.

    ``table`` should be written or otherwise cheap to read twice.
    """
    if table.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(table), key, how)
    return salted_lookup(rows, table, key, spread, how=how)


def spread_lookup(
    rows: DataFrame, table: DataFrame, key: str, spread: Column, per_part: int = ROWS_PER_PART, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` with a table of one row per key, splitting only keys with more than ``per_part`` rows.

    Keys are counted first (the counts combine before their shuffle). The hot ones, at most one per ``per_part``
    rows, are counted too: up to ``MAX_BROADCAST_ROWS`` of them are broadcast, more are joined. Only their rows draw
    a salt and only their table rows are repeated. ``rows`` should be written or otherwise cheap to read twice.
    """
    parts, salt = distinct_name(rows, "_parts"), distinct_name(rows, "_salt")
    hot = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias(parts))
        .where(F.col(parts) > per_part)
        .select(key, F.ceil(F.col(parts) / per_part).cast("int").alias(parts))
    )
    hot = F.broadcast(hot) if hot.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else hot
    n = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(spread), n).cast("int")).drop(parts)
    right = table.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(parts)
    return left.join(right, [key, salt], how).drop(salt)


def distinct_name(df: DataFrame, base: str) -> str:
    """A column name that does not clash with those of ``df``."""
    name = base
    while name in df.columns:
        name = f"_{name}"
    return name


class Shipped:
    """A broadcast object of this package's own classes, which executors need not be able to import."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value

    def release(self) -> None:
        """Forget the loaded object and the bytes it came from; ``value`` loads it again."""
        self._value = None
        self._sent.__dict__.pop("_value", None)
