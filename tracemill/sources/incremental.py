"""Ingest in cycles: only what is new or changed is read, changed sessions replace their rows, broken lines are kept apart.

A unit is a session: its ``session=`` folder, or its file. Progress is a table of (unit, modified), written last in
every cycle; a cycle that dies before has left no trace that counts and is done again. Broken lines do not hold a
unit up: they go to a table of dead letters, and are tried again only when the unit changes. Of bundles, a cycle reads
those that none before has read, and in them the sessions that were collected since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources import transcripts as T

PROGRESS = "unit string, modified timestamp, session_id string, project string, lines long, dead long, cycle int"
DEAD = "unit string, modified timestamp, ord int, line string, cycle int"
BUNDLES = "file string, modified timestamp, cycle int"


def unit_of(file: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file, r"^(.*/session=[^/]+)/", 1), F.lit("")), file)


def _cycles(spark: SparkSession, home: str, name: str, schema: str) -> DataFrame:
    """All cycles of a table, or none where it was never written."""
    try:
        return spark.read.schema(schema).option("basePath", f"{home}/{name}").parquet(f"{home}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def progress(spark: SparkSession, home: str) -> DataFrame:
    """The last settled version of every unit."""
    rows = _cycles(spark, home, "progress", PROGRESS)
    return rows.groupBy("unit").agg(F.max_by(F.struct("modified", "session_id", "project", "lines", "dead", "cycle"), "cycle").alias("v")).select("unit", "v.*")


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(file, modified) of the files under ``path``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified")).where(F.col("file").rlike(ending))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, unit, modified) of the files under ``path``; a unit is as new as its newest file. Contents are not read."""
    files = _files(spark, path, r"\.(jsonl|txt)$").withColumnRenamed("modified", "at").withColumn("unit", unit_of(F.col("file")))
    newest = files.groupBy("unit").agg(F.max("at").alias("modified"))
    return files.join(newest, "unit").select("file", "unit", "modified")


def ingest_cycle(spark: SparkSession, path: str, home: str, parse: Callable[[DataFrame], DataFrame] = T.parse_transcripts, bundled: bool = False) -> int:
    """Read what changed under ``path`` since the last cycle into ``home``; how many units that were.

    The driver learns the names of the changed files, as it does of any files that Spark reads, and nothing of what
    they hold; of bundles, there are as many as tasks wrote, whatever the number of sessions.
    """
    known = progress(spark, home).select("unit", F.col("modified").alias("known"), F.col("cycle").alias("last"))
    number = 1 + (known.agg(F.max("last")).first()[0] or 0)
    newer = F.col("known").isNull() | (F.col("modified") > F.col("known"))
    if bundled:
        changed = _files(spark, path, r"\.json$").join(_cycles(spark, home, "bundles", BUNDLES), ["file", "modified"], "left_anti")
    else:
        changed = listed(spark, path).join(known, "unit", "left").where(newer).select("file", "unit", "modified")
    files = [r["file"] for r in changed.select("file").collect()]
    if not files:
        return 0
    lines = (T.scan_bundles if bundled else T.scan)(spark, files).withColumn("unit", unit_of(F.col("file")))
    if bundled:
        lines = lines.join(known.select("unit", "known"), "unit", "left").where(newer).drop("known")
    at = lines.groupBy("unit").agg(F.max("modified").alias("version"))
    lines = lines.join(at, "unit").withColumn("broken", F.try_parse_json("line").isNull())
    lines.write.mode("overwrite").parquet(f"{home}/lines/cycle={number}")
    lines = spark.read.schema(lines.schema).parquet(f"{home}/lines/cycle={number}")
    owners = lines.groupBy("session_id", "project").agg(F.max("unit").alias("unit"), F.max("version").alias("modified"))
    # the parser never sees a broken line, whatever the order in which filters run
    whole = lines.where("NOT broken").withColumn("line", F.when(~F.col("broken"), F.col("line")))
    rows = parse(whole.drop("unit", "version", "broken")).join(owners, ["session_id", "project"])
    rows.write.mode("overwrite").parquet(f"{home}/rows/cycle={number}")
    dead = lines.where("broken").select("unit", F.col("version").alias("modified"), "ord", "line")
    dead.write.mode("overwrite").parquet(f"{home}/dead/cycle={number}")
    counts = lines.groupBy("unit").agg(
        F.max("version").alias("version"), F.first("session_id").alias("session_id"), F.first("project").alias("project"), F.count("*").alias("lines"), F.count_if("broken").alias("dead")
    )
    # units whose lines are all blank or broken are settled too, or they would come again in every cycle
    settled = counts.withColumn("modified", F.col("version")) if bundled else changed.groupBy("unit").agg(F.max("modified").alias("modified")).join(counts, "unit", "left")
    settled = settled.select("unit", "modified", "session_id", "project", F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), F.coalesce("dead", F.lit(0)).cast("long").alias("dead"))
    settled.write.mode("overwrite").parquet(f"{home}/progress/cycle={number}")
    if bundled:  # after the progress: a cycle that dies between the two reads them again and finds nothing newer in them
        changed.write.mode("overwrite").parquet(f"{home}/bundles/cycle={number}")
    return spark.read.parquet(f"{home}/progress/cycle={number}").count()


def _of_last(spark: SparkSession, home: str, rows: DataFrame) -> DataFrame:
    """Rows of the cycle that settled their unit last."""
    last = progress(spark, home).select("unit", F.col("cycle").alias("_last"))
    return rows.join(last, "unit").where(F.col("cycle") == F.col("_last")).drop("_last", "cycle")


def ingested(spark: SparkSession, home: str, schema: str) -> DataFrame:
    """What all cycles together hold: every unit's rows as of its last change."""
    return _of_last(spark, home, _cycles(spark, home, "rows", f"{schema}, unit string, modified timestamp, cycle int")).drop("unit", "modified")


def dead_letters(spark: SparkSession, home: str) -> DataFrame:
    """Lines that could not be read, of units as they are now."""
    return _of_last(spark, home, _cycles(spark, home, "dead", DEAD))
