"""Mixing sources to target weights by repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace, checked_lookup, distinct_name
from tracemill.llm.text import word_count

#: The weights that sources get in order, repeating, and the largest repetition rate.
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Seed of the Bernoulli copies.
SEED = 1
_TWO_53 = float(1 << 53)


def _draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.lit(seed), key), 11).cast("double") / F.lit(_TWO_53)


def _ranked(sizes: DataFrame, work: Workspace) -> DataFrame:
    """(source, source_size, rank from 0 by code point, null last), ranked within ranges of sources.

    Ranges are numbered in order, so a rank is the rows of the ranges before plus the place within the range;
    only the rows per range, one for each shuffle partition, are added up in one place.
    """
    by_source = F.col("source").asc_nulls_last()
    dealt = work.table("ranges", sizes.repartitionByRange(by_source).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(by_source)) - 1
    return dealt.join(F.broadcast(starts), "range").select("source", "source_size", (F.col("start") + within).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Of (source, source_size), one row per source: its target by weight, at most ``max_rate`` times its size.

    Targets are ``min(max_rate * size, level * weight)``. The level starts at all sizes over all weights; what
    is above a cap is shared out again over the sources below theirs, which raises the level, until no further
    source is above its cap. A round is one aggregate over the sources, of which the driver reads one row.
    """
    work = Workspace(sizes.sparkSession, "targets")
    ranked = _ranked(sizes, work)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = work.table("weighed", ranked.select("source", "source_size", weight.alias("weight"), (max_rate * F.col("source_size")).alias("cap")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        found = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if found[0] == capped or not found[2]:
            break
        capped, level = found[0], float(total - (found[1] or 0)) / found[2]
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_rate: int = MAX_RATE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` to every row.

    Sizes are word counts; sources are ordered by code point, null last, and null is a source of its own. A
    source's rate is its target over its size; a row is copied ``floor(rate)`` times, and once more if the hash of
    its key under the seed falls below the fraction, whatever the other rows are, so reruns agree. A source's sum
    is right on the mean and strays from it as a sum of independent draws does: by long rows more than by many.
    Rows that repeat a key are drawn alike. Null texts and null keys count as any other (size 0; one draw for all
    null keys). An empty table gives an empty result; columns of the four names are replaced, all others of
    ``docs`` stay.
    """
    work = Workspace(docs.sparkSession, "mixing")
    own = F.col(source).cast("string")
    named = F.struct(own.isNull().alias("none"), F.coalesce(own, F.lit("")).alias("name"))
    sizes = docs.select(own.alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key_of = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))

    rows = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    by, rated = (distinct_name(rows, c) for c in ("_by", "_rate"))
    rates = source_targets(work.table("sizes", sizes), weights, max_rate).select(
        key_of.alias(by), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), rate.alias(rated)
    )
    rows = rows.withColumns({by: named, "mix_size": word_count(F.col(text))})
    found = checked_lookup(rows, work.table("by-source", rates), by, F.col(key))
    whole = F.floor(rated).cast("int")
    extra = _draw(F.col(key), seed) < F.col(rated) - whole
    return found.withColumn("mix_copies", whole + extra.cast("int")).drop(by, rated)


def emit_copies(mixed: DataFrame, copy: str = "copy_no") -> DataFrame:
    """One row per copy taken, numbered from 1; rows without a copy go."""
    copies = F.sequence(F.lit(1), F.col("mix_copies"))
    return mixed.where("mix_copies > 0").withColumn(copy, F.explode(copies))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )
