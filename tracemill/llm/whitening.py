"""Embedding whitening by shifted CholeskyQR: R factors of distributed Gram passes, then an SVD of their product.

A Gram matrix squares the condition of what it is made of, so the components of small eigenvalues drown in it. Here
the centred rows A are made orthogonal step by step: a pass over the rows sums the Gram matrix of A solved through
the R factors found so far, and its Cholesky factor (of the matrix shifted by a multiple of its rounding error while
it is not safely positive) is the next R. Then A = Q R with R the product of the factors, and R's singular values
and right vectors are A's. Only matrices of the vectors' dimension reach the driver, whatever the number of rows.

Vectors are arrays of doubles or of longs. Sums of longs are whole numbers of any size, so that means and deviations
are exact, and rows are centred by whole numbers first: an offset far larger than the spread costs no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.workspace import Workspace, bound_arrow_batches, distinct_name

#: Passes that make rows orthogonal, at most; three are enough unless columns depend on each other.
MAX_PASSES = 6
#: Largest entry of a Gram matrix less the identity that counts as orthogonal.
ORTHOGONAL = 1e-12
#: Singular values below this share of the largest are rounding noise and give no component.
LEAST_SINGULAR = 1e-12
#: Fixed values of ``op11_whitening``: entries are 64ths above an offset; components returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this size have no long of 64ths and count as not finite.
MAX_ENTRY = float(1 << 54)
#: Rows that a task solves at a time.
BLOCK_ROWS = 4096


@dataclass
class Whitening:
    """A fitted transform: what to subtract, the R factors' singular values and vectors, and how well it whitens."""

    n: int
    sums: list
    pivot: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0
    factors: list[np.ndarray] = field(default_factory=list)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot).astype(np.float64) - self.rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def usable(vector: Column) -> Column:
    """True for vectors with entries, all of them finite and small enough for a long of 64ths."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < MAX_ENTRY))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole, F.lit(False))


def fixed_point(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Entries as whole numbers: floor(scale * entry) + offset."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the larger of two; 0 without vectors."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def blocks(vectors: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Rows of a list array as (rows, d) arrays of bounded size."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for low in range(0, len(values), BLOCK_ROWS):
        yield values[low : low + BLOCK_ROWS]


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A R^-1 for an upper triangular R, column by column; a column without a pivot is all zeros."""
    q = np.zeros_like(a)
    for j in range(a.shape[1]):
        if r[j, j] > 0:
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def shifted_cholesky(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R'R = gram, shifted by its possible rounding error if it may not be positive."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    shift = min(shift, 1e-4 * np.trace(gram))
    if np.linalg.eigvalsh(gram)[0] > shift:
        return np.linalg.cholesky(gram).T
    return np.linalg.cholesky(gram + max(shift, np.finfo(float).tiny) * np.eye(d)).T


def _sum_of(make: Callable[[Iterator[np.ndarray]], np.ndarray], d: int):
    """A task's matrix as rows of (place, values), to be added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(x for batch in batches for x in blocks(batch.column(0), d))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], names=["place", "values"])

    return run


def _added(rows: DataFrame, make, d: int, kind: str, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks: cells combine before their shuffle, and one matrix of ``shape`` is collected."""
    parts = rows.mapInArrow(_sum_of(make, d), f"place int, values array<{kind}>")
    cells = parts.select("place", F.posexplode("values").alias("at", "value")).groupBy("place", "at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape, dtype=np.int64 if kind == "long" else np.float64)
    out[cells["place"].to_numpy(), cells["at"].to_numpy()] = cells["value"].to_numpy()
    return out


def _sums(parts: Iterator[np.ndarray]) -> np.ndarray | None:
    """Rows and sums of each entry; longs as their upper and lower 32 bits, so that no sum overflows."""
    total = None
    for x in parts:
        if x.dtype == np.int64:
            here = np.stack([np.full(x.shape[1], len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        else:
            here = np.stack([np.full(x.shape[1], float(len(x))), x.sum(0)])
        total = here if total is None else total + here
    return total


def _gram(model: Whitening, finish):
    def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            q = finish(model, x)
            total = q.T @ q if total is None else total + q.T @ q
        return total

    return run


def _solved(model: Whitening, x: np.ndarray) -> np.ndarray:
    q = model.centred(x)
    for r in model.factors:
        q = solve_right(q, r)
    return q


def fit_whitening(rows: DataFrame, vector: str, most: int | None = None) -> Whitening:
    """Fit on all ``rows``, whose ``vector`` holds arrays of one length without nulls (longs, or finite doubles).

    ``rows`` are read once per pass and should be a written table. Components are numbered by falling eigenvalue of
    the covariance (divisor n); those of eigenvalues that are zero up to rounding are left out, so no rows, one row
    or equal rows give no component. ``most`` bounds the components kept.
    """
    bound_arrow_batches(rows.sparkSession)
    rows = rows.select(F.col(vector).alias("x"))
    first = rows.limit(1).collect()
    d = len(first[0]["x"]) if first else 0
    if not d:
        return Whitening(0, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    kind = rows.schema["x"].dataType.elementType.simpleString()
    exact = kind == "bigint"
    found = _added(rows, _sums, d, "long" if exact else "double", (3 if exact else 2, d))
    n = int(found[0, 0])
    if exact:
        sums = [(int(high) << 32) + int(low) for high, low in zip(found[1], found[2], strict=True)]
        pivot = [(2 * s + n) // (2 * n) for s in sums]  # nearest whole number to the mean
        rest = np.array([(s - n * p) / n for s, p in zip(sums, pivot, strict=True)])
        model = Whitening(n, sums, np.array(pivot, dtype=np.int64), rest, np.zeros((0, d)), np.zeros(0), 0.0)
    else:
        model = Whitening(n, found[1].tolist(), found[1] / n, np.zeros(d), np.zeros((0, d)), np.zeros(0), 0.0)

    gram, r = None, np.eye(d)
    for model.passes in range(1, MAX_PASSES + 1):
        gram = _added(rows, _gram(model, _solved), d, "double", (d, d))
        gram = (gram + gram.T) / 2
        if not model.factors:
            model.trace = float(np.trace(gram)) / n
            if not model.trace:
                return model
        elif np.abs(gram - np.eye(d)).max() <= ORTHOGONAL * d or model.passes == MAX_PASSES:
            break
        factor = shifted_cholesky(gram, n)
        model.factors.append(factor)
        r = factor @ r
    # what is left of the last Gram matrix belongs to R too: its root, which columns that depend on others leave singular
    values, vectors = np.linalg.eigh(gram)
    r = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T @ r
    _, singular, right = np.linalg.svd(r)
    kept = np.flatnonzero(singular > LEAST_SINGULAR * singular[0])[:most]
    model.components, model.eigenvalues = right[kept], singular[kept] ** 2 / n
    model.trace = float((singular**2).sum()) / n
    k = len(kept)
    covariance = _added(rows, _gram(model, Whitening.whiten), d, "double", (k, k)) / n
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sum over the entries of (n * x - sum)^2, exactly; None where it is beyond a long."""
    near = x - model.pivot
    rest = np.array([s - model.n * int(p) for s, p in zip(model.sums, model.pivot, strict=True)], dtype=object)
    bound = (float(np.abs(near).max(initial=0)) + 1) * model.n
    if bound * bound * x.shape[1] < 2.0**62:
        scaled = near * model.n - rest.astype(np.int64)
        return (scaled * scaled).sum(1).tolist()
    scaled = near.astype(object) * model.n - rest
    return [v if v < 1 << 63 else None for v in (scaled * scaled).sum(1)]


def _whitened(model: Whitening, place: int, exact: bool, names: list[str]):
    d, k = len(model.pivot), len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, apart = [], []
            for x in blocks(batch.column(place), d):
                values.append(model.whiten(x))
                apart += deviations(model, x) if exact else [None] * len(x)
            flat = np.concatenate(values).ravel() if values else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * k, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(apart, pa.int64())], names=[*batch.schema.names, *names])

    return run


def whiten(rows: DataFrame, model: Whitening, vector: str, whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """``rows`` with an array of whitened values, one per component, and for longs the exact deviation from the sums.

    Vectors must be like those fitted on; other columns pass through, and columns of the two names are replaced.
    """
    kept = rows.drop(*{whitened, deviation} - {vector})
    exact = kept.schema[vector].dataType.elementType == T.LongType()
    if not model.n:
        return kept.limit(0).withColumns({whitened: F.array().cast("array<double>"), deviation: F.lit(None).cast("long")})
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType, True) for f in kept.schema], T.StructField(whitened, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())]
    )
    return kept.mapInArrow(_whitened(model, kept.columns.index(vector), exact, [whitened, deviation]), schema)


def whiten_embeddings(rows: DataFrame, work: Workspace, vector: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """(usable ``rows`` with array ``whitened`` and ``deviation``, the model), fitted on distinct fixed-point vectors.

    Rows with a null or empty vector, one with null or non-finite entries, or of another length than most vectors
    have are left out; rows that repeat a vector are all answered but fitted once. Columns of the caller stay.
    Equal vectors combine before their shuffle, so a vector that a third of all rows share is one row a task.
    """
    x = distinct_name(rows, "_x")
    held = rows.where(usable(F.col(vector)))
    d = common_length(held, vector)
    held = held.where(F.size(vector) == d).withColumn(x, fixed_point(F.col(vector)))
    model = fit_whitening(work.table("fit", held.select(x).distinct()), x, most)
    work.drop("fit")
    return whiten(held, model, x).drop(x), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, model = whiten_embeddings(rows, Workspace(spark, "whitening"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
