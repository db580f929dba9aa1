"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Equal vectors form one class, which carries its smallest ids: as ties go to smaller ids, no question can reach more
of them. The tree is fitted on a bounded sample of classes and broadcast; every class is filed under the leaf that
it descends to. A question walks the tree with a priority queue of branches by the largest inner product that one of their
members is expected to have, and so visits leaves in the order of their promise. How many leaves are visited is
calibrated: for a sample of questions the true neighbours are found by matrix products over all classes, and visits
are widened until the target share of them lies in the leaves visited.

Neighbouring leaves form bins of about one block of members; a question goes once to every bin with a leaf that it
visits. Members and questions of a bin meet in blocks of bounded size, so a leaf that holds or draws many rows is
many tasks, and no member of a visited leaf is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace, bound_arrow_batches

#: Neighbours of a question, and the step of ids that are questions in ``op12_neighbours``.
NEIGHBOURS, QUESTION_STEP = 20, 20
#: The tree is fitted on so many classes and entries at most, those with the smallest hash of their vector.
SAMPLE_ROWS, SAMPLE_ENTRIES = 65_536, 1 << 23
#: Branches of a node, rounds of k-means, classes that a leaf is meant to hold, and sampled ones that it must.
BRANCHES, ROUNDS, LEAF_ROWS, LEAST_SAMPLED = 16, 8, 64, 8
#: Questions that visits are calibrated with, and the recall that they are widened to.
CALIBRATION, RECALL = 256, 0.95
#: Members and questions of a bin that meet in one group.
MEMBER_BLOCK, QUESTION_BLOCK = 4096, 1024

FOUND = "class_id long, neighbour long, score double"


@dataclass
class Tree:
    """Nodes by number, the root first: centre, reach, children (none for a leaf) and number of the leaf.

    The reach is how far beyond its centre the farthest of a node's rows is expected in any one direction, for
    rows that lie around it normally.
    """

    centres: np.ndarray
    reach: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the child with the nearest centre, level by level."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x))
        while len(moving):
            moving = moving[[len(self.children[n]) > 0 for n in at[moving]]]
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                at[rows] = self.children[node][_nearest(x[rows], self.centres[self.children[node]])]
        return self.leaf[at]

    def visits(self, question: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves best bin first: next is the open branch of the largest expected inner product."""
        queue, found, length = [(0.0, 0)], [], float(np.sqrt(question @ question))
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            if not len(self.children[node]):
                found.append(int(self.leaf[node]))
                continue
            below = self.children[node]
            promise = self.centres[below] @ question + length * self.reach[below]
            for less, child in zip((-promise).tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, (less, child))
        return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _split(x: np.ndarray, branches: int, random: np.random.Generator) -> np.ndarray:
    """Cluster of each row by k-means; clusters may be fewer than ``branches``."""
    centres = x[random.choice(len(x), branches, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=branches)
        order = np.argsort(near, kind="stable")
        held = np.flatnonzero(counts)
        starts = np.cumsum(counts)[held] - counts[held]
        centres = np.add.reduceat(x[order], starts, axis=0) / counts[held][:, None]
        branches = len(held)
    return _nearest(x, centres)


def fit_tree(x: np.ndarray, leaf_rows: float, seed: int = 11) -> Tree:
    """Split the sample until a node has at most ``leaf_rows`` of it or can't be split; leaves are numbered in tree order."""
    random = np.random.default_rng(seed)
    centres, reach, children, leaf, leaves = [x.mean(0)], [0.0], [np.zeros(0, dtype=np.int64)], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        near = np.zeros(len(rows), dtype=np.int64)
        if len(rows) > leaf_rows:
            near = _split(x[rows], min(BRANCHES, max(2, int(np.ceil(len(rows) / leaf_rows)))), random)
        kinds = np.unique(near)
        if len(kinds) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(kinds))
        for k, child in zip(kinds, children[node].tolist(), strict=True):
            part = rows[near == k]
            centres.append(x[part].mean(0))
            reach.append(float(np.sqrt(x[part].var(0).mean() * 2 * np.log(len(part) + 1))))
            children.append(np.zeros(0, dtype=np.int64))
            leaf.append(-1)
            todo.append((child, part))
    return Tree(np.stack(centres), np.array(reach), children, np.array(leaf))


def searchable(vector: Column) -> Column:
    """True for vectors with entries, all finite and not all zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _matrix(vectors: pa.Array) -> np.ndarray:
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _best(products: np.ndarray, asked: np.ndarray, members: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[int, list[int], list[float]]]:
    """Per question its ``k`` best ids, ties to the smaller; products of members out of reach are -inf.

    Scores are summed again entry by entry, so they depend on the two vectors only.
    """
    for row in range(len(asked)):
        least = np.partition(products[row], -k)[-k] if len(members) > k else -np.inf
        if np.isneginf(least):
            near = np.flatnonzero(~np.isneginf(products[row]))
        else:  # a hair below the k-th best, as the order of a sum moves its last digits
            near = np.flatnonzero(products[row] >= least - 1e-9 * max(1.0, abs(least)))
        scores = (members[near] * asked[row]).sum(1).tolist()
        pairs = sorted((-s, i) for s, m in zip(scores, near.tolist(), strict=True) for i in ids[m])[:k]
        yield row, [i for _, i in pairs], [-s for s, _ in pairs]


def _rows(found) -> pa.RecordBatch:
    columns = [], [], []
    for key, ids, scores in found:
        for column, more in zip(columns, ([key] * len(ids), ids, scores), strict=True):
            column += more
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["class_id", "neighbour", "score"])


def _filed(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = tree.value.descend(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    return run


def _scanned(asked, k: int):
    """Best of each calibration question within one batch of all classes, with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, questions = asked.value
        for batch in batches:
            if not len(batch):
                continue
            leaf = batch.column(2).to_pylist()
            products = questions @ _matrix(batch.column(1)).T
            rows = []
            for q in range(len(keys)):
                near = np.argpartition(products[q], -k)[-k:] if products.shape[1] > k else np.arange(products.shape[1])
                rows += [(keys[q], leaf[m], float(products[q, m])) for m in near.tolist()]
            yield pa.RecordBatch.from_pylist([{"class_id": a, "leaf": b, "score": c} for a, b, c in rows], schema=pa.schema([("class_id", pa.int64()), ("leaf", pa.int32()), ("score", pa.float64())]))

    return run


def _walked(sent, visits: int):
    """Every question with the bins that it visits and its leaves in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bins = sent.value
        kind = pa.list_(pa.struct([("bin", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
        for batch in batches:
            found = []
            for question in _matrix(batch.column(1)):
                by_bin: dict[int, list[int]] = {}
                for leaf in tree.visits(question, visits):
                    by_bin.setdefault(int(bins[leaf]), []).append(leaf)
                found.append([{"bin": b, "leaves": leaves} for b, leaves in by_bin.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "visits"])

    return run


def _meeting(k: int):
    """Questions and members of one block of a bin: each leaf's members are scored for the questions that visit it."""

    def run(table: pa.Table) -> pa.Table:
        is_member = table["ids"].is_valid()
        members, asked = table.filter(is_member).sort_by("leaf"), table.filter(pa.compute.invert(is_member))
        if not len(asked) or not len(members):
            return pa.Table.from_batches([_rows([])])
        x, q = (_matrix(t["vector"].combine_chunks()) for t in (members, asked))
        visitors: dict[int, list[int]] = {}
        for row, leaves in enumerate(asked["leaves"].to_pylist()):
            for leaf in leaves:
                visitors.setdefault(leaf, []).append(row)
        leaf, keys, ids = members["leaf"].to_numpy(), asked["class_id"].to_pylist(), members["ids"].to_pylist()
        products = np.full((len(q), len(x)), -np.inf)
        for here in np.unique(leaf):
            low, high = np.searchsorted(leaf, here), np.searchsorted(leaf, here, "right")
            if rows := visitors.get(int(here)):
                products[rows, low:high] = q[rows] @ x[low:high].T
        best = _best(products, q, x, ids, k)
        return pa.Table.from_batches([_rows((keys[row], found, scores) for row, found, scores in best)])

    return run


@dataclass
class Index:
    """Classes filed by leaf (class_id, vector, ids, leaf), the tree, and the leaf visits that calibration settled."""

    classes: DataFrame
    tree: Tree
    visits: int
    recall: float


def build_index(rows: DataFrame, work: Workspace, key: str, vector: str, k: int = NEIGHBOURS, recall: float = RECALL) -> Index | None:
    """Index all ``rows`` (none without a usable vector gives None): classes of equal vectors, tree, calibrated visits.

    ``rows`` hold unique pairs of a key that is not null and a usable vector of one length.
    """
    spark = rows.sparkSession
    bound_arrow_batches(spark)
    near = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).withColumn("near", near).where(F.col("near") <= k + 1)
    classes = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    classes = work.table("classes", classes.select(F.get("ids", F.lit(0)).alias("class_id"), "vector", "ids"))
    n = classes.count()
    if not n:
        return None
    d = len(classes.first()["vector"])
    size = min(SAMPLE_ROWS, max(1024, SAMPLE_ENTRIES // d))
    sample = classes.select("class_id", "vector").orderBy(F.xxhash64("vector"), "class_id").limit(size).toArrow()
    x = _matrix(sample["vector"].combine_chunks())
    tree = fit_tree(x, max(LEAST_SAMPLED, LEAF_ROWS * len(x) / n))
    sent = _send(spark, tree)
    filed = work.table("filed", classes.mapInArrow(_filed(sent), f"{_ddl(classes)}, leaf int"))
    work.drop("classes")

    keys = sample["class_id"].to_pylist()[:CALIBRATION]
    asked = _send(spark, (keys, x[: len(keys)]))
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), "leaf")
    true = filed.select("class_id", "vector", "leaf").mapInArrow(_scanned(asked, k), "class_id long, leaf int, score double")
    true = true.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("class_id", "leaf").collect()  # k per question
    order = {c: {leaf: p for p, leaf in enumerate(tree.visits(q, tree.leaves))} for c, q in zip(keys, x, strict=False)}
    depths = np.sort([order[r["class_id"]][r["leaf"]] for r in true])
    visits = 1
    while np.searchsorted(depths, visits) < recall * len(depths):  # widen until the share is reached
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return Index(filed, tree, visits, float(np.searchsorted(depths, visits) / len(depths)))


def _send(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def bins_of(sizes: np.ndarray, most: int = MEMBER_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each leaf, rows of each bin): runs of leaves of ``most`` rows together, or one larger leaf."""
    bins, rows = np.zeros(len(sizes), dtype=np.int64), [0]
    for leaf, size in enumerate(sizes.tolist()):
        if rows[-1] and rows[-1] + size > most:
            rows.append(0)
        bins[leaf] = len(rows) - 1
        rows[-1] += size
    return bins, np.array(rows)


def search(index: Index, asked: DataFrame, work: Workspace, k: int = NEIGHBOURS) -> DataFrame:
    """(class_id, vector) of distinct questions -> (class_id, neighbour, score): their ``k`` best ids in the leaves visited.

    Counts of a leaf and of a bin, of which the bounded tree has few, decide into how many blocks the members and
    the questions of a bin go; each block of the one side meets each of the other once.
    """
    spark = asked.sparkSession
    counts = {r["leaf"]: r["count"] for r in index.classes.groupBy("leaf").count().collect()}
    bins, sizes = bins_of(np.array([counts.get(leaf, 0) for leaf in range(index.tree.leaves)]))
    kinds = f"{_ddl(asked)}, visits array<struct<bin: int, leaves: array<int>>>"
    # few bytes, but many steps a question: an explicit number keeps adaptive execution from walking them all in one task
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "class_id")
    walked = work.table("walked", asked.mapInArrow(_walked(_send(spark, (index.tree, bins)), index.visits), kinds))
    drawn = {r["bin"]: r["count"] for r in walked.select(F.explode("visits.bin").alias("bin")).groupBy("bin").count().collect()}

    def blocks(counted: list[int], most: int) -> Column:
        return F.get(F.lit([max(1, -(-c // most)) for c in counted]), F.col("bin"))

    of_members, of_questions = blocks(sizes.tolist(), MEMBER_BLOCK), blocks([drawn.get(b, 0) for b in range(len(sizes))], QUESTION_BLOCK)
    block = F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)).cast("int")

    def repeated(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    members = index.classes.withColumn("bin", F.get(F.lit(bins.tolist()), F.col("leaf")).cast("int"))
    members = members.select("class_id", "vector", "ids", "leaf", F.lit(None).cast("array<int>").alias("leaves"), "bin", (block % of_members).alias("m"), repeated(of_questions).alias("q"))
    questions = walked.select("class_id", "vector", F.explode("visits").alias("v")).select("class_id", "vector", "v.bin", "v.leaves")
    questions = questions.select(
        "class_id", "vector", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("leaf"), "leaves", "bin", repeated(of_members).alias("m"), (block % of_questions).alias("q")
    )
    found = members.unionByName(questions).groupBy("bin", "m", "q").applyInArrow(_meeting(k), FOUND)
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest_neighbours(rows: DataFrame, work: Workspace, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest of all other rows for each row that ``asked`` marks.

    Nearest is the largest inner product in double precision, ties go to the smaller key. Rows with a null key, or
    whose vector is null, empty, all zeros or holds null or non-finite entries take no part, nor do vectors of
    another length than most have. A row that repeats key and vector counts once; a key with several vectors asks
    with the smallest of them and never finds itself. Equal questions are searched once.
    """
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & searchable(F.col("v")))
    lengths = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    held = held.where(F.size("v") == (lengths[0]["d"] if lengths else 0)).distinct()
    index = build_index(held, work, "id", "v", k, recall)
    if index is None:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    ids = rows.where(asked & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    questions = held.join(ids, "id", "left_semi").groupBy("id").agg(F.min("v").alias("vector"))
    named = work.table("questions", questions.join(index.classes.select("vector", "class_id"), "vector").select("id", "class_id", "vector"))
    # one more than asked for, as a question's own row may be among them
    found = search(index, named.select("class_id", "vector").distinct(), work, k + 1)
    lists = work.table("found", found.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "neighbour"))).alias("found")))
    work.drop("walked", "filed")
    own = F.filter("found", lambda f: f["neighbour"] != F.col("query_id"))
    answered = named.select(F.col("id").alias("query_id"), "class_id").join(lists, "class_id")
    return answered.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "near")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("near.neighbour").alias(key), (-F.col("near.less")).alias("score")
    )


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(rows, Workspace(spark, "neighbours"), F.col("vec_id") % QUESTION_STEP == 0)
