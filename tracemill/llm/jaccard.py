"""N-gram Jaccard join by prefix trees.

1. *Order.* All distinct shingles of every document count into a sketch of fixed size; a shingle's key is its
   frequency class (from the sketch, so noisy, but the same everywhere) and its hash. Any one order over all
   documents keeps the join exact; a good one puts frequent shingles where they cost little.
2. *Prefixes.* Two sets that are similar enough share one of their rarest shingles (the first
   ``n - ceil(t n) + 1``). Only these are shuffled, keyed by shingle, for the classes of equal sets. Shingles
   of one class alone, nearly all, end here, and so do members with none of a fitting size beside them.
   Shingles with the same members then count once.
3. *Leaders.* In each of a few rounds a class is held against one leader, a class of another component that
   it shares a shingle with: the largest component leads, by a class drawn anew. What proves similar merges
   into components, so a group of n near copies costs about n checks.
4. *Rest.* Shingles whose members still lie in different components pair these members (size and position
   permitting), and the pairs are verified too. So no link between different texts is lost.

In both a pair must first pass a bound on its difference: each class has a parity map, one bit per 2^k values of
the hash telling whether an odd number of its shingles falls there. Maps of two sets differ in at most as many
bits as the sets differ in shingles, so a pair whose maps differ too much cannot be similar. Classes and leaders
are paired by ids alone and meet their maps at the one of their shingles where most pairs meet. Members of the
shingles that stay open are cut into blocks with their maps, any two of a shingle's blocks meet in a task, and only
pairs that pass every bound are made.

Verification stores the candidates of one class in a prefix tree of sets ordered from the most frequent
shingle on, walks it once with that class's set, counts the overlap of a shared branch once, and leaves a
branch when the overlap so far plus what can still come is too small. A class with many candidates has them
split over several trees of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.components import connected_components
from tracemill.functions.workspace import Workspace, bound_arrow_batches, checked_lookup, distinct_name, spread_lookup
from tracemill.llm.hashing import shingle_sets

#: Counters of the frequency sketch (1 MB of classes when sent to executors, whatever the input), and its slices.
SKETCH_BITS, SLICES = 20, 64
#: Sketches of so many tasks are added first, then their sums.
SKETCH_FAN_IN = 256
#: Classes that a task remembers so as not to repeat itself; beyond it, it forgets them and may repeat some.
MAX_SEEN = 1 << 20
#: Members of one side of a place at which maps are compared; larger places are split into blocks.
BLOCK_MEMBERS = 1024
#: Pairs of a meeting that a task passes on together.
PAIRS_AT_ONCE = 1 << 16
#: Candidate sets in one prefix tree.
TREE = 256
#: So many (row, class) pairs, 8 MB, may be broadcast to pick texts from the input; beyond it they are shuffled.
MAX_WANTED = 500_000
#: Words of 64 bits in the largest parity map; sets of more shingles than half its bits get a looser bound.
MAP_WORDS = 1024
#: Rounds in which each class is held against one leader, before the rest is paired.
LEADER_ROUNDS = 3
#: Rounds of label spreading after each; the components of all links are followed to their end.
LABEL_ROUNDS = 3


def required_overlap(n: int, m: int, threshold: float) -> int:
    """The least overlap at which sets of n and m elements reach the threshold."""
    num, den = _ratio(threshold)
    return -(-num * (n + m) // (num + den))


def _ratio(threshold: float) -> tuple[int, int]:
    return round(threshold * 1000), 1000


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of sorted hashes."""
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], dtype=np.uint64).view(np.int64)[0])


def ordered_keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in global order, most frequent first: frequency class, complemented, above 56 bits of hash."""
    frequency = classes[hashes & np.uint64(len(classes) - 1)].astype(np.uint64)
    return np.unique(~((frequency << np.uint64(56)) | (hashes >> np.uint64(8))))


class PrefixTree:
    """Sets in global order as a path-compressed trie, walked with one probe set at a time."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.members = sorted(members, key=lambda m: m[1].astype(">u8").tobytes())
        self.sizes = np.array([len(m[1]) for m in self.members])

    def _shared(self, i: int, j: int, depth: int) -> int:
        """How far members i and j run alike, from ``depth`` on."""
        a, b = self.members[i][1], self.members[j][1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def matches(self, probe: np.ndarray, threshold: float) -> list[int]:
        """Ids of members whose Jaccard similarity with ``probe`` reaches the threshold."""
        found: list[int] = []
        stack = [(0, len(self.members), 0, 0)]
        while stack:
            low, high, depth, overlap = stack.pop()
            if low >= high:
                continue
            end = self._shared(low, high - 1, depth)
            first = self.members[low][1]
            after = 0
            if end > depth:
                at = np.searchsorted(probe, first[depth:end])
                inside = at < len(probe)
                overlap += int((probe[np.where(inside, at, 0)] == first[depth:end])[inside].sum())
            if end:
                after = int(np.searchsorted(probe, first[end - 1], "right"))
            sizes = self.sizes[low:high]
            reach = overlap + min(int(sizes.max()) - end, len(probe) - after)
            if reach < required_overlap(int(sizes.min()), len(probe), threshold):
                continue
            while low < high and self.sizes[low] == end:
                if overlap >= required_overlap(end, len(probe), threshold):
                    found.append(self.members[low][0])
                low += 1
            start = low
            while start < high:
                step, value = start + 1, self.members[start][1][end]
                while step < high and self.members[step][1][end] == value:
                    step += 1
                stack.append((start, step, end, overlap))
                start = step
        return found


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """Bits of the smallest power of two above twice the set's size, each the parity of the hashes that end in it."""
    words = min(MAP_WORDS, max(1, 1 << (2 * len(hashes) // 64).bit_length()))
    counts = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


class Seen(set):
    """Classes that a task has met, of bounded number."""

    def new(self, value: int) -> bool:
        if value in self:
            return False
        if len(self) >= MAX_SEEN:
            self.clear()
        self.add(value)
        return True


MEASURED = "kind int, doc_id long, print long, n long, class long, map array<long>, counts binary"


def _measure(width: int):
    """Rows (kind 0: doc_id, print, n, class) per document, and at the end the task's sketch (kind 1) in slices.

    The first row of a class in the task also has its parity map. ``print`` is passed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        seen, task = Seen(), TaskContext.get().partitionId() // SKETCH_FAN_IN
        names = ["kind", "doc_id", "print", "n", "class", "map", "counts"]
        for batch in batches:
            sizes, classes, maps = [], [], []
            for s in shingle_sets(batch.column(2), width):
                sizes.append(len(s))
                classes.append(fingerprint(s) if len(s) else None)
                maps.append(parity_map(s) if len(s) and seen.new(classes[-1]) else None)
                np.add.at(sketch, (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
            n = len(sizes)
            columns = [pa.array([0] * n, pa.int32()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(maps, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names=names)
        if sketch.any():
            slices = [x.tobytes() for x in np.split(np.minimum(sketch, (1 << 32) - 1).astype(np.uint32), SLICES)]
            columns = [pa.array([1] * SLICES, pa.int32()), pa.array([task] * SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(slices, pa.binary())], names=names)

    return run


def _sum_slices(kind):
    """Rows (n, counts), the counts as numbers of ``kind``, added up per n in 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(counts.as_buffer(), dtype=kind).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["n", "counts"]
            )

    return run


def _frequency_classes(measured: DataFrame) -> np.ndarray:
    """The sketch as 8-bit logarithmic classes of what a counter holds beyond the median, 8 to the octave.

    Added up as a tree: over the slices and groups of ``SKETCH_FAN_IN`` tasks, then over the slices. The size
    of the sketch does not depend on the input.
    """
    slices = measured.where("kind = 1").select("n", "counts", "doc_id").repartition("n", "doc_id")
    once = slices.select("n", "counts").mapInArrow(_sum_slices(np.uint32), "n long, counts binary")
    rows = once.repartition(SLICES, "n").mapInArrow(_sum_slices(np.int64), "n long, counts binary").collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.int64)
    for r in rows:
        counts[r["n"]] = np.frombuffer(r["counts"], dtype=np.int64)
    beyond = np.maximum(counts.ravel() - int(np.median(counts)), 1)
    return np.minimum(255, 8 * np.log2(beyond)).astype(np.uint8)


def _prefixes(width: int, threshold: float, classes):
    """Rows (key, class, size << 32 | place) of the rarest shingles of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            keys, owners, places, held = [], [], [], 0
            for s in shingle_sets(batch.column(0), width):
                n = len(s)
                if not n or not seen.new(owner := fingerprint(s)):
                    continue
                keys.append(ordered_keys(s, classes.value)[::-1][: n - required_prefix(n, threshold) + 1])
                p = len(keys[-1])
                owners.append(np.full(p, owner))
                places.append(np.arange(p) + (n << 32))
                held += p
                if held > 1 << 17:
                    yield _prefix_batch(keys, owners, places)
                    keys, owners, places, held = [], [], [], 0
            if keys:
                yield _prefix_batch(keys, owners, places)

    return run


def _prefix_batch(keys, owners, places) -> pa.RecordBatch:
    columns = [np.concatenate([k.view(np.int64) for k in keys]), np.concatenate(owners), np.concatenate(places)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "class", "size_place"])


def required_prefix(n: int, threshold: float) -> int:
    """The least overlap that any partner of a set of n needs."""
    num, den = _ratio(threshold)
    return -(-num * n // den)


def _full_sets(width: int, classes):
    """(class, keys) of every text given, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            owners, sets = [], []
            for s in shingle_sets(batch.column(0), width):
                if len(s) and seen.new(owner := fingerprint(s)):
                    owners.append(owner)
                    sets.append(ordered_keys(s, classes.value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(sets, pa.binary())], names=["class", "keys"])

    return run


def _may_link(n: int, x: np.ndarray, m: int, y: np.ndarray, num: int, den: int) -> bool:
    """Whether parity maps x and y differ in few enough bits for sets of n and m."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (num + den) <= (n + m) * (den - num)


def _compare_maps(threshold: float):
    """Rows sorted by (place, kind): members with n and map (kind 0), then pairs a, b (kind 1) -> pairs whose maps may belong to similar sets."""
    num, den = _ratio(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, {}
        for batch in batches:
            left, right = [], []
            place, kind, a, b = (batch.column(i).to_pylist() for i in range(4))
            for i, at in enumerate(place):
                if at != group:
                    group, members = at, {}
                if kind[i] == 0:
                    members[a[i]] = b[i], np.array(batch.column(4)[i].as_py(), dtype=np.int64).view(np.uint64)
                elif _may_link(*members[a[i]], *members[b[i]], num, den):
                    left.append(a[i])
                    right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def pairs_within_bound(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b, place), those whose parity maps differ in few enough bits.

    The members of a place, cut into blocks of bounded size, meet with its pairs; each brings its map once.
    """
    members = pairs.select("place", F.explode(F.array("a", "b")).alias("class")).distinct().join(maps, "class")
    rows = members.select("place", F.lit(0).alias("kind"), F.col("class").alias("a"), F.col("n").alias("b"), "map").unionByName(
        pairs.select("place", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("array<long>").alias("map"))
    )
    rows = rows.repartition("place").sortWithinPartitions("place", "kind")
    return rows.mapInArrow(_compare_maps(threshold), "a long, b long")


def _pair_members(threshold: float):
    """Rows sorted by meeting (two blocks of one key): distinct pairs of classes of different components that may be similar.

    A pair has to pass the bounds by size and by place in the prefix, then that of the parity maps; only pairs
    that pass are made. A meeting's members are at most two blocks.
    """
    num, den = _ratio(threshold)

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A class stands in a meeting once, so no pair comes twice; pairs are passed on as they gather."""
        block, owner, component, n, place = (np.array([r[k] for r in rows]) for k in range(5))
        maps = [r[5] for r in rows]
        alone, found, held = block.min() == block.max(), [], 0
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            most = 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)
            fits = (low * den >= high * num) & (most * (num + den) >= (n[i] + n[j]) * num) & (component[i] != component[j])
            if not alone:
                fits &= block[i] != block[j]
            near = owner[np.array([k for k in j[fits].tolist() if _may_link(int(n[i]), maps[i], int(n[k]), maps[k], num, den)], dtype=np.int64)]
            if len(near):
                found.append(np.stack([np.minimum(near, owner[i]), np.maximum(near, owner[i])]))
                held += len(near)
            if held >= PAIRS_AT_ONCE:
                yield batch_of(found)
                found, held = [], 0
        if found:
            yield batch_of(found)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for i, (at, *row) in enumerate(zip(*columns, strict=True)):
                if at != meeting:
                    if len(held) > 1:
                        yield from pairs(held)
                    meeting, held = at, []
                held.append((*row, np.array(batch.column(6)[i].as_py(), dtype=np.int64).view(np.uint64)))
        if len(held) > 1:
            yield from pairs(held)

    return run


def pairs_of_open_keys(opened: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) that may be similar, of members (key, size, class, n, place, component) that share a key.

    A key's members are cut into blocks by the hash of their class and every two blocks meet once, so a member is
    repeated once per block of its key and no task holds more than two blocks.
    """
    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS)
    own, other = F.pmod(F.xxhash64("class"), blocks), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    met = opened.select("key", "class", "component", "n", "place", own.alias("block"), other.alias("other"))
    rows = met.select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), "block", "class", "component", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place")
    ).join(maps.select("class", "map"), "class")
    rows = rows.select("meeting", "block", "class", "component", "n", "place", "map").repartition("meeting").sortWithinPartitions("meeting")
    return rows.mapInArrow(_pair_members(threshold), "a long, b long").distinct()


def _verify(threshold: float):
    """Rows sorted by (a, part, b), the probe's own row first (b null): links (a, b) that hold."""

    def links(probe, members):
        if probe is None or not members:
            return []
        return PrefixTree(members).matches(probe, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, probe, members = None, None, []
        for batch in batches:
            left, right = [], []
            for a, part, b, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (a, part) != group:
                    for x in links(probe, members):
                        left.append(group[0])
                        right.append(x)
                    group, probe, members = (a, part), None, []
                values = np.frombuffer(keys.as_py(), dtype=np.uint64)
                if b is None:
                    probe = values
                else:
                    members.append((b, values))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        last = links(probe, members)
        if last:
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0]] * len(last), pa.int64()), pa.array(last, pa.int64())], names=["a", "b"]
            )

    return run


def verify_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of distinct candidate pairs (a, b) of a written table, those whose sets reach the threshold; a set may be given more than once."""
    parts = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    dealt = pairs.join(parts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / TREE)).cast("long").alias("part"), "b"
    )
    members = dealt.select(F.col("b").alias("class"), "a", "part", "b")
    probes = dealt.select(F.col("a").alias("class"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
    roles = members.unionByName(probes)
    few = pairs.limit(MAX_WANTED + 1).count() <= MAX_WANTED
    rows = sets.join(F.broadcast(roles) if few else roles, "class").select("a", "part", "b", "keys")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify(threshold), "a long, b long")


def _near_size(small: str, large: str, threshold: float):
    """Whether the smaller of two packed sizes is large enough for the larger; null sizes are not."""
    num, den = _ratio(threshold)
    return F.coalesce(F.shiftright(small, 32) * den >= F.shiftright(large, 32) * num, F.lit(False))


def _unpacked(column: str, prefix: str):
    return F.shiftright(column, 32).cast("int").alias(f"{prefix}n"), F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias(f"{prefix}place")


def _can_reach(a: str, b: str, threshold: float):
    """Size and position filter for a pair that meets at a shared shingle of its prefixes."""
    num, den = _ratio(threshold)
    n, m = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long")
    most = 1 + F.least(n - F.col(f"{a}place") - 1, m - F.col(f"{b}place") - 1)
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (most * (num + den) >= (n + m) * num)


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.75) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``, exact for the threshold.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. Null or blank texts have no shingles and
    link with nothing; rows that repeat a key with another text are texts of their own; a row with a null key
    links like any other, but its key is never the smallest of its component, and a component of null keys alone
    has none. An empty table gives an empty result. Classes of equal sets are told by 64-bit fingerprints,
    shingles by 56 bits of hash and their frequency class.
    """
    rows, classes = _components(docs, key, text, width, threshold)
    found = spread_lookup(rows, classes.select("class", "smallest"), "class", F.coalesce("doc_id", F.lit(0)), how="left")
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def _components(docs: DataFrame, key: str, text: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Tables of rows (doc_id, print, n, class) and of classes (class, component, smallest).

    The second holds the classes that are linked or have several rows. ``print`` is a hash of the text.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    bound_arrow_batches(spark)
    pairs_in = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    measured = work.table("measured", pairs_in.mapInArrow(_measure(width), MEASURED))
    rows = measured.where("kind = 0").select("doc_id", "print", "n", "class")
    frequencies = spark.sparkContext.broadcast(_frequency_classes(measured))

    # one exchange by key serves the distinct members, their neighbours in size, and the keys with equal members
    by_key = Window.partitionBy("key")
    in_size = by_key.orderBy("size_place")
    prefixes = pairs_in.select("text").mapInArrow(_prefixes(width, threshold, frequencies), "key long, class long, size_place long")
    shared = (
        prefixes.withColumn("low", F.min("class").over(by_key))
        .withColumn("high", F.max("class").over(by_key))
        .where("low <> high")
        .groupBy("key", "class")
        .agg(F.min("size_place").alias("size_place"))
        .withColumn("smaller", F.lag("size_place").over(in_size))
        .withColumn("larger", F.lead("size_place").over(in_size))
        .where(_near_size("smaller", "size_place", threshold) | _near_size("size_place", "larger", threshold))
        .withColumn("group", F.struct(F.bit_xor(F.xxhash64("class")).over(by_key).alias("x"), F.count("*").over(by_key).alias("n")))
        .groupBy(F.xxhash64("group.x", "group.n").alias("key"), "class")
        .agg(F.min("size_place").alias("size_place"))
    )
    shared = work.table("shared", shared.select("key", "class", *_unpacked("size_place", "")))
    maps = measured.where("map IS NOT NULL").select("class", "n", "map").join(shared.select("class").distinct(), "class", "left_semi")
    maps = work.table("maps", maps.dropDuplicates(["class"]))

    by_class = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))

    def sets_of(name: str, wanted: DataFrame) -> DataFrame:
        """The sets of some classes, each from the text of its smallest row, or of rows without a key."""
        chosen = work.table(f"{name}-rows", by_class.join(wanted, "class", "left_semi").select("doc_id", "class"))
        few = chosen.limit(MAX_WANTED + 1).count() <= MAX_WANTED
        ids, owners = (F.broadcast(x) if few else x for x in (chosen.select(F.col("doc_id").alias("id")).distinct(), chosen.select("class")))
        texts = pairs_in.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        return work.table(name, texts.mapInArrow(_full_sets(width, frequencies), "class long, keys binary").join(owners, "class", "left_semi"))

    def sides(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()

    def named(linked: DataFrame | None) -> DataFrame:
        if linked is None:
            return shared.withColumn("component", F.col("class")).withColumn("members", F.lit(1))
        found = shared.join(linked.select(F.col("node").alias("class"), "component", "members"), "class", "left")
        return found.withColumn("component", F.coalesce("component", "class")).withColumn("members", F.coalesce("members", F.lit(1)))

    def maps_of(name: str, pairs: DataFrame) -> DataFrame:
        wanted = work.table(f"{name}-classes", sides(pairs))
        few = wanted.limit(MAX_WANTED + 1).count() <= MAX_WANTED
        return maps.join(F.broadcast(wanted) if few else wanted, "class", "left_semi")

    linked = links = sets = tested = None

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        nonlocal sets, links, tested
        new = sides(pairs) if tested is None else sides(pairs).join(sides(tested), "class", "left_anti")
        fetched = sets_of(f"{name}-sets", new)
        sets = fetched if sets is None else sets.unionByName(fetched)
        proved = work.table(f"{name}-links", verify_pairs(pairs, sets, threshold))
        links = proved if links is None else links.unionByName(proved)
        tested = pairs if tested is None else tested.unionByName(pairs)
        return proved

    def untested(pairs: DataFrame) -> DataFrame:
        if tested is None:
            return pairs
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return pairs.join(done, (F.least(pairs.a, pairs.b) == done.a) & (F.greatest(pairs.a, pairs.b) == done.b), "left_anti")

    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS)
    for k in range(LEADER_ROUNDS):
        # the largest component leads, at every shingle and in every round by another class
        state = work.table(f"state-{k}", named(linked))
        turns = [F.xxhash64("component", F.lit(k)).alias("turn"), "component", F.xxhash64("class", "key", F.lit(k)).alias("class_turn")]
        leaders = (
            state.groupBy("key")
            .agg(
                F.min(F.struct((-F.col("members")).alias("rank"), *turns, "class", "n", "place")).alias("lead"),
                (F.min("component") < F.max("component")).alias("open"),
                F.count("*").alias("size"),
            )
            .where("open")
            .select("key", "size", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("component", "class", "n", "place")])
        )
        pairs = (
            state.join(leaders, "key")
            .where((F.col("component") != F.col("lead_component")) & _can_reach("", "lead_", threshold))
            .groupBy(F.col("lead_class").alias("a"), F.col("class").alias("b"))
            .agg(F.max(F.struct("size", "key")).alias("meet"))
            .select("a", "b", "meet.*")
            .select("a", "b", F.xxhash64("key", "a", F.pmod(F.xxhash64("b"), blocks)).alias("place"))
        )
        pairs = work.table(f"pairs-{k}", untested(pairs))
        bounded = pairs_within_bound(pairs, maps_of(f"maps-{k}", pairs), threshold)
        # one leader for each class and round, so links stay as few as classes; of (x, y) and (y, x), one
        leads = bounded.groupBy("b").agg(F.min("a").alias("a")).groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        leads = leads.agg(F.max("a").alias("a")).select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
        leads = work.table(f"leads-{k}", leads)
        work.drop(f"state-{k}", f"pairs-{k}", f"maps-{k}-classes")
        if not leads.limit(1).count():
            break
        verified(f"leads-{k}", leads)
        # what is linked but not yet named alike only costs pairs that are tested in vain
        linked = connected_components(links, work, f"led-{k}", LABEL_ROUNDS)
        members = work.table(f"members-{k}", linked.groupBy("component").agg(F.count("*").cast("int").alias("members")))
        linked = checked_lookup(linked, members, "component", F.col("node"))

    state = work.table("state", named(linked))
    open_keys = (
        state.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        .where("low < high")
        .select("key", "size")
    )
    opened = work.table("open", state.join(open_keys, "key").select("key", "size", "class", "n", "place", "component"))
    rest = work.table("rest", untested(pairs_of_open_keys(opened, maps, threshold)))
    if rest.limit(1).count():
        verified("rest", rest)
    if links is not None:
        linked = connected_components(links, work, "all")
    if linked is None:
        linked = spark.createDataFrame([], "node long, component long")

    grouped = by_class.join(linked.select(F.col("node").alias("class"), "component"), "class", "left").select(
        "class", "doc_id", "copies", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("linked")
    )
    grouped = work.table("grouped", grouped.where("linked OR copies > 1"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    classes = work.table("classes", grouped.join(smallest, "component").select("class", "component", "smallest"))
    work.keep("measured", "classes")
    return rows, classes


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.75) -> DataFrame:
    """Keep one row of every component: one with its smallest key (null last), ties by text.

    Texts are told apart by key and text, so a row that shares its key with a near copy but has another text
    stays or goes by its own text. Of rows that repeat the key and text that stay, one is kept, whichever values
    its other columns have. Rows without words stay, all of them.
    """
    work = Workspace(docs.sparkSession, "near-copies")
    rows, classes = _components(docs, key, text, width, threshold)
    held = spread_lookup(rows.where("class IS NOT NULL"), classes.select("class", "component"), "class", F.coalesce("doc_id", F.lit(0)), how="left")
    texts = work.table(
        "texts",
        held.withColumn("component", F.coalesce("component", "class")).groupBy("component", "doc_id", "print").agg(F.count("*").alias("rows")),
    )
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print")
    stays = texts.groupBy("component").agg(F.min(rank).alias("stays"), F.sum("rows").alias("all")).where("all > 1")
    judged = texts.join(stays, "component").select(
        "doc_id", "print", "rows", F.col("stays").eqNullSafe(rank).alias("stay")
    )
    judged = work.table("judged", judged)

    low, mark = distinct_name(docs, "_low"), distinct_name(docs, "_print")
    marked = docs.withColumn(mark, F.xxhash64(text))

    def beside(found: DataFrame, how: str) -> DataFrame:
        named = found.select(F.col("doc_id").alias(low), F.col("print").alias(f"{low}_print"))
        few = named.limit(MAX_WANTED + 1).count() <= MAX_WANTED
        same = F.col(key).cast("long").eqNullSafe(F.col(low)) & (F.col(mark) == F.col(f"{low}_print"))
        return marked.join(F.broadcast(named) if few else named, same, how)

    alone = beside(judged.where("NOT stay OR rows > 1"), "left_anti").drop(mark)
    repeated = judged.where("stay AND rows > 1")
    if not repeated.limit(1).count():
        return alone
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = beside(repeated, "left_semi").groupBy(key, mark).agg(F.any_value(row).alias(low)).select(f"{low}.*")
    return alone.unionByName(once)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_components(docs)
