"""Alignment of two tokenizers over the same bytes, by galloping intersection of their token ends.

Both token lists of a text cover the same bytes, so each is a rising list of end offsets. The shorter list of every
text is looked up in the longer by exponential and then binary search, for all texts of a batch at once. Ends found
in both cut the text into groups; the ranks that the search gives are, by their differences, the range of tokens of
the one side that each token of the other overlaps.

How often two ids are linked in the whole corpus is counted per piece of the corpus first: a piece's distinct pairs
go to the corpus-wide counts and come back as one table for that piece, so texts are tokenized once and no pair is
shuffled once per text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace, bound_arrow_batches

#: Folder of the vocabulary files and the files of the two sides.
FOLDER, SIDE_A, SIDE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text in a piece of the corpus whose pairs are counted together; one text at least.
PIECE = 32 << 20
#: Characters of text aligned at a time.
PORTION = 1 << 20
#: How byte-level vocabularies cut texts before merging, and the mark for a space in pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"

SUMMARY = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"piece long, key long, {SUMMARY}, pairs binary, times binary, piece_pairs binary, piece_times binary"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelTokenizer:
    """A byte-level BPE of a JSON vocabulary, without special tokens: their strings are ordinary text.

    Its ids follow the order of its merges, so they serve as ranks for a faster encoder; texts that one fails on
    (runs of white space past its stack) go through the vocabulary's own library.
    """

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        self._slow = tokenizers.Tokenizer.from_file(path)
        self._slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()
        special = {token for token in model["vocab"] if not set(token) <= letters.keys()}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        places = [model["vocab"][token] for token in merged]
        if any(a >= b for a, b in zip(places, places[1:], strict=False)):
            raise ValueError("ids must follow the order of merges")
        self._fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if not {bytes([b]) for b in range(256)} <= ranks.keys():
            raise ValueError("every byte must be a token")  # then any text is given back as it was
        self.tokens = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def _encode(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException":
                raise
            return self._slow.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, first place of each text and the end, whether the tokens give each text back)."""
        found = [self._encode(" " + text) for text in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=at[-1]), at, np.ones(len(texts), dtype=bool)


class PieceTokenizer:
    """A sentencepiece model; it adds a space in front, and texts that it changes are not given back."""

    def __init__(self, path: str):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self._own.is_byte(i) else b"" if self._own.is_control(i) or self._own.is_unknown(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, first place of each text and the end, whether the tokens give each text back)."""
        found = self._own.encode(texts, num_threads=1)
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        same = [b"".join(map(self.tokens.__getitem__, ids)) == (" " + text).encode() for ids, text in zip(found, texts, strict=True)]
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=at[-1]), at, np.array(same, dtype=bool)


def gallop(keys: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of every key in the rising ``ends`` (how many are smaller), searched outwards from ``start``.

    The step doubles until key lies between two probes, then halves within them, for all keys side by side.
    """
    n = len(ends)
    low = np.clip(start, 0, n)  # all ends before low are smaller, after the first loop
    step = np.ones(len(keys), dtype=np.int64)
    left = np.flatnonzero((low > 0) & (ends[np.maximum(low - 1, 0)] >= keys)) if n else np.zeros(0, dtype=np.int64)
    high = low.copy()
    while len(left):
        high[left] = low[left]
        low[left] = np.maximum(low[left] - step[left], 0)
        step[left] *= 2
        left = left[(low[left] > 0) & (ends[np.maximum(low[left] - 1, 0)] >= keys[left])]
    right = np.flatnonzero((high == low) & (high < n) & (ends[np.minimum(high, n - 1)] < keys)) if n else left
    step[:] = 1
    while len(right):
        low[right] = high[right] + 1
        high[right] = np.minimum(high[right] + step[right], n)
        step[right] *= 2
        right = right[(high[right] < n) & (ends[np.minimum(high[right], n - 1)] < keys[right])]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        smaller = ends[middle] < keys[open_]
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]
        open_ = open_[low[open_] < high[open_]]
    return low


@dataclass
class Links:
    """Token places of all links (a, b), and per token of either side whether a group ends with it."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


def intersect(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> Links:
    """Align the token ends of a batch; text t has tokens at[t] to at[t + 1] and ends rise across texts.

    Tokens are not empty and both sides of a text end at the same offset.
    """
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    a_short = np.repeat(n_a <= n_b, n_a)
    b_short = np.repeat(n_b < n_a, n_b)
    # the shorter list of each text drives, the longer is searched; both stay in the order of texts
    short_a, short_b, long_a, long_b = np.flatnonzero(a_short), np.flatnonzero(b_short), np.flatnonzero(~a_short), np.flatnonzero(~b_short)
    n_short, n_long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    from_a = n_a <= n_b
    keys, ends = np.empty(n_short.sum(), dtype=np.int64), np.empty(n_long.sum(), dtype=np.int64)
    place_short, place_long = np.empty(len(keys), dtype=np.int64), np.empty(len(ends), dtype=np.int64)
    of_a_short, of_a_long = np.repeat(from_a, n_short), np.repeat(~from_a, n_long)
    place_short[of_a_short], place_short[~of_a_short] = short_a, short_b
    place_long[of_a_long], place_long[~of_a_long] = long_a, long_b
    keys[of_a_short], keys[~of_a_short] = ends_a[short_a], ends_b[short_b]
    ends[of_a_long], ends[~of_a_long] = ends_a[long_a], ends_b[long_b]

    first_short, first_long = np.cumsum(n_short) - n_short, np.cumsum(n_long) - n_long
    inside = np.arange(len(keys)) - np.repeat(first_short, n_short)
    guess = np.repeat(first_long, n_short) + inside * np.repeat(n_long, n_short) // np.maximum(np.repeat(n_short, n_short), 1)
    rank = gallop(keys, ends, guess)
    common = ends[rank] == keys  # both sides of a text end together, so a rank is never past the last end
    low = np.concatenate([[0], (rank + common)[:-1]]) if len(keys) else rank
    count = rank - low + 1  # from the token that holds the byte after the last end to the one that holds the last byte
    short = np.repeat(np.arange(len(keys)), count)
    longer = np.arange(len(short)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    flip = ~of_a_short[short]
    a, b = place_short[short], place_long[longer]
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    a_ends, b_ends = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    ends_short, ends_long = place_short[common], place_long[rank[common]]
    own = of_a_short[common]
    a_ends[ends_short[own]], a_ends[ends_long[~own]] = True, True
    b_ends[ends_short[~own]], b_ends[ends_long[own]] = True, True
    return Links(a, b, a_ends, b_ends)


class Aligner:
    """Both tokenizers and the written forms of their ids; loaded once per task process."""

    _loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteLevelTokenizer(path_a), PieceTokenizer(path_b)
        self.lengths = [np.array([len(t) for t in side.tokens], dtype=np.int64) for side in self.sides]
        a, b = (range(len(side.tokens)) for side in self.sides)
        # an id as it is written within a group and at the group's end, A's and then B's
        self.written = [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b]
        # a pair of ids is one number
        self.pair = np.uint32 if len(a) * len(b) < 1 << 32 else np.int64

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, digest of the groups, pairs of all links) per text.

        Null and empty texts, and those that a side can't give back byte for byte, have no tokens.
        """
        found = [side.ids([t or "" for t in texts]) for side in self.sides]
        held = np.array([bool(t) for t in texts], dtype=bool)
        for _, _, same in found:
            held &= same
        flat, at, ends = [], [], []
        for (ids, cuts, _), lengths in zip(found, self.lengths, strict=True):
            counts = np.diff(cuts)
            if not held.all():
                ids, counts = ids[np.repeat(held, counts)], np.where(held, counts, 0)
            flat.append(ids)
            at.append(np.concatenate([[0], np.cumsum(counts)]))
            ends.append(np.cumsum(lengths[ids]))
        links = intersect(*ends, *at)
        pairs = (flat[0] * len(self.lengths[1]))[links.a].astype(self.pair) + flat[1].astype(self.pair)[links.b]
        cuts = np.searchsorted(links.a, at[0])
        groups = np.concatenate([[0], np.cumsum(links.a_ends)])
        # a token's place among all that are written: those of its side before it, and the other side's earlier groups
        group_a = groups[:-1]
        group_b = np.concatenate([[0], np.cumsum(links.b_ends)])[:-1]
        until_a = np.concatenate([np.flatnonzero(links.a_ends) + 1, [len(flat[0])]])
        until_b = np.concatenate([[0], np.flatnonzero(links.b_ends) + 1])
        codes = np.empty(len(flat[0]) + len(flat[1]), dtype=np.int64)
        size_a, size_b = len(self.lengths[0]), len(self.lengths[1])
        codes[np.arange(len(flat[0])) + until_b[group_a]] = flat[0] + size_a * links.a_ends
        codes[np.arange(len(flat[1])) + until_a[group_b]] = flat[1] + size_b * links.b_ends + 2 * size_a
        for t in range(len(texts)):
            low, high = at[0][t], at[0][t + 1]
            if low == high:
                yield 0, 0, 0, 0, "", pairs[:0]
                continue
            text = "".join(map(self.written.__getitem__, codes[low + at[1][t] : high + at[1][t + 1]].tolist()))[:-1]
            yield int(high - low), int(at[1][t + 1] - at[1][t]), int(groups[high] - groups[low]), int(cuts[t + 1] - cuts[t]), hashlib.sha256(text.encode()).hexdigest(), pairs[cuts[t] : cuts[t + 1]]


def _counted(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, rising, and the sums of their times."""
    every, n = np.concatenate(pairs), np.concatenate(times).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else order
    return every[first], np.add.reduceat(n, first) if len(every) else n


def _portions(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for t, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield low, t + 1
            low, held = t + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _aligned(path_a: str, path_b: str, piece_size: int):
    """Rows of texts with their distinct pairs, and one row for every piece with the pairs of all its texts."""
    kinds = (pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4)
    names = ["piece", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "piece_pairs", "piece_times"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        piece, held, pairs, times = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in _portions(texts, PORTION):
                rows, here = [], []
                for key, (*summary, found) in zip(keys[low:high], aligner.align(texts[low:high]), strict=True):
                    own, n = np.unique(found, return_counts=True)
                    here.append((own, n))
                    rows.append((piece, key, *summary, own.tobytes(), n.astype(np.uint32).tobytes(), None, None))
                held += sum(len(t or "") for t in texts[low:high])
                more = _counted([p for p, _ in here], [n for _, n in here])
                pairs, times = ([*pairs, more[0]], [*times, more[1]])
                if len(pairs) >= 8 or held >= piece_size:
                    merged = _counted(pairs, times)
                    pairs, times = [merged[0]], [merged[1]]
                if held >= piece_size:
                    rows.append((piece, *[None] * 8, pairs[0].tobytes(), times[0].tobytes()))
                    piece, held, pairs, times = piece + 1, 0, [], []
                yield made(rows)
        if held or pairs:
            found, n = _counted(pairs, times)
            yield made([(piece, *[None] * 8, found.tobytes(), n.tobytes())])

    return run


def _unpacked(path_a: str, path_b: str):
    """(piece, id of A, id of B, times) for every distinct pair of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        size_b = len(aligner.lengths[1])
        for batch in batches:
            for piece, pairs, times in zip(*(batch.column(k) for k in range(3)), strict=True):
                found, n = np.frombuffer(pairs.as_buffer(), dtype=aligner.pair).astype(np.int64), np.frombuffer(times.as_buffer(), dtype=np.int64)
                for low in range(0, len(found), 50_000):
                    part = found[low : low + 50_000]
                    columns = [np.full(len(part), piece.as_py()), part // size_b, part % size_b, n[low : low + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["piece", "a", "b", "times"])

    return run


def _settled(path_a: str, path_b: str):
    """Texts of one piece with the corpus-wide counts of that piece's pairs: n_best and count_sum."""

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        aligner = Aligner.of(path_a, path_b)
        pairs = counts["a"].to_numpy() * len(aligner.lengths[1]) + counts["b"].to_numpy()
        order = np.argsort(pairs)
        pairs, total, best = pairs[order], counts["total"].to_numpy()[order], counts["best"].to_numpy()[order]
        n_best, sums = [], []
        for own, times in zip(texts["pairs"], texts["times"], strict=True):
            found, n = np.frombuffer(own.as_buffer(), dtype=aligner.pair), np.frombuffer(times.as_buffer(), dtype=np.uint32).astype(np.int64)
            at = np.searchsorted(pairs, found.astype(np.int64))
            n_best.append(int(n[best[at]].sum()))
            sums.append(int((n * total[at]).sum()))
        kept = texts.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return run


def align_tokenizers(
    docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", folder: str = FOLDER, side_a: str = SIDE_A, side_b: str = SIDE_B, piece_size: int = PIECE
) -> tuple[DataFrame, DataFrame]:
    """(per row of ``docs``: key as ``key`` and its alignment, per linked pair of ids: how many links hold it).

    Rows: key, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose count is the highest of their id of
    side B, ties included) and count_sum. Pairs: a, b, total, best. Null keys and rows that repeat a key are
    answered one by one; null and empty texts and those that a tokenizer can't give back have zeros and ''. A text
    of any length is aligned whole in one task. ``key`` is a whole number; both files must be found under
    ``folder`` on every executor. A pair is in a piece's table once, so even one that all texts hold is no more
    than a row per piece.
    """
    bound_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text))
    files = f"{folder}/{side_a}", f"{folder}/{side_b}"
    aligned = work.table("aligned", rows.mapInArrow(_aligned(*files, piece_size), ALIGNED))
    pieces = aligned.where(F.col("piece_pairs").isNotNull()).select("piece", "piece_pairs", "piece_times")
    pieces = work.table("pieces", pieces.mapInArrow(_unpacked(*files), "piece long, a long, b long, times long"))
    totals = work.table("totals", pieces.groupBy("a", "b").agg(F.sum("times").alias("total")))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    pairs = work.table("pairs", totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best")))
    work.drop("totals")
    counts = pieces.drop("times").join(pairs, ["a", "b"]).groupBy("piece")
    texts = aligned.where(F.col("piece_pairs").isNull()).drop("piece_pairs", "piece_times").groupBy("piece")
    return texts.cogroup(counts).applyInArrow(_settled(*files), f"key long, {SUMMARY}, n_best long, count_sum long"), pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, _ = align_tokenizers(docs, Workspace(spark, "alignment"))
    return found.withColumnRenamed("key", "doc_id")
