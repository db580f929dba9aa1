"""Benchmark decontamination with a generalised suffix automaton over words.

All normalised test items go into one automaton (states are sets of end positions, as usual). A document's
words stream through it and the length of the longest match that ends at each word is known at every step:
where it reaches the window, the last ``window`` words stand in some item. Items shorter than a window count
where the whole item matches. Before that, a document is cut into blocks of half a window: a hit of ``w`` words
covers an aligned block of ``(w + 1) // 2`` whole, so a document none of whose blocks stands in an item has no
hit and is not streamed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.workspace import Shipped, bound_arrow_batches
from tracemill.llm.text import keyed

#: The automaton of so many item words takes under 1 GB; larger benchmarks are dealt into parts of at most so many.
MAX_ITEM_WORDS = 1_000_000
#: With several parts, a task leads so many bytes of rows past all automata in turn, and holds one at a time.
TURN_BYTES = 64 << 20
WINDOW = 10

#: Words are runs of anything but ASCII characters that are no letter or digit.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c for c in _SPLIT)


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return text.encode().translate(_SPLIT).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; state 0 is the start."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Of states for windows: the items that hold one; of states of whole short items: (words, item).
        self.holders: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        items = [(i, words) for i, words in items if words]
        least = min([window, *(len(words) for _, words in items)])
        self.block = (least + 1) // 2
        self.blocks = {b for _, words in items for b in zip(*(words[k:] for k in range(self.block)), strict=False)}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words in items:
            state, match = 0, 0
            for w in words:
                state, match = self.step(state, match, w)
                if match >= window:
                    self.holders.setdefault(self.window_state(state), set()).add(item)
            if len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        # short items that end wherever a state's strings end
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.short.get(self.link[state])
            if above:
                self.short[state] = self.short.get(state, []) + above

    def _new(self, length: int, after: dict[bytes, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The part of state q that ``w`` reaches from p and shorter, as a state of its own."""
        part = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def step(self, state: int, match: int, w: bytes) -> tuple[int, int]:
        """The state and longest match after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            match = self.length[state]
        state = self.next[state].get(w, 0)
        return state, match + 1 if state else 0

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a match at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [first, last + 1) of hit words, and the items with occurring windows."""
        if self.blocks.isdisjoint(zip(*[iter(words)] * self.block, strict=False)):
            return [], set()
        after, window, short = self.next, self.window, self.short
        start = after[0]
        spans: list[list[int]] = []
        states: set[int] = set()
        items: set[str] = set()
        state = match = 0
        for i, w in enumerate(words):
            if state:
                state, match = self.step(state, match, w)
            else:
                state = start.get(w, 0)
                match = 1 if state else 0
            if not state:
                continue
            width = window if match >= window else 0
            if width:
                states.add(self.window_state(state))
            if state in short:
                for n, item in short[state]:
                    if n <= match:
                        items.add(item)
                        width = max(width, n)
            if width:
                first = i + 1 - width
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        for s in states:
            items |= self.holders[s]
        return spans, items


def item_pieces(words: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """The words, in pieces of at most ``most`` that overlap so that every window stands whole in one."""
    if len(words) <= most:
        yield words
        return
    for at in range(0, len(words) - window + 1, most - window + 1):
        yield words[at : at + most]


def _by_item(entry: tuple[str | None, list[bytes]]) -> tuple:
    return entry[0] is None, entry[0] or "", entry[1]


def build_automata(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> list[Shipped]:
    """One automaton per part of at most ``MAX_ITEM_WORDS`` item words, sent to the executors; at least one.

    The driver holds one part at a time. Null texts have no words; items that repeat an id count as one item
    where any of them occurs, and so do the pieces of an item beyond the bound.
    """
    bound_arrow_batches(benchmark.sparkSession)
    most = max(MAX_ITEM_WORDS, window)
    sent, part, held = [], [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).toLocalIterator():
        for piece in item_pieces(item_words(r["text"]), window, most):
            if held + len(piece) > most:
                sent.append(Shipped(benchmark.sparkSession, SuffixAutomaton(sorted(part, key=_by_item), window)))
                part, held = [], 0
            part.append((r["item"], piece))
            held += len(piece)
    if part or not sent:
        sent.append(Shipped(benchmark.sparkSession, SuffixAutomaton(sorted(part, key=_by_item), window)))
    return sent


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    """Spans that overlap or touch as one, in order."""
    merged: list[list[int]] = []
    for first, last in sorted(spans):
        if merged and merged[-1][1] >= first:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return merged


def _turns(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at least ``size`` bytes, the last one excepted."""
    turn, held = [], 0
    for batch in batches:
        turn.append(batch)
        held += batch.nbytes
        if held >= size:
            yield turn
            turn, held = [], 0
    if turn:
        yield turn


def _scanned(automata: list[Shipped], batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with (number of words, spans, items) of its texts, over all automata.

    A hit is a window or a short item, and each stands whole in one part, so the parts' hits together are those
    of one automaton of all items.
    """
    alone = len(automata) == 1
    for turn in _turns(batches, 0 if alone else TURN_BYTES):
        found = [[(0, [], set())] * batch.num_rows for batch in turn]
        for automaton in automata:
            scan = automaton.value.scan
            for batch, rows in zip(turn, found, strict=True):
                for i, text in enumerate(batch.column(place).cast(pa.large_binary())):
                    words = text.as_buffer().to_pybytes().translate(_SPLIT).split() if text.is_valid else []
                    spans, items = scan(words)
                    if rows[i][1] and spans:
                        spans, items = merge_spans(rows[i][1] + spans), rows[i][2] | items
                    elif not spans:
                        spans, items = rows[i][1:]
                    rows[i] = (len(words), spans, items)
            if not alone:
                del scan
                automaton.release()
        yield from zip(turn, found, strict=True)


def _scan(automata):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _scanned(automata, batches, 1):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([spans for _, spans, _ in rows], pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(items, key=lambda i: (i is None, i or "")) for _, _, items in rows], pa.list_(pa.string())),
                ],
                names=["key", "n_words", "spans", "items"],
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, n_words, spans of hit words ([first, last + 1) pairs) and the items found.

    Null and blank texts have no words and no hits; rows repeat as they come; with no items nothing is hit. Items
    without an id are one item, a null at the end of ``items``. A result column that has the key's name gets an
    underscore in front.
    """
    automata = build_automata(benchmark, text="text", window=window)
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key), F.col(text)).mapInArrow(_scan(automata), f"key {kind}, n_words long, spans array<array<long>>, items array<string>")
    return keyed(found, key)


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the given word spans."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at : places[first][0]])
        at = places[last - 1][1]
    return "".join([*kept, text[at:]])


def _clean(automata, place: int, min_words: int, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _scanned(automata, batches, place):
            texts, keep = [], []
            for text, (n_words, spans, _) in zip(batch.column(place), rows, strict=True):
                body = text.as_py()
                keep.append(sum(b - a for a, b in spans) <= max_coverage * n_words)
                spans = [s for s in spans if s[1] - s[0] >= min_words]
                texts.append(cut_spans(body, spans) if spans and keep[-1] else body)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    min_words: int = 1,
    max_coverage: float = 0.5,
) -> DataFrame:
    """Rows of ``docs`` without benchmark passages, all columns kept.

    Spans of at least ``min_words`` hit words are cut out of the text; a row goes if more than
    ``max_coverage`` of its words are hit. Rows without hits, null texts included, stay as they are.
    """
    automata = build_automata(benchmark, window=window)
    place = docs.columns.index(text)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(_clean(automata, place, min_words, max_coverage), schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
         FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN held USING (doc_id)
"""
