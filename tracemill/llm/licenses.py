"""License scans: fuzzy search for short notices.

By the pigeonhole principle a notice with at most k errors holds one of its k + 1 pieces exactly. One
Aho-Corasick pass finds all pieces, each hit gives a window where its notice may stand, and the regex
library's bounded-error matching verifies the window and counts the edits.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from operator import attrgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.workspace import bound_arrow_batches
from tracemill.llm.text import keyed

#: Lower-case A-Z; words hold no ASCII character but letters and digits.
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c for c in _SPLIT)

#: Phrases that are counted exactly, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices for the fuzzy search, as normalised words, with their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("apache license version 2 0", "apache"),
    ("apache software license", "apache"),
    ("released under the mit license", "mit"),
    ("the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("public domain dedication", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("all rights reserved", "all-rights-reserved"),
)

#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 10
#: What a notice says beyond a better match inside it counts if fewer than one in so many characters are wrong.
CHARS_PER_ERROR_BEYOND = 3


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    errors: int
    pattern: regex.Pattern


def compile_notices(notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR):
    """(notices, automaton from exact pieces to [(notice, offset of the piece)])."""
    found, seeds = [], {}
    for number, (words, label) in enumerate(notices):
        errors = len(words) // chars_per_error
        # whole words from their first letter to their last, so that an edit does not eat into the word before
        body = f"(?b)(?<![^ ])(?=[^ ])(?:{regex.escape(words)}){{e<={errors}}}(?<=[^ ])(?![^ ])"
        found.append(Notice(words, label, errors, regex.compile(body)))
        cuts = [len(words) * k // (errors + 1) for k in range(errors + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            seeds.setdefault(words[a:b], []).append((number, a))
    automaton = ahocorasick.Automaton()
    for seed, places in seeds.items():
        automaton.add_word(seed, (len(seed), places))
    automaton.make_automaton()
    return found, automaton



@dataclass(frozen=True)
class Match:
    """A verified place of a notice, in characters, with the places of its edits."""

    start: int
    end: int
    notice: Notice
    edits: tuple[int, ...]


_start = attrgetter("start")


def verified_matches(normal: str, notices, automaton) -> set[Match]:
    """Every place at which a seed's window holds its notice with few enough errors.

    Every hit has a window of its own, too short for two places of its notice, so the best match of one place
    hides no other.
    """
    windows: set[tuple[int, int]] = set()
    for end, (size, places) in automaton.iter(normal):
        for number, offset in places:
            windows.add((number, end + 1 - size - offset - notices[number].errors))
    matches = set()
    for number, start in windows:
        n = notices[number]
        # from one space to another, so that no word is cut
        a = normal.find(" ", max(0, start - 1))
        b = normal.rfind(" ", 0, start + len(n.words) + 2 * n.errors + 1) + 1
        if a < b and (m := n.pattern.search(normal, a, b)):
            changed, more, less = m.fuzzy_changes
            # places of deletions are told as if what is missing were there
            edits = (*changed, *more, *(p - k for k, p in enumerate(less)))
            matches.add(Match(m.start(), m.end(), n, edits))
    return matches


def find_notices(normal: str, notices, automaton) -> list[tuple[int, int, str, int, float]]:
    """(first word, last word + 1, label, errors, similarity) of every verified notice, by place.

    ``normal`` is the words joined and enclosed by single spaces.
    """
    found, spaces, at = set(), 0, 0
    for m in sorted(best_matches(verified_matches(normal, notices, automaton)), key=_start):
        spaces += normal.count(" ", at, m.start)  # the words before, counted on from the match before
        at = m.start
        first = spaces - 1
        last = first + normal.count(" ", m.start, m.end) + 1
        errors = len(m.edits)
        found.add((first, last, m.notice.label, errors, 1 - errors / len(m.notice.words)))
    return sorted(found)


def best_matches(matches: set[Match]) -> list[Match]:
    """Matches that no overlapping match with fewer errors contradicts."""
    kept: list[Match] = []  # by place, so that only what may overlap is looked at
    reach = max((m.end - m.start for m in matches), default=0)
    for match in sorted(matches, key=lambda m: (len(m.edits), m.start)):
        near = kept[bisect_left(kept, match.start - reach, key=_start) : bisect_left(kept, match.end, key=_start)]
        if not any(contradicts(k, match) for k in near):
            insort(kept, match, key=_start)
    return kept


def contradicts(better: Match, match: Match) -> bool:
    """Whether ``better``, with fewer errors, explains the place that it shares with ``match``.

    It does not where ``match`` reads their shared place as well and goes on beyond it with few errors: a longer
    notice with an error outlives the shorter one that stands inside it.
    """
    if len(better.edits) >= len(match.edits):
        return False
    a, b = max(better.start, match.start), min(better.end, match.end)
    if a >= b:
        return False
    if better.notice.label == match.notice.label:
        return True

    def within(m):
        return sum(a <= p < b for p in m.edits)

    outside = len(match.edits) - within(match)
    beyond = match.end - match.start - (b - a)
    return within(match) > within(better) or outside * CHARS_PER_ERROR_BEYOND >= beyond


def count_phrases(normal: bytes, phrases=PHRASES) -> list[tuple[str, int, int, int]]:
    """(label, places, first and last word) of every phrase that stands in the text."""
    found = []
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at = normal.find(needle)
        if at < 0:
            continue
        places = [at]
        while (at := normal.find(needle, at + 1)) >= 0:
            places.append(at)
        found.append((label, len(places), normal.count(b" ", 0, places[0]), normal.count(b" ", 0, places[-1])))
    return found


MATCHES = "array<struct<first:long,last:long,label:string,errors:long,similarity:double>>"
PLACES = "array<struct<label:string,places:long,first:long,last:long>>"


def _scan(phrases, notices, chars_per_error):
    match_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("errors", pa.int64()), ("similarity", pa.float64())]))
    place_type = pa.list_(pa.struct([("label", pa.string()), ("places", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, automaton = compile_notices(notices, chars_per_error)
        for batch in batches:
            sizes, exact, fuzzy = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = text.as_buffer().to_pybytes().translate(_SPLIT).split() if text.is_valid else []
                normal = b" " + b" ".join(words) + b" "
                sizes.append(len(words))
                exact.append([dict(zip(("label", "places", "first", "last"), x, strict=True)) for x in count_phrases(normal, phrases)])
                # one character per byte: notices are ASCII, so bytes beyond never match
                found = find_notices(normal.decode("latin-1"), compiled, automaton)
                fuzzy.append([dict(zip(("first", "last", "label", "errors", "similarity"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(exact, place_type), pa.array(fuzzy, match_type)],
                names=["key", "n_words", "phrases", "notices"],
            )

    return run


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Per row of ``docs``: key, n_words, exact ``phrases`` with places, and fuzzy ``notices`` with word spans.

    Null and blank texts have no words and no notices; rows repeat as they come; an empty table gives an empty
    result. A result column that has the key's name gets an underscore in front.
    """
    bound_arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    scanned = docs.select(F.col(key), F.col(text)).mapInArrow(
        _scan(phrases, notices, chars_per_error), f"key {kind}, n_words long, phrases {PLACES}, notices {MATCHES}"
    )
    return keyed(scanned, key)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.array_distinct(F.transform("phrases", lambda p: p["label"]))
    every = F.array_union(base, F.transform("notices", lambda m: m["label"]))
    similar = F.array_max(F.transform("notices", lambda m: m["similarity"]))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.aggregate("phrases", F.lit(0).cast("long"), lambda n, p: n + p["places"]).alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.greatest(F.coalesce(similar, F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.col("notices").alias("spans"),
    )
