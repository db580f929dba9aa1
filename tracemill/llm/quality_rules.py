"""Quality rules: a threshold table compiled into one projection of native expressions.

Repeated windows are found inside the row: hashes of all 5-word windows, and only where some repeat a sort of
(hash, place) tells which. Nothing is shuffled, and a text of any length costs n log n at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.workspace import distinct_name
from tracemill.llm.text import SPACE, words

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with at by this from be or an not have you which".split(),
    "fr": "le la les de des du et en un une que qui dans pour sur au aux par est ce avec ne pas il elle".split(),
    "de": "der die das und in zu den von mit ist des im auf für nicht ein eine als auch es an dem sich er".split(),
    "es": "el la los las de del que y en un una por con para se no es al lo como su más o pero".split(),
}

#: As written inside and at the start of a sentence.
STOP_FORMS = sorted({form for ws in STOP_WORDS.values() for w in ws for form in (w, w.capitalize())})

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep a row only if ``least <= metric <= most``; texts of fewer than ``from_words`` words always pass."""

    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The default threshold table over the metrics of ``metric_columns``.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", most=0.10),
    Rule("bar_ratio", most=0.15),
    Rule("shout_ratio", most=0.30),
    Rule("stop_ratio", least=0.01, from_words=50),
    Rule("stutter_ratio", most=0.30),
    Rule("dup_line_ratio", most=0.40),
    Rule("ellipsis_line_ratio", most=0.30),
    Rule("bullet_line_ratio", most=0.90),
)


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the base counts and the metrics of the threshold table; columns of ``docs`` of their names are replaced."""
    qw, ql, qh, qj, qp, qr = (distinct_name(docs, c) for c in ("_qw", "_ql", "_qh", "_qj", "_qp", "_qr"))
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumns({qw: words(F.col(text)), ql: F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    n = F.size(qw)
    hashes = F.when(
        n >= WINDOW,
        F.transform(
            F.slice(qw, 1, n - (WINDOW - 1)),
            lambda w, i: F.xxhash64(w, *[F.get(F.col(qw), i + k) for k in range(1, WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    two = one.withColumns({qh: hashes, qj: F.array_join(qw, "")})
    placed = F.when(
        F.size(F.array_distinct(qh)) < F.size(qh),
        F.sort_array(F.transform(qh, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    three = two.withColumn(qp, placed)
    before = lambda k: F.get(qp, k - 1)["h"]
    after = lambda k: F.get(qp, k + 1)["h"]
    again = F.sort_array(
        F.filter(
            F.transform(qp, lambda x, k: F.when((before(k) == x["h"]) | (after(k) == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    four = three.withColumn(qr, again)
    covered = F.aggregate(
        F.transform(qr, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(qr, k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.size(ql)
    count = lambda test: F.size(F.filter(qw, test))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n_words = n.cast("long")
    word_chars = F.length(qj).cast("long")
    n_symbols = F.size(F.regexp_extract_all(body, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long")
    n_dup = (lines - F.size(F.array_distinct(ql))).cast("long")
    five = four.withColumns(
        {
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": n_symbols,
            "n_dup_lines": n_dup,
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "stop_ratio": ratio(count(lambda w: w.isin(*STOP_FORMS)), n),
            "bar_ratio": ratio(count(lambda w: w == "|"), n),
            "stutter_ratio": ratio(F.size(F.filter(qw, lambda w, i: w == F.get(F.col(qw), i - 1))), n),
            "shout_ratio": ratio(count(lambda w: w.endswith("!!")), n),
            "ellipsis_line_ratio": ratio(F.size(F.filter(ql, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), lines),
            "bullet_line_ratio": ratio(F.size(F.filter(ql, lambda x: x.rlike(r"^\s*[-*•]"))), lines),
            "dup_line_ratio": ratio(n_dup, lines),
        }
    )
    return five.withColumns(
        {
            "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
        }
    ).drop(qw, ql, qh, qj, qp, qr)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The whole table as one expression."""
    tests = []
    for r in rules:
        bounds = [F.col(r.metric) >= r.least] if r.least is not None else []
        bounds += [F.col(r.metric) <= r.most] if r.most is not None else []
        tests += [t | (F.col("n_words") < r.from_words) if r.from_words else t for t in bounds]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words and fail the base rule, so they are not kept. Rows repeat as they come;
    an empty table gives an empty result; columns of ``docs`` named like a measure are replaced.
    """
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        text_measures(docs, text)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_quality_rules(docs).select(*COLUMNS)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_FORMS)
OP1_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[{SPACE}]+'), lambda w: w <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l
           FROM documents),
n AS (SELECT *, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines,
             len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop,
             len(list_filter(w, lambda x: x = '|')) AS n_bar,
             len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter,
             len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_shout,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
             len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet
      FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, n_words - {WINDOW - 2})) AS i FROM n WHERE n_words >= {WINDOW})),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM n LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
       AND n_symbols / nullif(word_chars, 0)::DOUBLE <= 0.10 AND n_bar / n_words::DOUBLE <= 0.15
       AND n_shout / n_words::DOUBLE <= 0.30 AND (n_words < 50 OR n_stop / n_words::DOUBLE >= 0.01)
       AND n_stutter / n_words::DOUBLE <= 0.30
       AND n_dup_lines / len(l)::DOUBLE <= 0.40 AND n_ellipsis / len(l)::DOUBLE <= 0.30
       AND n_bullet / len(l)::DOUBLE <= 0.90 AS kept
FROM b
"""
