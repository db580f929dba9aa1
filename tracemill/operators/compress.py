"""Compressing tool payloads: logs, plain text, search results and JSON, without hiding that something was left out.

Logs and texts are rewritten inside their row with array functions; search results are folded by grouping their
lines, so one payload's lines may spread over tasks; JSON of any shape needs a parser and goes through Arrow.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.workspace import Workspace

#: What marks a log line as important, lines of context, lines kept at both ends, and the least lines to look at.
IMPORTANT = r"(?i)(error|fatal|traceback|exception|failed|critical)"
CONTEXT, ENDS, MIN_LOG_LINES = 2, 5, 15
#: Terminal control sequences, the least characters of a text, and repeats from which on lines fold.
CONTROL = r"\x1b\[[0-9;?]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b[@-Z\\-_]|[\r\x08]"
MIN_TEXT, MIN_REPEATS = 400, 2
#: A search result line, the least lines of a search result, and lines kept before the first.
RESULT = r"^([^\s:]+)[:-](\d+)[:-](.*)$"
MIN_SEARCH_LINES, PREAMBLE = 8, 3
#: JSON arrays up to this length stay whole; items kept at both ends; depth; what keeps an item anywhere.
WHOLE_ARRAY, HEAD, TAIL, MAX_DEPTH = 10, 3, 2, 12
FAILURE = re.compile("error|fail|exception|fatal|critical", re.IGNORECASE)


def _staged(payloads: DataFrame, steps) -> DataFrame:
    """Each step's column after the other, so that what a later one looks up element by element is made once.

    Exploded from an array of one: the optimizer would put a plain column that is named once into the function that
    names it, where it is made again for every element.
    """
    for name, column in steps:
        payloads = payloads.withColumn(name, F.explode(F.array(column)))
    return payloads


def compress_logs(payloads: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, compressed): important lines with two around them and five at both ends; what is left out is told by number of lines."""
    n = F.size("_lines")

    def near(i: Column) -> Column:
        low, high = F.greatest(i - CONTEXT, F.lit(0)), F.least(i + CONTEXT, n - 1)
        return F.exists(F.slice("_flags", low + 1, high - low + 1), lambda f: f)

    def line(i: Column, p: Column) -> Column:
        gap = i - F.get("_kept", p - 1) - 1
        mark = F.concat(F.lit("... [omitted "), gap.cast("string"), F.lit(" lines] ...\n"))
        return F.concat(F.when(gap > 0, mark).otherwise(""), F.get("_lines", i))

    rows = _staged(
        payloads.select(key, F.coalesce(text, F.lit("")).alias("_text")),
        (
            ("_lines", F.split("_text", "\n")),
            ("_flags", F.transform("_lines", lambda x: x.rlike(IMPORTANT))),
            ("_kept", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < ENDS) | (i >= n - ENDS) | near(i))),
            ("_out", F.array_join(F.transform("_kept", line), "\n")),
        ),
    )
    return rows.select(key, F.when(n <= MIN_LOG_LINES, F.col("_text")).otherwise(F.col("_out")).alias("compressed"))


def compress_texts(payloads: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, compressed): without control sequences, trailing space, blank lines in a row and repeated lines; as it was if that is no shorter."""
    n = F.size("_tidy")

    def run(s: Column, p: Column) -> Column:
        more = F.coalesce(F.get("_starts", p + 1), n) - s - 1
        line = F.get("_tidy", s)
        mark = F.concat(F.lit("\n... [previous line repeated "), more.cast("string"), F.lit(" more times] ..."))
        return F.when(more >= MIN_REPEATS, F.concat(line, mark)).when(more == 1, F.concat(line, F.lit("\n"), line)).otherwise(line)

    rows = _staged(
        payloads.select(key, F.coalesce(text, F.lit("")).alias("_text")),
        (
            ("_lines", F.transform(F.split(F.regexp_replace("_text", CONTROL, ""), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))),
            ("_tidy", F.filter("_lines", lambda x, i: (x != "") | (i == 0) | (F.get("_lines", i - 1) != ""))),
            ("_starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_tidy", i) != F.get("_tidy", i - 1)))),
            ("_out", F.array_join(F.transform("_starts", run), "\n")),
        ),
    )
    shorter = (F.length("_text") >= MIN_TEXT) & (F.length("_out") < F.length("_text"))
    return rows.select(key, F.when(shorter, F.col("_out")).otherwise(F.col("_text")).alias("compressed"))


def compress_search(payloads: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, compressed): matches folded by file and by equal content, every place kept; unlike texts as they were."""
    lines = payloads.select(key, text, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    part = lambda g: F.regexp_extract("line", RESULT, g)
    marked = lines.withColumn("hit", F.col("line").rlike(RESULT))
    hits = marked.where("hit").select(key, "at", part(1).alias("path"), part(2).alias("number"), F.regexp_replace(part(3), r"\s+$", "").alias("content"))
    places = hits.groupBy(key, "path", "content").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "number"))).alias("at"))
    folded = places.select(
        key, "path", "first", F.concat(F.lit("  "), F.array_join(F.transform("at", lambda x: x["number"]), ","), F.lit(": "), F.col("content")).alias("entry")
    )
    files = folded.groupBy(key, "path").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "entry"))).alias("e"))
    files = files.select(key, "first", F.concat(F.col("path"), F.lit(":\n"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n")).alias("block"))
    body = files.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "block"))), lambda x: x["block"]), "\n").alias("body"), F.min("first").alias("first"))
    counts = hits.groupBy(key).agg(F.count("*").alias("matched"))
    before = marked.where(~F.col("hit") & (F.trim("line") != "")).join(body.select(key, "first"), key).where("at < first")
    top = before.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "line"))), 1, PREAMBLE).alias("p"))
    rows = payloads.select(key, text).join(body, key, "left").join(counts, key, "left").join(top, key, "left")
    lead = F.coalesce(F.array_join(F.transform("p", lambda x: x["line"]), "\n"), F.lit(""))
    out = F.concat(lead, F.when(lead != "", "\n").otherwise(""), F.col("body"))
    engaged = (F.size(F.split(F.col(text), "\n")) > MIN_SEARCH_LINES) & (F.col("matched") >= MIN_SEARCH_LINES) & (F.length(out) < F.length(F.col(text)))
    return rows.select(key, F.when(engaged, out).otherwise(F.col(text)).alias("compressed"))


def sample_json(node, depth: int = 0):
    """Long arrays anywhere cut to their ends and what looks like a failure, with a note of how many were kept."""
    if depth > MAX_DEPTH:
        return node
    if isinstance(node, dict):
        return {k: sample_json(v, depth + 1) for k, v in node.items()}
    if not isinstance(node, list):
        return node
    items = [sample_json(v, depth + 1) for v in node]
    if len(items) <= WHOLE_ARRAY:
        return items
    middle = [v for v in items[HEAD:-TAIL] if FAILURE.search(json.dumps(v))]
    kept = [*items[:HEAD], *middle, *items[-TAIL:]]
    return [*kept, {"_note": f"kept {len(kept)} of {len(items)} items"}]


@F.pandas_udf(T.StringType())
def compress_json(texts: pd.Series) -> pd.Series:
    """Compact JSON with long arrays sampled; texts that are no JSON as they were."""

    def one(text):
        try:
            return json.dumps(sample_json(json.loads(text)), separators=(",", ":"))
        except (TypeError, ValueError):
            return text

    return texts.map(one)


#: Content types by file ending; files of other endings are judged by what they hold.
ENDINGS = {
    "source": (
        "py pyi go ts tsx js jsx mjs cjs rs java kt kts swift c h cc cpp hpp cs rb php scala sh bash zsh sql proto graphql vue svelte css scss html htm xml toml ini tf"
    ).split(),
    "text": "md mdx rst txt adoc yaml yml".split(),
    "json": "json jsonl".split(),
    "log": ["log"],
}


def content_type_of_path(path: Column) -> Column:
    """The content type that a file name tells, or null."""
    ending = F.regexp_extract(F.lower(F.split_part(F.coalesce(path, F.lit("")), F.lit("?"), F.lit(1))), r"\.([a-z]+)$", 1)
    out = F.lit(None).cast("string")
    for kind, names in ENDINGS.items():
        out = F.when(ending.isin(*names), kind).otherwise(out)
    return out


#: What tells search results, test reports, source code and logs, and of how many lines.
SEARCH_LINE = r"^(?:[^\s:]*[/\\][^\s:]*|[^\s:]+\.[A-Za-z0-9_]+):\d+:"
TEST_LINE = r"\b(PASSED|FAILED|SKIPPED|XFAIL|XPASS)\b|^\s*---\s*(PASS|FAIL|SKIP)\b|^\s*(ok|FAIL)\s+\S|^\s*[✓✗√×]\s"
LOG_LINE = r"(?i)\b(INFO|DEBUG|WARN(ING)?|ERROR|FATAL|CRITICAL|TRACE)\b|\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2}"
SHEBANG, CODE_END = r"^\s*#!\s*/", r"[;{}\)]\s*$"
LINE_MARKERS = (
    "def ", "class ", "import ", "from ", "async def", "lambda ", "@", "function ", "const ", "let ", "var ", "export ", "module.exports",
    "package ", "func ", "fn ", "impl ", "pub ", "type ", "struct ", "public ", "private ", "protected ", "static ", "namespace ", "using ",
    "#include", "#define", "#!", "<!DOCTYPE", "<html", "<script", "<style", "```", "if (", "for (", "while (", "switch (", "} else",
)
STRONG_MARKERS = ("from __future__", "#include <", "=> {", "});", "</", "/>")
MIN_EVIDENCE, MIN_MARKERS, MIN_CODE_LINES, CODE_SHARE = 3, 2, 10, 0.30


def typed_payloads(payloads: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``payloads`` with ``content_type``: by the file's name if it tells, else json, search, log, source or text by what stands in it."""
    body = F.coalesce(F.col(text), F.lit(""))
    stripped = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = payloads.withColumn("_stripped", stripped).withColumn("_raw", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S")))
    lines = lambda pattern: F.size(F.filter("_raw", lambda x: x.rlike(pattern)))
    markers = F.array(*map(F.lit, LINE_MARKERS))
    opening = F.size(F.array_distinct(F.flatten(F.transform("_stripped", lambda x: F.filter(markers, lambda m: x.startswith(m))))))
    strong = sum((body.contains(m).cast("int") for m in STRONG_MARKERS), F.lit(0))
    ends = F.size(F.filter("_stripped", lambda x: x.rlike(CODE_END)))
    source = (
        F.substring(body, 1, 200).rlike(SHEBANG) | (opening + strong >= MIN_MARKERS)
        | ((F.size("_stripped") >= MIN_CODE_LINES) & (ends / F.greatest(F.size("_stripped"), F.lit(1)) >= CODE_SHARE))
    )
    sniffed = (
        F.when(F.try_parse_json(body).isNotNull(), "json").when(lines(SEARCH_LINE) >= MIN_EVIDENCE, "search").when(lines(TEST_LINE) >= MIN_EVIDENCE, "log")
        .when(source, "source").when(lines(LOG_LINE) >= MIN_EVIDENCE, "log").otherwise("text")
    )
    return rows.withColumn("content_type", F.coalesce(content_type_of_path(F.col(path)), sniffed)).drop("_stripped", "_raw")


def compress_payloads(payloads: DataFrame, key: str = "id", text: str = "text", path: str = "path") -> DataFrame:
    """(key, content_type, compressed, tokens_before, tokens_after): every payload by the compressor of its type.

    Source code and text files stay byte for byte; text without a file is tidied.
    """
    typed = typed_payloads(payloads, text, path).select(key, F.col(text).alias("text"), F.col(path).alias("path"), "content_type")
    typed = Workspace(payloads.sparkSession, "payloads").table("typed", typed)  # eight scans follow; each would judge every text again
    tidy = (F.col("content_type") == "text") & F.col("path").isNull()
    parts = [
        compress_logs(typed.where("content_type = 'log'"), key),
        compress_search(typed.where("content_type = 'search'"), key),
        compress_texts(typed.where(tidy), key),
        typed.where("content_type = 'json'").select(key, compress_json("text").alias("compressed")),
        typed.where((F.col("content_type") == "source") | ((F.col("content_type") == "text") & ~tidy)).select(key, F.col("text").alias("compressed")),
    ]
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")
    before = typed.select(key, "content_type", tokens("text").alias("tokens_before"))
    return before.join(done, key).select(key, "content_type", "compressed", "tokens_before", tokens("compressed").alias("tokens_after"))
