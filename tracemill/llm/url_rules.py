"""URL filters by a sort-merge range join.

A host's labels are reversed into a canonical key (``news.example.com`` becomes ``com.example.news.`` with a byte
that text never holds after each label), so a rule for a host and all its subdomains is one interval of keys, and
so is a rule for a path and all that begin with it. Intervals nest or are apart. One sorted sweep over interval
ends and urls therefore keeps a stack of active rules: at the start of an interval its rule comes on top, at its
end the rule around it is on top again, so the sweep carries the top alone, and the rules below it follow from it.

The first sweep finds the innermost host with rules around each url; the url goes on once for each rule host in
that nest (at most one per label). The second sweep, within such a host, finds the innermost path around the url's
path. Of a url's rules the longest decides. Sweeps run apart per top-level label and per host; one that holds many
urls is split into parts by its counted urls, and its few events are repeated per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.llm.text import ascii_lower

#: Rules of the default table as (host, path, verdict).
DEFAULT_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Words of a host that block a url which no rule judges.
BLOCKED_HOST_WORDS = ("adult", "bet", "bets", "betting", "casino", "gambling", "poker", "porn", "slots", "viagra", "xxx")

#: Bytes that UTF-8 never holds: after each label of a key, and at the end of an interval.
SEPARATOR, LAST = b"\xfe", b"\xff"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Urls of one sweep that go to one part.
URLS_PER_PART = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def host_key(host: Column) -> Column:
    """The canonical key: labels from the top, each closed by a separator."""
    return F.aggregate(F.reverse(F.split(host, r"\.")), F.lit(b""), lambda key, label: F.concat(key, F.encode(label, "UTF-8"), F.lit(SEPARATOR)))


def top_label(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def rule_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_intervals(rules: DataFrame) -> DataFrame:
    """(host, over) of every rule host: the nearest parent host that has rules, or null."""
    hosts = rules.select("host").distinct()
    labels = F.split(F.col("host"), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda up: F.struct(up.alias("up"), F.array_join(F.slice(labels, up + 1, F.size(labels)), ".").alias("over")),
    )
    found = (
        hosts.select("host", F.explode(parents).alias("p"))
        .select("host", "p.*")
        .join(hosts.select(F.col("host").alias("over")), "over")
        .groupBy("host")
        .agg(F.min_by("over", "up").alias("over"))
    )
    return hosts.join(found, "host", "left")


def path_intervals(rules: DataFrame) -> DataFrame:
    """(host, path, verdict, outer, outer_verdict): the longest other rule path of the host that begins each path."""
    by_path = rules.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    shorter = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring("path", F.lit(1), n))
    outer = by_path.select("host", F.col("path").alias("outer"), F.col("verdict").alias("outer_verdict"))
    around = (
        by_path.where(F.length("path") > 0)
        .select("host", "path", F.explode(shorter).alias("outer"))
        .join(outer, ["host", "outer"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("outer", "outer_verdict"), F.length("outer")).alias("around"))
    )
    return by_path.join(around, ["host", "path"], "left").select("host", "path", "verdict", "around.outer", "around.outer_verdict")


def sweep(urls: DataFrame, events: DataFrame, by: str, per_part: int = URLS_PER_PART) -> DataFrame:
    """``urls`` (by, key, row) with ``top``: what the last of ``events`` (by, key, ends, top) at or before the key leaves on top.

    Events at one key go from the interval that ends to the ones that start, the longest last.
    """
    hot = urls.groupBy(by).agg(F.count("*").alias("parts")).where(F.col("parts") > per_part).select(by, F.ceil(F.col("parts") / per_part).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = urls.join(F.broadcast(hot), by, "left").select(
        by, F.pmod(F.xxhash64("row.id"), parts).cast("int").alias("part"), "key", F.lit(1).alias("turn"), F.lit(None).cast(events.schema["top"].dataType).alias("top"), "row"
    )
    repeated = events.join(F.broadcast(hot), by, "left").select(
        by, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "key", F.lit(0).alias("turn"), "top", F.lit(None).cast(urls.schema["row"].dataType).alias("row")
    )
    order = Window.partitionBy(by, "part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(repeated).withColumn("last", F.last("top", ignorenulls=True).over(order))
    return swept.where("turn = 1").select(by, "row", F.col("last").alias("top"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    host_words: tuple[str, ...] = BLOCKED_HOST_WORDS,
    per_part: int = URLS_PER_PART,
) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages`` (columns of those names are replaced).

    Null urls and urls without ``://`` have empty host and path and get the method's verdict. Rows repeat as
    they come; an empty table gives an empty result; without rules every url gets the method's verdict: block
    if a word of its host is in ``host_words``, else ``default``. Rules without a host are left out. Of rules
    equally long the one with the longer host wins; of equal rules with other verdicts, ``block``.
    """
    rules = rules.where(F.coalesce("host", F.lit("")) != "").select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    page = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page")
    rows = pages.select(page, host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("id"))

    tops = host_intervals(rules)
    key = host_key(F.col("host"))
    starts = tops.select(top_label(F.col("host")).alias("label"), key.alias("key"), F.struct(F.col("host").alias("name")).alias("top"))
    ends = tops.select(top_label(F.col("host")).alias("label"), F.concat(key, F.lit(LAST)).alias("key"), F.struct(F.col("over").alias("name")).alias("top"))
    urls = rows.select(top_label(F.col("host")).alias("label"), key.alias("key"), F.struct("page", "host", "path", "id").alias("row"))
    # written, so that the ids that both uses of it meet on are the same
    inside = sweep(urls, starts.unionByName(ends), "label", per_part).select("row", F.col("top.name").alias("nearest"))
    inside = Workspace(pages.sparkSession, "urls").table("inside", inside)

    # the nest of rule hosts around a url: the nearest and all its parents that have rules
    labels = F.split("nearest", r"\.")
    nest = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    apart = inside.select("row", F.explode(nest).alias("rule_host")).where(F.col("rule_host") != "")
    paths = path_intervals(rules).withColumn("rule_host", F.col("host"))
    path_key = F.encode("path", "UTF-8")
    starts = paths.select("rule_host", path_key.alias("key"), F.struct("path", "verdict").alias("top"))
    ends = paths.select("rule_host", F.concat(path_key, F.lit(LAST)).alias("key"), F.struct(F.col("outer").alias("path"), F.col("outer_verdict").alias("verdict")).alias("top"))
    asked = apart.select("rule_host", F.encode("row.path", "UTF-8").alias("key"), "row")
    found = sweep(asked, starts.unionByName(ends), "rule_host", per_part).where("top.path IS NOT NULL")
    rule = F.concat("rule_host", "top.path")
    best = found.select("row", F.struct(F.length(rule).alias("length"), F.length("rule_host").alias("host_length"), rule.alias("rule"), F.col("top.verdict").alias("verdict")).alias("best"))
    judged = best.groupBy(F.col("row.id").alias("id")).agg(F.max("best").alias("best"))

    blocked = F.arrays_overlap(F.split("row.host", "[.-]"), F.array(*map(F.lit, host_words))) if host_words else F.lit(False)
    return inside.join(judged, F.col("row.id") == F.col("id"), "left").select(
        "row.page.*",
        "row.host",
        "row.path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(blocked, "block").otherwise(default)).alias("verdict"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_WORDS = ", ".join(f"'{w}'" for w in BLOCKED_HOST_WORDS)
OP9_SQL = rf"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM parsed p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{_WORDS}])
                               THEN 'block' ELSE 'allow' END) AS verdict
FROM ranked WHERE k = 1
"""
