"""Session transcripts as JSON lines, one file per session or bundled, to artifacts, usage and wire logs.

A file's records are one row until they are split, so a session's lines keep their numbers; sessions spread over
tasks. Hundreds of thousands of small files cost the driver a listing, a task's share and a rename each, so
transcripts in such numbers are kept as bundles, whose lines tell the file and the number they have there. Parsing is
JSON functions of Spark on the raw lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.operators import curation as C

BLOCKS = "array<struct<type:string,text:string>>"
#: A line of a bundle: its transcript and when that was collected, its number in it, and itself.
BUNDLED, BUNDLED_TIME = "file string, modified timestamp, ord int, line string", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def scan(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """(file, session_id, project, modified, ord, line) of every non-blank line of the ``*.jsonl`` and ``*.txt`` files under ``path``.

    The session is the file's name, or that of a ``session=`` folder; the project a ``project=`` folder, or the
    folder of the file. ``seen`` (file, modified) leaves out files that have not changed since.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = rows.where(F.col("file").rlike(r"\.(jsonl|txt)$"))
    if seen is not None:
        known = seen.groupBy("file").agg(F.max("modified").alias("_known"))
        rows = rows.join(known, "file", "left").where(F.col("_known").isNull() | (F.col("modified") > F.col("_known"))).drop("_known")
    return rows.select(*_named(), F.posexplode(F.split("value", "\n")).alias("ord", "line")).where(F.trim("line") != "")


def _named() -> list[Column]:
    """file, session_id, project and modified of rows of (file, modified)."""
    part = lambda name: F.nullif(F.regexp_extract("file", rf"/{name}=([^/]+)/", 1), F.lit(""))
    session = F.coalesce(part("session"), F.regexp_extract("file", r"([^/]+)\.[a-z]+$", 1))
    project = F.coalesce(part("project"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return [F.col("file"), session.alias("session_id"), project.alias("project"), F.col("modified")]


def write_bundles(rows: DataFrame, path: str) -> None:
    """Add transcripts (project, session, turn, value) to the bundles under ``path``: JSON lines, as many files as tasks.

    A session is collected whole, so its lines stand in one bundle; collected again, it replaces what it was.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    file = F.concat(F.lit("/project="), name("project"), F.lit("/session="), name("session"), F.lit("/transcript.jsonl"))
    order = Window.partitionBy("project", "session").orderBy("turn")
    lines = rows.select(file.alias("file"), F.current_timestamp().alias("modified"), (F.row_number().over(order) - 1).alias("ord"), F.col("value").alias("line"))
    lines.write.mode("append").option("timestampFormat", BUNDLED_TIME).json(path)


def scan_bundles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of ``scan`` from bundles: of every session, the lines that were collected last."""
    rows = spark.read.schema(BUNDLED).option("timestampFormat", BUNDLED_TIME).option("mode", "FAILFAST").json(path)
    last = F.max("modified").over(Window.partitionBy("project", "session_id"))
    lines = rows.select(*_named(), "ord", "line").withColumn("_last", last)
    return lines.where((F.col("modified") == F.col("_last")) & (F.trim("line") != "")).drop("_last")


def flat_text(content: Column) -> Column:
    """The text of a message whose content (as JSON) is a string or a list of blocks; its text blocks by line."""
    blocks = F.filter(F.from_json(content, BLOCKS), lambda b: b["type"] == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.when(content.startswith("["), joined).otherwise(F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"])


def records(lines: DataFrame) -> DataFrame:
    """User and assistant records: type, role, uuid, parent, timestamp, text, content (JSON) and usage. A malformed line is an error."""
    # blank lines are no records, whenever the filter on them runs
    v = F.parse_json(F.when(F.trim("line") != "", F.col("line")))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    rows = lines.withColumn("v", v)
    content = F.to_json(F.variant_get("v", "$.message.content", "variant"))
    return rows.select(
        "session_id", "project", "ord", get("$.type").alias("type"), get("$.message.role").alias("role"), get("$.uuid").alias("uuid"), get("$.parentUuid").alias("parent"),
        F.to_timestamp(get("$.timestamp")).alias("ts"), F.coalesce(content, F.lit('""')).alias("content"), F.to_json(F.variant_get("v", "$.attachment", "variant")).alias("attachment"),
        *[F.coalesce(get(f"$.message.usage.{k}", "long"), F.lit(0)).alias(k) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")],
    )


def first_copies(rows: DataFrame, text: str = "text") -> DataFrame:
    """Of rows of a session with equal text, the first; the hash is grouped, so no session is put in order."""
    keyed = rows.withColumn("_md5", F.md5(text))
    first = keyed.groupBy("session_id", "_md5").agg(F.min("ord").alias("ord"))
    return keyed.join(first, ["session_id", "_md5", "ord"]).drop("_md5")


def as_chunks(rows: DataFrame, source: str, filter_noise: bool = True) -> DataFrame:
    """Artifacts of (session_id, project, ord, role, ts, text): cleaned, redacted, once per session, without noise."""
    clean = rows.withColumn("text", F.trim(C.strip_reminders(F.col("text")))).where("text <> ''")
    # written, as the search for secrets is dear and its result is read twice
    clean = Workspace(rows.sparkSession, "chunks").table("clean", C.redact_rows(clean).drop("redactions"))
    clean = first_copies(clean.where(F.trim("text") != ""))
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    chunks = clean.withColumn("token_count", tokens).select(
        F.concat_ws(":", "session_id", F.col("ord").cast("string")).alias("id"), F.lit("session_chunk").alias("kind"), "project", F.lit(source).alias("source"),
        "session_id", F.col("ord").cast("long").alias("ord"), "role", "text", "token_count", F.col("ts").alias("created_at"),
    )
    return chunks.where(C.signal(F.col("text"), F.col("role"), F.col("token_count")) > 0) if filter_noise else chunks


def parse_transcripts(lines: DataFrame, filter_noise: bool = True) -> DataFrame:
    """Chunks of a coding agent's transcripts."""
    rows = records(lines).where(F.col("type").isin("user", "assistant")).withColumn("text", flat_text(F.col("content")))
    return as_chunks(rows, "transcript", filter_noise)


def input_text(value: Column) -> Column:
    """What a user typed: a string, or the strings and text blocks of a list by line, without images and empty parts; else ''."""
    typed = F.schema_of_variant(value)
    text = lambda b: F.try_variant_get(b, "$.text", "variant")
    block = lambda b: F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).when(
        (F.try_variant_get(b, "$.type", "string") == "text") & (F.schema_of_variant(text(b)) == "STRING"), F.try_variant_get(b, "$.text", "string")
    )
    listed = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), block), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(typed == "STRING", value.cast("string")).otherwise(F.coalesce(F.array_join(listed, "\n"), F.lit("")))


def parse_wire(lines: DataFrame, filter_noise: bool = True) -> DataFrame:
    """Chunks of a wire log: ``TurnBegin`` is the user, a text ``ContentPart`` the assistant; other and malformed lines go."""
    rows = lines.withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    get = lambda path: F.try_variant_get("v", path, "string")
    kind = get("$.message.type")
    role = F.when(kind == "TurnBegin", "user").when((kind == "ContentPart") & (get("$.message.payload.type") == "text"), "assistant")
    given = F.try_variant_get("v", "$.message.payload.user_input", "variant")
    text = F.when(kind == "TurnBegin", input_text(given)).otherwise(get("$.message.payload.text"))
    at = F.timestamp_seconds(F.try_variant_get("v", "$.timestamp", "double"))
    return as_chunks(rows.select("session_id", "project", "ord", role.alias("role"), text.alias("text"), at.alias("ts")).where("role IS NOT NULL AND text IS NOT NULL"), "wire", filter_noise)


def merge_journal(settled: DataFrame, journal: DataFrame) -> DataFrame:
    """Messages (session_id, ord, role, ts, text) of a saved session and of its journal, each content once, the journal's last."""
    rows = settled.withColumn("_late", F.lit(0)).unionByName(journal.withColumn("_late", F.lit(1)))
    first = rows.groupBy("session_id", "role", "text").agg(F.min(F.struct("_late", "ord", "ts")).alias("m"))
    order = Window.partitionBy("session_id").orderBy("m._late", "m.ord", "role", "text")
    return first.select("session_id", (F.row_number().over(order) - 1).alias("ord"), "role", F.col("m.ts").alias("ts"), "text")


def session_usage(lines: DataFrame, marker: str = "recalled") -> DataFrame:
    """Tokens, tool calls, turns with recall and the time span per session with assistant records.

    A turn counts as recalled if its parent is an earlier attachment that holds ``marker``.
    """
    r = records(lines)
    calls = F.size(F.filter(F.coalesce(F.from_json("content", "array<struct<type:string>>"), F.array().cast("array<struct<type:string>>")), lambda b: b["type"] == "tool_use"))
    said = r.where("type = 'assistant'").withColumn("calls", F.when(F.col("content").startswith("["), calls).otherwise(0))
    given = r.where(F.col("attachment").contains(marker) & F.col("uuid").isNotNull()).groupBy("session_id", F.col("uuid").alias("parent")).agg(F.min("ord").alias("given"))
    joined = said.join(given, ["session_id", "parent"], "left")
    return joined.groupBy("session_id", "project").agg(
        F.count("*").alias("assistant_turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_input_tokens").alias("cache_read_tokens"), F.sum("cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.sum("calls").cast("long").alias("tool_calls"), F.count_if(F.col("given") < F.col("ord")).alias("recall_turns"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


def path_project(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """Project per session by the MD5 of its working directory (paths: path); without one, the directory its first turn names, or null."""
    known = paths.select(F.md5("path").alias("dir_hash"), "path").distinct()
    named = F.nullif(F.regexp_extract("first_text", r"(?:^|\s)(/[\w./-]+)", 1), F.lit(""))
    return messages.join(known, "dir_hash", "left").select("session_id", F.regexp_extract(F.coalesce("path", named), r"([^/]+)/?$", 1).alias("project"))
