"""Keeping a store clean: noise, signal, classes, secrets, duplicates and what a prune would retire."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cue phrases of the classes of a chunk, in order of precedence.
CUES = {
    "bugfix": r"(?i)(the fix is|root cause|the bug was|the issue was|caused by|the problem is|this fails because|the error occurs)",
    "decision": r"(?i)(we decided|the approach is|instead of|switched to|chose .+ over|trade-?off|architecture:|design decision)",
    "lesson": r"(?i)(always use|never use|never do|important:|note:|pattern:|best practice|lesson learned|rule of thumb|should always|should never)",
}
#: Chatter of the harness, and briefs written to a subagent; both at the start of a text.
HARNESS_NOISE = r"(?i)^\s*(?:\[Request interrupted|\[Tool use was (?:rejected|cancelled)|API Error|\[\w+:ccr:|<local-command-(?:stdout|caveat)|Caveat: The messages below were generated|\[The user (?:sent|interrupted))"
AGENT_BRIEF = r"(?i)^\s*#{1,3}\s+.*\((?:voter|reviewer|verifier|judge|agent)\s*\d+\s*/\s*\d+\)"
#: Further texts without signal.
BOILERPLATE = "Base directory for this skill"
BASE64 = r"[A-Za-z0-9+/=]{200,}"
PERMISSION = r"(?i)^(Allow |Permission |Do you want to allow |Grant )"
PATH_LINE = r"^[/~][\w./\-]+$"
FILLER_START = r"(?i)^(Let me |Now let me |Now I|I'll |I will |Good[,.]|Great[,.]|Perfect[!,.]|Done[!,.]|Alright|Sure[,.]|OK[,.]|Moving to |Looking at |Checking )"
#: Least tokens of a signal, of a filler, of a user's turn, of a turn with code, of a long turn.
MIN_SIGNAL, MIN_FILLER, MIN_USER, MIN_CODE, MIN_LONG = 8, 30, 6, 40, 100
#: Token shapes that carry credentials, in the order in which they are looked for, with their group.
SECRETS = {
    "aws_key": (r"AKIA[0-9A-Z]{16}", 0),
    "aws_secret": (r"((?:aws.{0,20})?[0-9a-zA-Z/+]{40})(?:\s|$|\")", 1),
    "openai_key": (r"sk-[a-zA-Z0-9_-]{20,}", 0),
    "anthropic_key": (r"sk-ant-[a-zA-Z0-9_-]{20,}", 0),
    "github_token": (r"gh[ps]_[A-Za-z0-9_]{36,}", 0),
    "github_fine": (r"github_pat_[A-Za-z0-9_]{20,}", 0),
    "stripe_key": (r"[sr]k_(?:live|test)_[A-Za-z0-9]{20,}", 0),
    "slack_token": (r"xox[bpras]-[A-Za-z0-9\-]{10,}", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
    "pem": (r"(?s)-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", 0),
    "connection_string": (r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|sqlite)://[^\s\"'`]{10,}", 0),
    "env_assignment": (r"(?m)^[A-Z_]{2,50}(?:_KEY|_SECRET|_TOKEN|_PASSWORD|_PASS|_API|_CREDENTIAL)[=:]\s*\S+", 0),
    "generic_key": (r"(?i)(?:key|token|secret|password|apikey|api_key)[\"']?\s*[=:]\s*['\"]?([^\s'\"]{8,})", 1),
}
#: Tokens of this shape whose entropy reaches the threshold count as secrets too.
ENTROPY_TOKEN, ENTROPY_THRESHOLD = r"[A-Za-z0-9_/+\-]{20,}", 4.0
PLACEHOLDER = "[REDACTED]"
#: Words of which the general pattern needs one.
KEY_WORDS = ("key", "token", "secret", "password")


def strip_reminders(text: Column) -> Column:
    """Without ``<system-reminder>`` blocks."""
    return F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")


def is_listing(text: Column) -> Column:
    """At least two lines, all of which are paths."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(PATH_LINE))


def is_harness(text: Column) -> Column:
    """Chatter of the harness or a brief to a subagent: what a later cleaning retires."""
    return text.rlike(HARNESS_NOISE) | text.rlike(AGENT_BRIEF)


def is_noise(text: Column, tokens: Column) -> Column:
    """What ingestion drops whatever the role."""
    return (
        (tokens < MIN_SIGNAL) | text.contains(BOILERPLATE) | is_harness(text) | text.rlike(BASE64) | text.rlike(PERMISSION)
        | is_listing(text) | (text.rlike(FILLER_START) & (tokens < MIN_FILLER))
    )


def classify(text: Column) -> Column:
    """The first class whose cue stands in the text; long texts with code are snippets, others extracts."""
    found = reduce(lambda c, kv: c.when(text.rlike(kv[1]), kv[0]), list(CUES.items())[1:], F.when(text.rlike(CUES["bugfix"]), "bugfix"))
    return found.when(text.contains("```") & (F.length(text) > 200), "snippet").otherwise("extract")


def signal(text: Column, role: Column, tokens: Column) -> Column:
    """0 for noise; users get 1 from six tokens on, assistants 2 per class of cue and 1 for code, or 0.5 for length alone."""
    cues = sum((F.when(text.rlike(p), 2.0).otherwise(0.0) for p in CUES.values()), F.lit(0.0))
    cues = cues + F.when(text.contains("```") & (tokens >= MIN_CODE), 1.0).otherwise(0.0)
    assistant = F.when((cues == 0) & (tokens >= MIN_LONG), 0.5).otherwise(cues)
    user = F.when(tokens >= MIN_USER, 1.0).otherwise(0.0)
    return F.when(is_noise(text, tokens), 0.0).when(role == "user", user).when(role == "assistant", assistant).otherwise(0.0)


def entropy(token: Column) -> Column:
    """Shannon entropy of a string in bits per character; 0 for the empty string."""
    n = F.length(token).cast("double")
    share = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n
    seen = F.array_distinct(F.filter(F.split(token, ""), lambda c: c != ""))
    return F.aggregate(seen, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def _named(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"))


def secrets(text: Column) -> Column:
    """array<struct<kind, match>> in order of the patterns, then tokens of high entropy that no match before holds."""
    body = F.coalesce(text, F.lit(""))
    # a run starts where none of its characters stands before, so the search passes on at once inside words
    tokens = F.regexp_extract_all(body, F.lit(rf"(?<!{ENTROPY_TOKEN.removesuffix('{20,}')}){ENTROPY_TOKEN}"), F.lit(0))
    none = F.array().cast("array<string>")
    lower = F.lower(body)
    # what a match of a dear pattern can't be without, found by plain search
    needs = {
        "aws_secret": F.exists(tokens, lambda t: F.length(t) >= 40),
        "connection_string": body.contains("://"),
        "generic_key": reduce(lambda a, w: a | lower.contains(w), KEY_WORDS[1:], lower.contains(KEY_WORDS[0])),
    }
    named = []
    for kind, (pattern, group) in SECRETS.items():
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
        named.append(F.transform(F.when(needs[kind], found).otherwise(none) if kind in needs else found, _named(kind)))
    # as many distinct characters as the threshold asks for come before the sum over them
    enough = lambda t: F.size(F.array_distinct(F.split(t, ""))) >= 2**ENTROPY_THRESHOLD
    dense = F.filter(tokens, lambda t: F.when(enough(t), entropy(t) >= ENTROPY_THRESHOLD).otherwise(False))
    return F.aggregate(
        dense,
        F.concat(*named),
        lambda found, t: F.when(F.exists(found, lambda s: s["match"].contains(t)), found).otherwise(
            F.array_append(found, _named("high_entropy")(t))
        ),
    )


def secret_matches(store: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, place, kind, match) of every secret; exploding it, unlike a filter on it, makes ``secrets`` once."""
    return store.select(key, F.posexplode(secrets(F.col(text))).alias("place", "s")).select(key, "place", "s.kind", "s.match")


def secret_kinds(store: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, kinds, secrets) of the rows that hold secrets: their kinds, each once in order, and how many there are."""
    found = secret_matches(store, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "kind"))).alias("f"))
    return found.select(key, F.array_join(F.array_distinct(F.transform("f", lambda s: s["kind"])), ",").alias("kinds"), F.size("f").cast("long").alias("secrets"))


def redacted(text: Column, found: Column) -> Column:
    """struct<text, count>: the matches of ``secrets`` replaced, the longest first; count of matches that were still there."""
    by_length = F.array_sort(F.transform(found, lambda s, i: F.struct((-F.length(s["match"])).alias("n"), i.alias("i"), s["match"].alias("match"))))
    return F.aggregate(
        by_length,
        F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).cast("long").alias("count")),
        lambda r, s: F.struct(
            F.replace(r["text"], s["match"], F.lit(PLACEHOLDER)).alias("text"),
            (r["count"] + r["text"].contains(s["match"]).cast("long")).alias("count"),
        ),
    )


def redact_rows(store: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its secrets replaced and how many were (``redactions``); rows without secrets as they are."""
    found = store.withColumn("_found", secrets(F.col(text))).withColumn("_clean", F.when(F.size("_found") > 0, redacted(F.col(text), F.col("_found"))))
    return found.withColumn(text, F.coalesce("_clean.text", text)).withColumn("redactions", F.coalesce("_clean.count", F.lit(0).cast("long"))).drop("_found", "_clean")


def content_key(text: Column) -> Column:
    """Equal for texts that differ in white space only."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", " ")))


def duplicates(store: DataFrame) -> DataFrame:
    """Rows that repeat the content of an earlier row of their kind and project, with the id that stays.

    The first row of a group is found by an aggregate that combines before the shuffle; groups of any size
    are joined back by key, so none has to be sorted in one task.
    """
    keyed = store.select("id", "kind", "project", "created_at", content_key(F.col("text")).alias("content_key"))
    by = ["kind", "project", "content_key"]
    first = keyed.groupBy(*by).agg(F.min(F.struct("created_at", "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = reduce(lambda a, c: a & F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")), by, F.lit(True))
    return (
        keyed.alias("k").join(first.alias("f"), same).where(F.col("k.id") != F.col("f.first.id"))
        .select("k.id", F.col("f.first.id").alias("kept_id"), "k.kind", "k.project")
    )


def noise_rows(store: DataFrame) -> DataFrame:
    """Session chunks that a filter added later would not have let in."""
    return store.where(F.col("kind") == "session_chunk").where(is_harness(F.col("text"))).select("id", "project")


def prune_report(store: DataFrame) -> DataFrame:
    """Counts of what a prune would retire: noise, and duplicates that are no noise."""
    noise = noise_rows(store).select("id")
    copies = duplicates(store).select("id").join(noise, "id", "left_anti")
    total = store.agg(F.count("*").alias("active"))
    counts = noise.agg(F.count("*").alias("noise")).join(copies.agg(F.count("*").alias("duplicates")))
    return total.join(counts).select(
        "active", "noise", "duplicates",
        F.round(100.0 * (F.col("noise") + F.col("duplicates")) / F.greatest(F.col("active"), F.lit(1)), 3).alias("retired_pct"),
    )


def split_at_headings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Markdown sections: a heading opens a section and stays with its body; blank sections go."""
    parts = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"(?m)(?=^#{1,6} )"))
    split = rows.select(key, parts.alias("_at", "_part")).select(key, "_at", F.trim("_part").alias("section")).where("section <> ''")
    return split.select(
        key, F.col("_at").cast("long").alias("place"), F.substring(F.sha1("section"), 1, 8).alias("digest"), "section",
        F.greatest(F.lit(1), F.floor(F.length("section") / 4)).cast("long").alias("token_count"),
    )


#: What counts as identifier, path, question and error in a query, and queries that need no context.
#: Edges of words are those of ASCII, as ``\w`` is: what ``\b`` takes for a letter differs between Java versions.
IDENTIFIER = r"[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+|[A-Z]{2,}|(?<!\w)\w+\.\w+\.\w+|\w+::\w+"
QUERY_PATH = r"[a-zA-Z0-9_\-]+/|\.\w{1,5}(?!\w)"
ERROR_WORD = r"(?i)(Error|Exception|Traceback|FAIL|panic|segfault|undefined|NaN|null|nil)(?!\w)"
TRIVIAL = (
    "yes", "no", "ok", "okay", "sure", "thanks", "thank you", "ty", "looks good", "lgtm", "continue", "go ahead", "do it", "proceed",
    "correct", "right", "yep", "yup", "nope", "agreed", "sounds good", "perfect", "great", "nice", "cool", "done", "got it", "k",
    "yes please", "no thanks",
)
#: Fixed values: (name, below which complexity, memories, tokens) of the tiers.
TIERS = (("skip", 0.05, 0, 0), ("light", 0.45, 4, 500), ("full", None, 8, 1500))


def complexity(query: Column) -> Column:
    """0 to 1 from length, identifiers, paths, a question mark at the end and error words; 0 for trivial phrases."""
    text = F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", "")
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("double")
    count = lambda p: F.regexp_count(text, F.lit(p))
    raw = (
        0.45 * n * n / (n * n + 36) + 0.2 * F.least(count(IDENTIFIER) / 3, F.lit(1.0)) + 0.2 * F.least(count(QUERY_PATH) / 2, F.lit(1.0))
        + F.when(text.endswith("?"), 0.1).otherwise(0.0) + F.when(text.rlike(ERROR_WORD), 0.15).otherwise(0.0)
    )
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"[?!.,]+$", ""), r"\s+$", ""))
    return F.when((text == "") | plain.isin(*TRIVIAL), 0.0).otherwise(F.round(F.least(raw, F.lit(1.0)), 9))


def route(score: Column) -> Column:
    """struct<tier, k, max_tokens> of a complexity."""
    tier = lambda t: F.struct(F.lit(t[0]).alias("tier"), F.lit(t[2]).alias("k"), F.lit(t[3]).alias("max_tokens"))
    return F.when(score < TIERS[0][1], tier(TIERS[0])).when(score < TIERS[1][1], tier(TIERS[1])).otherwise(tier(TIERS[2]))


#: A term of a chunk, its filler and its signal, and the least tokens of a chunk worth keeping.
CHUNK_TERM = r"[a-zA-Z_][a-zA-Z0-9_]{2,}"
CHUNK_FILLER = r"(?i)^(Let me |Now let me |Now I|Good[,.]|Great[,.]|Perfect[!,.]|Done[!,.]|Sure[,.]|OK[,.]|Alright|Looking at |Checking |I'll )"
CHUNK_SIGNAL = r"(?i)(we decided|the fix is|the solution|use .+ instead of|should always|never use|important:|note:|bug:|pattern:|architecture:)"
MIN_CHUNK = 15


def chunk_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CHUNK_TERM), F.lit(0))


def heuristic_score(text: Column, role: Column, tokens: Column) -> Column:
    """Bonus and penalty of a chunk; -1 for chunks that are too short."""
    add = lambda test, v: F.when(test, v).otherwise(0.0)
    score = (
        add(text.rlike(CHUNK_FILLER), -0.5) + add(text.rlike(CHUNK_SIGNAL), 1.0) + add((role == "user") & (tokens > 20), 0.3)
        + add((role == "assistant") & (tokens > 100), 0.5) + add(text.contains("```"), 0.2)
    )
    return F.when(tokens < MIN_CHUNK, -1.0).otherwise(score)


def tfidf_scores(rows: DataFrame, terms: Column) -> DataFrame:
    """(session_id, id) -> sum of tf / length * ln((n + 1) / (df + 1)) over the session's rows.

    Documents without terms score 0. Terms are counted before the shuffle; a session of any size spreads over
    its terms.
    """
    split = rows.select("session_id", "id", terms.alias("t"))
    n = split.groupBy("session_id").agg(F.count("*").alias("n"))
    tf = split.select("session_id", "id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("session_id", "id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("session_id", "term").agg(F.count("*").alias("df"))
    part = F.col("tf") / F.col("length") * F.log((F.col("n") + 1) / (F.col("df") + 1))
    scored = tf.join(df, ["session_id", "term"]).join(n, "session_id").groupBy("session_id", "id").agg(F.sum(part).alias("s"))
    return split.select("session_id", "id").join(scored, ["session_id", "id"], "left").select("session_id", "id", F.round(F.coalesce("s", F.lit(0.0)), 9).alias("tfidf"))


def evict(blobs: DataFrame, as_of: str, ttl_seconds: int, cap_bytes: int) -> DataFrame:
    """Blobs (id, created_at, byte_len) that stay: within their time to live, newest first up to the cap.

    Totals per day come first, so that only the days' table is summed in order; inside a day rows go by time.
    """
    alive = blobs.where(F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("created_at") <= ttl_seconds)
    alive = alive.withColumn("_day", F.to_date("created_at"))
    newer = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = alive.groupBy("_day").agg(F.sum("byte_len").alias("_bytes")).withColumn("_before", F.coalesce(F.sum("_bytes").over(newer), F.lit(0)))
    inside = Window.partitionBy("_day").orderBy(F.col("created_at").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = alive.withColumn("_in", F.sum("byte_len").over(inside)).join(days.select("_day", "_before"), "_day")
    return held.where(F.col("_before") + F.col("_in") <= cap_bytes).select("id", "byte_len")


def reuse(pairs: DataFrame, source: str = "source", answer: str = "answer", share: float = 0.1) -> DataFrame:
    """Whether an answer reuses a source: enough of the source's word trigrams stand in it (fewer than 4 words: no)."""
    w = F.filter(F.split(F.lower(F.col(source)), r"\s+"), lambda x: x != "")
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.array_join(F.slice("_w", i, 3), " "))
    said = F.regexp_replace(F.lower(F.col(answer)), r"\s+", " ")
    rows = pairs.withColumn("_w", w).withColumn("_said", said)
    found = F.size(F.filter(grams, lambda g: F.col("_said").contains(g)))
    need = F.greatest(F.lit(1), F.ceil(share * (F.size("_w") - 2)))
    return rows.withColumn("reused", F.when(F.size("_w") < 4, False).otherwise(found >= need)).drop("_w", "_said")


def chunk_scores(rows: DataFrame) -> DataFrame:
    """(session_id, id, score): TF-IDF over the session's largest plus the heuristic; -999 for chunks that are too short."""
    tfidf = tfidf_scores(rows, chunk_terms(F.col("text")))
    top = tfidf.groupBy("session_id").agg(F.max("tfidf").alias("top"))
    beside = rows.select("session_id", "id", heuristic_score(F.col("text"), F.col("role"), F.col("token_count")).alias("h"))
    best = F.when(F.col("top") != 0, F.col("top")).otherwise(1.0)
    return beside.join(tfidf, ["session_id", "id"]).join(top, "session_id").select(
        "session_id", "id", F.when(F.col("h") <= -1.0, -999.0).otherwise(F.round(F.col("tfidf") / best + F.col("h"), 6)).alias("score")
    )
