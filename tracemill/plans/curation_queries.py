"""Registered queries over curation of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import curation as C
from tracemill.plans import bindings as B


def _redacted(s, d):
    rows = C.redact_rows(B.artifacts(s, d).select("id", "text"))
    return rows.select("id", F.sha2("text", 256).alias("redacted_sha256"), "redactions")


def _routing(s, d):
    score = C.complexity(F.col("text"))
    return B.chunks(s, d).where("role = 'user'").select("id", score.alias("complexity"), C.route(score).alias("r")).select("id", "complexity", "r.*")


def _blobs(s, d):
    return B.artifacts(s, d).select("id", "created_at", F.octet_length("text").cast("long").alias("byte_len"))


def _reuse(s, d):
    c = B.chunks(s, d)
    asked = c.where("role = 'user'").select("session_id", F.col("ord").alias("_o"), F.col("text").alias("source"))
    said = c.where("role = 'assistant'").select("id", "session_id", (F.col("ord") - 1).alias("_o"), F.col("text").alias("answer"))
    return C.reuse(said.join(asked, ["session_id", "_o"])).select("id", "reused")


QUERIES = {
    "artifacts_from_conversations": lambda s, d: B.chunks(s, d).select("id", "kind", "project", "session_id", "ord", "role", "token_count", "created_at"),
    "document_split": lambda s, d: C.split_at_headings(B.table(s, d, "documents"), "doc_id").select("doc_id", "place", "digest", "token_count"),
    "content_dedup": lambda s, d: C.duplicates(B.artifacts(s, d)),
    "noise_scan": lambda s, d: C.noise_rows(B.chunks(s, d)),
    "prune_report": lambda s, d: C.prune_report(B.artifacts(s, d)),
    "secret_scan": lambda s, d: C.secret_kinds(B.artifacts(s, d)),
    "redact_documents": _redacted,
    "query_routing": _routing,
    "chunk_classify": lambda s, d: B.artifacts(s, d).select("id", C.classify(F.col("text")).alias("class")),
    "chunk_signal": lambda s, d: B.chunks(s, d).select("id", C.signal(F.col("text"), F.col("role"), F.col("token_count")).alias("signal")),
    "tfidf_scores": lambda s, d: C.tfidf_scores(B.chunks(s, d), C.chunk_terms(F.col("text"))),
    "chunk_scores": lambda s, d: C.chunk_scores(B.chunks(s, d)),
    "blob_evict": lambda s, d: C.evict(_blobs(s, d), B.AS_OF, 30 * 86400, 1_000_000),
    "feedback_ngram": _reuse,
}


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: The rules of the engine's tables, written for DuckDB; its patterns know no comments, look-around or possessive forms.
_CUES = {
    "bugfix": "(?i)(the fix is|root cause|the bug was|the issue was|caused by|the problem is|this fails because|the error occurs)",
    "decision": "(?i)(we decided|the approach is|instead of|switched to|chose .+ over|trade-?off|architecture:|design decision)",
    "lesson": "(?i)(always use|never use|never do|important:|note:|pattern:|best practice|lesson learned|rule of thumb|should always|should never)",
}
_HARNESS = r"(regexp_matches(text, '(?i)^\s*(\[Request interrupted|\[Tool use was (rejected|cancelled)|API Error|\[\w+:ccr:|<local-command-(stdout|caveat)|Caveat: The messages below were generated|\[The user (sent|interrupted))') OR regexp_matches(text, '(?i)^\s*#{1,3}\s+.*\((voter|reviewer|verifier|judge|agent)\s*\d+\s*/\s*\d+\)'))"
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"
NOISE_SQL = rf"""(token_count < 8 OR contains(text, 'Base directory for this skill') OR {_HARNESS} OR regexp_matches(text, '[A-Za-z0-9+/=]{{200,}}')
  OR regexp_matches(text, '(?i)^(Allow |Permission |Do you want to allow |Grant )')
  OR (len({_LINES}) >= 2 AND len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^[/~][\w./\-]+$'))) = 0)
  OR (token_count < 30 AND regexp_matches(text, '(?i)^(Let me |Now let me |Now I|I''ll |I will |Good[,.]|Great[,.]|Perfect[!,.]|Done[!,.]|Alright|Sure[,.]|OK[,.]|Moving to |Looking at |Checking )')))"""
CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN '{k}'" for k, p in _CUES.items()) + " WHEN contains(text, '```') AND length(text) > 200 THEN 'snippet' ELSE 'extract' END"
CUE_SQL = " + ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN 2.0::DOUBLE ELSE 0.0 END" for p in _CUES.values())
_SECRET_SQL = (
    ("aws_key", "AKIA[0-9A-Z]{16}", 0), ("aws_secret", r'((?:aws.{0,20})?[0-9a-zA-Z/+]{40})(?:\s|$|")', 1), ("openai_key", "sk-[a-zA-Z0-9_-]{20,}", 0),
    ("anthropic_key", "sk-ant-[a-zA-Z0-9_-]{20,}", 0), ("github_token", "gh[ps]_[A-Za-z0-9_]{36,}", 0), ("github_fine", "github_pat_[A-Za-z0-9_]{20,}", 0),
    ("stripe_key", "[sr]k_(?:live|test)_[A-Za-z0-9]{20,}", 0), ("slack_token", r"xox[bpras]-[A-Za-z0-9\-]{10,}", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0), ("pem", "(?s)-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", 0),
    ("connection_string", r"""(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|sqlite)://[^\s"'`]{10,}""", 0),
    ("env_assignment", r"(?m)^[A-Z_]{2,50}(?:_KEY|_SECRET|_TOKEN|_PASSWORD|_PASS|_API|_CREDENTIAL)[=:]\s*\S+", 0),
    ("generic_key", r"""(?i)(?:key|token|secret|password|apikey|api_key)["']?\s*[=:]\s*['"]?([^\s'"]{8,})""", 1),
)
_MATCHES = " || ".join(f"list_transform(regexp_extract_all(text, {_q(p)}, {g}), lambda m: {{'kind': '{k}', 'match': m}})" for k, p, g in _SECRET_SQL)
#: Per artifact: all matches in order; tokens of high entropy in order, less those that a match or an earlier token holds.
_FOUND = rf"""named AS (SELECT id, text, {_MATCHES} AS named FROM artifacts),
tokens AS (SELECT id, named, i, toks[i] AS t FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM
  (SELECT id, named, regexp_extract_all(text, '[A-Za-z0-9_/+\-]{{20,}}') AS toks FROM named))),
bits AS (SELECT id, i, -sum(n / total * log2(n / total)) AS h FROM (SELECT id, i, count(*)::DOUBLE AS n, any_value(length(t))::DOUBLE AS total
  FROM (SELECT id, i, t, unnest(string_split(t, '')) AS c FROM tokens) WHERE c <> '' GROUP BY id, i, c) GROUP BY id, i),
dense AS (SELECT tokens.* FROM tokens JOIN bits USING (id, i) WHERE h >= 4.0 AND len(list_filter(named, lambda s: contains(s.match, t))) = 0),
fresh AS (SELECT id, i, t FROM dense d WHERE NOT EXISTS (SELECT 1 FROM dense e WHERE e.id = d.id AND e.i < d.i AND contains(e.t, d.t))),
extra AS (SELECT id, list({{'kind': 'high_entropy', 'match': t}} ORDER BY i) AS more FROM fresh GROUP BY id),
found AS (SELECT id, text, named || coalesce(more, []) AS found FROM named LEFT JOIN extra USING (id))"""
_TERMS = "regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]{2,}')"
_TFIDF = f"""st AS (SELECT session_id, id, {_TERMS} AS t FROM chunks),
n AS (SELECT session_id, count(*) AS n FROM st GROUP BY session_id),
tf AS (SELECT session_id, id, length, term, count(*) AS tf FROM (SELECT session_id, id, len(t) AS length, unnest(t) AS term FROM st) GROUP BY ALL),
df AS (SELECT session_id, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT id, sum(tf / length::DOUBLE * ln((n + 1) / (df + 1)::DOUBLE)) AS s FROM tf JOIN df USING (session_id, term) JOIN n USING (session_id) GROUP BY id),
scored AS (SELECT session_id, id, round(coalesce(s, 0.0), 9) AS tfidf FROM st LEFT JOIN sc USING (id))"""
_DUPES = r"""keyed AS (SELECT id, kind, project, created_at, md5(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'))) AS k FROM artifacts),
dupes AS (SELECT id, first_value(id) OVER w AS kept_id, kind, project FROM keyed
          WINDOW w AS (PARTITION BY kind, project, k ORDER BY created_at, id) QUALIFY row_number() OVER w > 1)"""

ORACLE_SQL = {
    "artifacts_from_conversations": B.with_tables("chunks", "SELECT id, kind, project, session_id, ord, role, token_count, created_at FROM chunks"),
    "document_split": r"""SELECT doc_id, place, substring(sha1(section), 1, 8) AS digest, greatest(1, length(section) // 4) AS token_count FROM (
  SELECT doc_id, place - 1 AS place, trim(parts[place]) AS section FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS place FROM (
  SELECT doc_id, string_split(CASE WHEN marked[1] = chr(1) THEN marked[2:] ELSE marked END, chr(1)) AS parts FROM (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^(#{1,6} )', chr(1) || '\1', 'g') AS marked FROM documents))))
WHERE section <> ''""",
    "content_dedup": B.with_tables("chunks notes artifacts", f", {_DUPES} SELECT * FROM dupes"),
    "noise_scan": B.with_tables("chunks", f"SELECT id, project FROM chunks WHERE {_HARNESS}"),
    "prune_report": B.with_tables("chunks notes artifacts", f""", {_DUPES}, noise AS (SELECT id FROM artifacts WHERE kind = 'session_chunk' AND {_HARNESS}),
counts AS (SELECT (SELECT count(*) FROM artifacts) AS active, (SELECT count(*) FROM noise) AS noise,
  (SELECT count(*) FROM dupes WHERE id NOT IN (SELECT id FROM noise)) AS duplicates)
SELECT *, round(100.0::DOUBLE * (noise + duplicates) / greatest(active, 1), 3) AS retired_pct FROM counts"""),
    "secret_scan": "WITH RECURSIVE " + B.with_tables("chunks notes artifacts", f""", {_FOUND}
SELECT id, array_to_string(list_transform(list_filter(range(1, len(k) + 1), lambda i: list_position(k, k[i]) = i), lambda i: k[i]), ',') AS kinds, len(k) AS secrets
FROM (SELECT id, list_transform(found, lambda s: s.kind) AS k FROM found) WHERE len(k) > 0""").removeprefix("WITH "),
    "redact_documents": "WITH RECURSIVE " + B.with_tables("chunks notes artifacts", f""", {_FOUND},
ranked AS (SELECT id, s.match AS m, row_number() OVER (PARTITION BY id ORDER BY length(s.match) DESC, i) AS k
  FROM (SELECT id, i, found[i] AS s FROM (SELECT id, found, unnest(range(1, len(found) + 1)) AS i FROM found))),
steps AS (SELECT id, text, 0 AS k, 0 AS redactions FROM found
  UNION ALL SELECT s.id, replace(s.text, m, '[REDACTED]'), s.k + 1, redactions + contains(s.text, m)::INT FROM steps s JOIN ranked r ON r.id = s.id AND r.k = s.k + 1)
SELECT id, sha256(max_by(text, k)) AS redacted_sha256, max_by(redactions, k) AS redactions FROM steps GROUP BY id""").removeprefix("WITH "),
    "query_routing": B.with_tables("chunks", r""", q AS (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM chunks WHERE role = 'user'),
m AS (SELECT id, t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))::DOUBLE AS n,
  len(regexp_extract_all(t, '[A-Z][a-z]+[A-Z]|[a-z]+_[a-z]+|[A-Z]{2,}|\b\w+\.\w+\.\w+|\w+::\w+')) AS ids, len(regexp_extract_all(t, '[a-zA-Z0-9_\-]+/|\.\w{1,5}\b')) AS paths,
  lower(rtrim(rtrim(t, '?!.,'))) IN ('yes', 'no', 'ok', 'okay', 'sure', 'thanks', 'thank you', 'ty', 'looks good', 'lgtm', 'continue', 'go ahead', 'do it', 'proceed',
    'correct', 'right', 'yep', 'yup', 'nope', 'agreed', 'sounds good', 'perfect', 'great', 'nice', 'cool', 'done', 'got it', 'k', 'yes please', 'no thanks') AS trivial FROM q),
c AS (SELECT id, CASE WHEN t = '' OR trivial THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.45::DOUBLE * n * n / (n * n + 36) + 0.2::DOUBLE * least(ids / 3.0::DOUBLE, 1.0)
  + 0.2::DOUBLE * least(paths / 2.0::DOUBLE, 1.0) + CASE WHEN ends_with(t, '?') THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN regexp_matches(t, '(?i)(Error|Exception|Traceback|FAIL|panic|segfault|undefined|NaN|null|nil)\b') THEN 0.15::DOUBLE ELSE 0.0 END), 9) END AS complexity FROM m)
SELECT id, complexity, CASE WHEN complexity < 0.05 THEN 'skip' WHEN complexity < 0.45 THEN 'light' ELSE 'full' END AS tier,
  CASE WHEN complexity < 0.05 THEN 0 WHEN complexity < 0.45 THEN 4 ELSE 8 END AS k, CASE WHEN complexity < 0.05 THEN 0 WHEN complexity < 0.45 THEN 500 ELSE 1500 END AS max_tokens FROM c"""),
    "chunk_classify": B.with_tables("chunks notes artifacts", f"SELECT id, {CLASS_SQL} AS class FROM artifacts"),
    "chunk_signal": B.with_tables("chunks", f""", s AS (SELECT *, {CUE_SQL} + CASE WHEN contains(text, '```') AND token_count >= 40 THEN 1.0::DOUBLE ELSE 0.0 END AS cues FROM chunks)
SELECT id, CASE WHEN {NOISE_SQL} THEN 0.0::DOUBLE WHEN role = 'user' THEN CASE WHEN token_count >= 6 THEN 1.0::DOUBLE ELSE 0.0 END WHEN role <> 'assistant' THEN 0.0
  WHEN cues = 0 AND token_count >= 100 THEN 0.5::DOUBLE ELSE cues END AS signal FROM s"""),
    "tfidf_scores": B.with_tables("chunks", f""", {_TFIDF} SELECT * FROM scored"""),
    "chunk_scores": B.with_tables("chunks", f""", {_TFIDF},
h AS (SELECT session_id, id, CASE WHEN token_count < 15 THEN -1.0::DOUBLE ELSE
  CASE WHEN regexp_matches(text, '(?i)^(Let me |Now let me |Now I|Good[,.]|Great[,.]|Perfect[!,.]|Done[!,.]|Sure[,.]|OK[,.]|Alright|Looking at |Checking |I''ll )') THEN -0.5::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?i)(we decided|the fix is|the solution|use .+ instead of|should always|never use|important:|note:|bug:|pattern:|architecture:)') THEN 1.0::DOUBLE ELSE 0 END
  + CASE WHEN role = 'user' AND token_count > 20 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN role = 'assistant' AND token_count > 100 THEN 0.5::DOUBLE ELSE 0 END
  + CASE WHEN contains(text, '```') THEN 0.2::DOUBLE ELSE 0 END END AS h FROM chunks),
top AS (SELECT session_id, CASE WHEN max(tfidf) <> 0 THEN max(tfidf) ELSE 1.0 END AS top FROM scored GROUP BY 1)
SELECT session_id, id, CASE WHEN h <= -1.0 THEN -999.0 ELSE round(tfidf / top + h, 6) END AS score FROM scored JOIN h USING (session_id, id) JOIN top USING (session_id)"""),
    "blob_evict": B.with_tables("chunks notes artifacts", f"""SELECT id, byte_len FROM (
  SELECT id, byte_len, sum(byte_len) OVER (ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS held
  FROM (SELECT id, created_at, strlen(text) AS byte_len FROM artifacts WHERE epoch(TIMESTAMP '{B.AS_OF}' - created_at) <= {30 * 86400}))
WHERE held <= 1000000"""),
    "feedback_ngram": B.with_tables("chunks", r""", p AS (SELECT a.id, list_filter(regexp_split_to_array(lower(u.text), '\s+'), lambda x: x <> '') AS w,
  regexp_replace(lower(a.text), '\s+', ' ', 'g') AS said
  FROM chunks a JOIN chunks u ON u.session_id = a.session_id AND u.ord = a.ord - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
g AS (SELECT id, len(w) AS n, len(list_filter(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')), lambda x: contains(said, x))) AS found FROM p)
SELECT id, CASE WHEN n < 4 THEN false ELSE found >= greatest(1, ceil(0.1 * (n - 2))) END AS reused FROM g"""),
}
