"""Personal data: rules for what their format proves, boosted trees for what context decides.

Strict rules find emails, IP addresses, cards and phone numbers. Beside them, generators of high recall propose
spans that may overlap (secrets, account and identity numbers, phones and emails in looser forms); boosted
trees judge each from its format and its surroundings, and a threshold per kind, set on candidates that the
trees did not see, selects what is redacted. The trees are trained here on candidates written from a seed, so
the model does not depend on the corpus.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.workspace import Shipped, bound_arrow_batches
from tracemill.llm.boosting import Boosted, calibrate, fit_boosted
from tracemill.llm.text import keyed

#: The strict kinds, in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that the model adds, listed after them.
MODEL_KINDS = ("secret", "ssn", "iban", "phone_local", "email_spelled", "mac")

#: The strict formats. Possessive quantifiers and anchors keep them linear, with the same matches.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the strict formats prove, by start and kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 38 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_only_digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: What proposes candidates of each further kind; keys may lack digits, the others never do.
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])")
GENERATORS = (
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Za-z0-9])")),
    ("phone_local", re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")),
)
_SPELLED = re.compile(r"[A-Za-z0-9._-]{2,64} ?[\[({]? ?(?:at|AT) ?[\])}]? ?[A-Za-z0-9-]{2,63} ?[\[({]? ?(?:dot|DOT) ?[\])}]? ?[A-Za-z]{2,10}(?![A-Za-z])")

#: Words near a candidate that speak for its kind, and words that speak against any.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "api", "key", "auth", "bearer", "credential"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "tel", "call", "fax", "mobile", "cell", "contact"),
    "email_spelled": ("mail", "contact", "write", "reach"),
    "mac": ("mac", "ethernet", "device", "address"),
}
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "isbn", "version", "build", "uuid", "order", "sku", "part", "ref", "page")
CONTEXT = 40
#: How keys of well-known services begin.
_KNOWN_KEY = re.compile(r"sk-|[sr]k_(?:live|test)_|gh[opsu]_|github_pat_|xox[abprs]-|AKIA[0-9A-Z]|AIza|glpat-|eyJ[A-Za-z0-9]")
_CUE_WORD = re.compile(r"[A-Za-z0-9]+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals; they may overlap."""
    found = [("secret", *m.span()) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        found += [(kind, *m.span()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]
    if "dot" in text or "DOT" in text:
        found += [("email_spelled", *m.span()) for m in _SPELLED.finditer(text)]
    return found


def _entropy(text: str) -> float:
    n = len(text)
    return -sum((c := text.count(x)) / n * math.log2(c / n) for x in set(text)) if n else 0.0


def _iban(text: str) -> bool:
    flat = text.replace(" ", "")
    moved = flat[4:] + flat[:4]
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = [w.lower() for w in _CUE_WORD.findall(before)][-4:] + [w.lower() for w in _CUE_WORD.findall(after)][:2]
    mark = before.rstrip()[-1:] if before else ""
    return [
        *(float(kind == k) for k in MODEL_KINDS),
        n,
        digits / n,
        sum(c.isupper() for c in span) / n,
        sum(c.islower() for c in span) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in span)),
        _entropy(span),
        float(any(any(w.startswith(c) for c in CUES[kind]) for w in near)),
        float(any(w in AGAINST for w in near)),
        float(mark in ("=", ":", '"', "'")),
        float(before[-1:] in ('"', "'", "`")),
        float(after[:1] in ('"', "'", "`")),
        float(kind == "iban" and _iban(span)),
        float(kind == "ssn" and span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00"),
        float(any(c in span for c in "[]{}()")),
        float(kind == "secret" and bool(_KNOWN_KEY.match(span))),
        float(kind == "email_spelled" and span.rpartition(" ")[2].lower().endswith(DOMAIN_ENDS)),
        float("-" in span),
        float("/" in span),
    ]


@dataclass
class PiiModel:
    trees: Boosted
    thresholds: dict[str, float]

    def select(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """Model spans that overlap neither ``taken`` nor each other; the likelier candidate wins."""
        proposed = candidates(text)
        if not proposed:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in proposed]))
        ranked = sorted((-float(s), a, b, k) for (k, a, b), s in zip(proposed, p, strict=True) if s >= self.thresholds[k])
        chosen: list[tuple[str, int, int, float]] = []
        held = _disjoint(sorted((a, b) for _, a, b in taken))
        for s, a, b, k in ranked:
            at = bisect_left(held, (b,))  # the spans before begin before this one ends
            if at == 0 or held[at - 1][1] <= a:
                insort(held, (a, b))
                chosen.append((k, a, b, -s))
        return chosen


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _training_text(r: random.Random) -> tuple[str, str, int, int, int]:
    """A written sentence with one candidate: (text, kind, start, end, label)."""
    word = lambda: "".join(r.choice("aeioulrstnmdhc") for _ in range(r.randint(2, 9)))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n - 1)) + r.choice(string.digits)
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    good = r.random() < 0.5
    kind = r.choice(("secret", "secret", *MODEL_KINDS))
    cue = r.choice(CUES[kind])
    if kind == "secret":
        letters = lambda n, of: "".join(r.choice(of) for _ in range(n))
        body = r.choice((hexes(r.choice((32, 40, 64, 128, 256))), mixed(r.randint(20, 64)), mixed(r.randint(65, 1000)), letters(r.randint(16, 40), string.ascii_letters), letters(r.randint(16, 30), string.ascii_lowercase)))
        if good:
            head = r.choice((f'{cue} = "', f"{cue}: ", f"{cue}='", f'"{cue}": "', f"{word()}_{cue}={''}", f"{cue} "))
        else:
            body = r.choice((body, f"{word()}-{word()}-{digits(4)}-{word()}", f"{word()}/{word()}/{word()}{digits(2)}/{word()}", digits(r.randint(16, 24)), f"{word()}_{word()}_{word()}_{digits(3)}", f"{word()}{word()}{word()}{word()}{word()}{word()}{word()}{word()}"[:40], f"{word()}-{word()}-{word()}-{word()}-{word()}-{word()}-{word()}-{word()}", f"/{word()}/{word()}/{word()}/{word()}/{word()}/{word()}/{word()}/{word()}"))
            head = r.choice((f"{r.choice(AGAINST)} ", f"{word()} ", f"{r.choice(AGAINST)}: ", f"{word()} {word()} "))
    elif kind == "ssn":
        body = f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{digits(4)}"
        head = r.choice((f"{cue} ", f"{cue} number: ", f"{cue} no. ")) if good else r.choice((f"{r.choice(AGAINST)} ", f"{word()} ", f"{r.choice(AGAINST)} no. "))
    elif kind == "iban":
        country, account = r.choice(("DE", "FR", "ES", "GB", "NO")), digits(r.choice((11, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        body = f"{country}{check:02d}{account}" if good else f"{r.choice(('AB', 'XQ', 'LM', country))}{digits(2)}{digits(len(account))}"
        if r.random() < 0.5:
            body = " ".join(body[k : k + 4] for k in range(0, len(body), 4))
        head = r.choice((f"{cue} ", f"{word()} ", f"{cue}: "))
    elif kind == "phone_local":
        sep = r.choice("-. ")
        body = f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}" if r.random() < 0.5 else f"({digits(3)}) {digits(3)}-{digits(4)}"
        head = r.choice((f"{cue} ", f"{cue}: ", f"{cue} me at ")) if good else r.choice((f"{r.choice(AGAINST)} ", f"{word()} ", "= ", f"{digits(3)} "))
    elif kind == "email_spelled":
        if good:
            a, d = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT "), (" at ", " dot ")))
            body = f"{word()}{r.choice(('', '.' + word()))}{a}{word()}{d}{r.choice(('com', 'org', 'net', 'de', 'fr'))}"
            head = r.choice((f"{cue} ", f"{cue}: ", f"{word()} "))
        else:
            body = f"{word()} at {word()} dot {r.choice((word() + 'ing', word(), 'dot'))}"
            head = f"{word()} "
    else:
        sep = r.choice(":-")
        body = sep.join(hexes(2) for _ in range(6))
        head = r.choice((f"{cue} ", f"{cue}: ")) if good else r.choice((f"{word()} ", f"{r.choice(AGAINST)} "))
    if kind == "secret" and good and r.random() < 0.25:
        start = r.choice(("sk-", "sk_live_", "rk_test_", "ghp_", "github_pat_", "xoxb-", "AKIA", "AIza", "glpat-", "eyJ"))
        body = start + (mixed(16).upper() if start == "AKIA" else mixed(r.randint(20, 60)))
        head = r.choice((head, f"{word()} ", ""))
    # what surrounds a candidate does not always tell
    if good and kind != "email_spelled" and r.random() < 0.12:
        head = f"{word()} "
    elif not good and kind != "email_spelled" and r.random() < 0.05:
        head = f"{cue} "
    lead = " ".join(word() for _ in range(r.randint(0, 5)))
    text = f"{lead} {head}{body}"
    start = len(text) - len(body)
    tail = r.choice(('"', "'", "")) if good and kind == "secret" and text[start - 1 : start] in "\"'" else ""
    return f"{text}{tail} {word()} {word()}", kind, start, start + len(body), int(good)


@lru_cache(maxsize=4)
def train_pii_model(rows: int = 8000, seed: int = 11, precision: float = 0.96) -> PiiModel:
    """Trees on two thirds of written candidates; calibration and thresholds on the last third.

    A kind's threshold is the lowest score from which on its candidates were right at ``precision``: it lies
    below one half for kinds whose doubtful candidates mostly are right, and above for the others.
    """
    r = random.Random(seed)
    made = [_training_text(r) for _ in range(rows)]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in made])
    y = np.array([m[4] for m in made], dtype=float)
    cut = rows * 2 // 3
    model = fit_boosted(x[:cut], y[:cut])
    calibrate(model, x[cut:], y[cut:])
    p, thresholds = model.probability(x[cut:]), {}
    for kind in MODEL_KINDS:
        mine = np.array([m[1] == kind for m in made[cut:]])
        order = np.argsort(-p[mine], kind="stable")
        right = np.cumsum(y[cut:][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= precision)
        lowest = float(p[mine][order][good[-1]]) if len(good) else 1.1
        thresholds[kind] = max(0.1, lowest)
    return PiiModel(model, thresholds)


def find_spans(text: str | None, model: PiiModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(strict spans, model spans) of one text, in code points."""
    if not text:
        return [], []
    strict = strict_spans(text)
    return strict, model.select(text, strict)


SPANS = "array<struct<kind:string,start:long,end:long,score:double,strict:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("strict", pa.bool_())]))


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                strict, more = find_spans(text.as_py(), model.value)
                spans = [(k, a, b, 1.0, True) for k, a, b in strict] + [(*s, False) for s in more]
                rows.append([dict(zip(("kind", "start", "end", "score", "strict"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_TYPE)], names=["key", "spans"])

    return run


def find_personal_data(docs: DataFrame, model: PiiModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key and its spans with kind, place, score and whether a strict format proves it.

    Null and empty texts have no spans; rows repeat as they come; an empty table gives an empty result. A key
    named ``spans`` keeps its name, and the spans are ``_spans``.
    """
    bound_arrow_batches(docs.sparkSession)
    sent = Shipped(docs.sparkSession, model or train_pii_model())
    kind = docs.schema[key].dataType.simpleString()
    return keyed(docs.select(F.col(key), F.col(text)).mapInArrow(_scan(sent), f"key {kind}, spans {SPANS}"), key)


def redact(text: str, spans) -> str:
    """The text with spans replaced by ``<KIND>``; overlapping spans become one, named after the first."""
    kept, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            kept += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def _redact(model, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(place):
                body = text.as_py()
                strict, more = find_spans(body, model.value)
                texts.append(redact(body, [*strict, *more]) if strict or more else body)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact_personal_data(docs: DataFrame, model: PiiModel | None = None, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; other rows and all other columns as they are."""
    bound_arrow_batches(docs.sparkSession)
    sent = Shipped(docs.sparkSession, model or train_pii_model())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(_redact(sent, docs.columns.index(text)), schema)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs)
    strict = F.filter("spans", lambda s: s["strict"])
    order = F.array(*[F.lit(k) for k in (*KINDS, *MODEL_KINDS)])

    def joined(spans):
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(strict), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
