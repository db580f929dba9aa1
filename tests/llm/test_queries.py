"""The numbered queries on the given tables, against SQL or a brute-force version written here."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.oracles import compare
from tracemill.llm import registry

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) > 0


def test_op3_base_counts(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for r in registry.QUERIES["op3_license_scan"](spark, SF).collect():
        words = ALNUM.findall(lower(texts[r["doc_id"]]))
        places, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets, threshold=75):
    over = {d: d for d in sets}

    def root(d):
        while over[d] != d:
            d = over[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= threshold * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    over[y] = x
    return {d: root(d) for d in ids}


def test_op4_against_all_pairs(spark, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = components(sets)
    got = registry.QUERIES["op4_ngram_jaccard"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(set(want.values())) < len(want)


def luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    found = []
    for order, (kind, (pattern, test)) in enumerate(checks.items()):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if test(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_op5_base_spans(spark, texts):
    total = 0
    for r in registry.QUERIES["op5_pii_spans"](spark, SF).collect():
        spans = base_spans(texts[r["doc_id"]] or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        total += len(listed)
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(listed) <= set(r["spans"].split(",")) | {""}
    assert total


def test_op7_targets_and_bounds(spark, texts):
    rows = registry.QUERIES["op7_mixing"](spark, SF).collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    sizes = {d: len(SPACED.findall(t or "")) for d, t in texts.items()}
    by_source = {}
    for d, s in sources.items():
        by_source[s] = by_source.get(s, 0) + sizes[d]
    names = sorted((s for s in by_source if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by_source else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(by_source.values()))
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = [s for s in free if share[s] > 3 * by_source[s]]
        if not above:
            target |= share
            break
        for s in above:
            capped.add(s)
            target[s] = 3.0 * by_source[s]
            left -= target[s]
    taken = {}
    for r in rows:
        s = sources[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], by_source[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    # rows are drawn by themselves with the fraction as probability: sums stay within a few standard deviations
    for s in names:
        fraction = target[s] / by_source[s] % 1
        spread = sum(fraction * (1 - fraction) * sizes[d] ** 2 for d in sources if sources[d] == s) ** 0.5
        assert abs(taken[s] - target[s]) <= 4 * spread + 1
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)
    again = registry.QUERIES["op7_mixing"](spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_op8_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES["op8_quality_model"](spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    score = np.array([r["score"] for r in rows])
    good = np.array([labels[r["doc_id"]] for r in rows]) == 1
    wins = (score[good][:, None] > score[~good][None, :]).mean() + 0.5 * (score[good][:, None] == score[~good][None, :]).mean()
    assert wins > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "ngram_jaccard":
            want = components({d: shingles(t) for d, t in before.items()})
            assert set(after) == set(want.values())
        elif name == "pii":
            assert not any(k in ("email", "card") for t in after.values() if t for k, *_ in base_spans(t))
        elif name in ("quality_classifier", "mixing"):
            assert all(after[d] == before[d] for d in after)
        if name != "mixing":
            assert out.columns == columns
        docs = out
    assert docs.count() > 0
