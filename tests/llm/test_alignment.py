"""Tokenizer alignment against a token-by-token version over the same files."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tracemill.functions.workspace import Workspace
from tracemill.llm import registry
from tracemill.llm.alignment import FOLDER, SIDE_A, SIDE_B, Aligner, align_tokenizers, gallop, intersect

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(f"{FOLDER}/{SIDE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{SIDE_B}")


def letters():
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    found, more = {}, 256
    for b in range(256):
        found[chr(b) if b in kept else chr(more)] = b
        more += b not in kept
    return found


def tokens(encoders, text):
    a, b = encoders
    own = letters()
    side_a = [(i, bytes(own[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    same = b"".join(t for _, t in side_a) == b"".join(t for _, t in side_b) == (" " + text).encode()
    return (side_a, side_b) if same else None


def brute(encoders, texts):
    found, counts = [], Counter()
    for text in texts:
        both = tokens(encoders, text) if text else None
        if not both:
            found.append(None)
            continue
        spans = []
        for side in both:
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = []
        for i, low, high in spans[0]:
            links += [(i, j) for j, a, b in spans[1] if a < high and b > low] if len(spans[1]) < 3000 else []
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, a, b in own if low <= a and b <= cut) for own in spans))
            low = cut
        counts.update(links)
        found.append((len(spans[0]), len(spans[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [(0, 0, 0, 0, "", 0, 0) if f is None else (*f[:5], sum(counts[x] == best[x[1]] for x in f[5]), sum(counts[x] for x in f[5])) for f in found]


ODD = ["", None, " ", "  ", "a", "a ", "  two  spaces  ", "x▁y", "▁", "▁ b", "<s>hi</s> <|endoftext|> <unk>", "naïve café 日本語 ﬁ", "nul\0byte", "\n\n\t x", "a" * 900, " " * 900, "🙂🙂", "twice twice", "twice twice"]


def test_odd_texts_keys_and_columns(spark, encoders):
    rows = [(None if k == 3 else k % 17, text, k, "x", 1) for k, text in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, piece int, pairs string, n_a int").repartition(3)
    found, pairs = align_tokenizers(docs, Workspace(spark, "test-align"), piece_size=40)
    got = sorted(((r["key"], *(r[c] for c in COLUMNS)) for r in found.collect()), key=repr)
    want = brute(encoders, ODD)
    assert got == sorted(((row[0], *w) for row, w in zip(rows, want, strict=True)), key=repr)
    assert sum(r["total"] for r in pairs.collect()) == sum(w[3] for w in want)


def test_op13_against_brute_force(spark, encoders):
    texts = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 4000]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found, _ = align_tokenizers(docs, Workspace(spark, "test-align"), piece_size=20_000)
    got = {r["key"]: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == dict(zip([r["doc_id"] for r in texts], brute(encoders, [r["text"] for r in texts]), strict=True))
    rows = registry.QUERIES["op13_alignment"](spark, SF)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    whole = {r["doc_id"]: r["groups_sha256"] for r in rows.collect()}
    assert len(whole) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(whole[k] == v[4] for k, v in got.items())


def test_empty_table(spark):
    found, pairs = align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark, "test-align"))
    assert found.collect() == [] and pairs.collect() == []


def test_white_space_beyond_the_fast_encoder(encoders):
    text = "a" + "\n" * 1_500_000 + "b"
    n_a, n_b, *_ = next(iter(Aligner.of(f"{FOLDER}/{SIDE_A}", f"{FOLDER}/{SIDE_B}").align([text])))
    assert n_a == len(encoders[0].encode(" " + text, add_special_tokens=False).ids) and n_b == len(encoders[1].encode(text))


def test_gallop_ranks_from_any_start():
    random = np.random.default_rng(4)
    ends = np.unique(random.integers(0, 1000, 200))
    keys = random.integers(-5, 1010, 500)
    for start in (np.zeros(500, dtype=np.int64), np.full(500, len(ends)), random.integers(0, len(ends) + 1, 500)):
        assert (gallop(keys, ends, start) == np.searchsorted(ends, keys)).all()
    assert gallop(keys, ends[:0], np.zeros(500, dtype=np.int64)).tolist() == [0] * 500


def test_intersect_links_tokens_that_share_bytes():
    links = intersect(np.array([2, 5, 6, 8, 9]), np.array([1, 3, 6, 9]), np.array([0, 3, 5]), np.array([0, 3, 4]))
    assert list(zip(links.a.tolist(), links.b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (3, 3), (4, 3)]
    assert np.flatnonzero(links.a_ends).tolist() == [2, 4] and np.flatnonzero(links.b_ends).tolist() == [2, 3]
