"""Whitening and nearest neighbours against numpy over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.llm import registry
from tracemill.llm.neighbours import bins_of, build_index, fit_tree, nearest_neighbours
from tracemill.llm.whitening import deviations, fit_whitening, shifted_cholesky, solve_right, whiten, whiten_embeddings

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def embedded(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    kept = sorted((r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"]))
    return np.array([i for i, _ in kept]), np.array([v for _, v in kept], dtype=np.float64)


def test_op11_against_numpy(spark, embedded):
    ids, vectors = embedded
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    values, right = np.linalg.eigh(np.cov((distinct - sums / n).T, bias=True))
    values, right = values[::-1], right[:, ::-1]
    want = ((x - sums / n) @ right / np.sqrt(values))[:, :16]
    got = registry.QUERIES["op11_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(ids) and (got.n == n).all()
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(-1, 16)) - np.abs(want)).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(-1, 16) == ((n * x - sums) ** 2).sum(1)[:, None]).all()
    assert np.allclose(got.explained.to_numpy()[:16], (values / values.sum())[:16], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_keeps_small_components_that_a_gram_matrix_loses(spark):
    random = np.random.default_rng(3)
    turn = np.linalg.qr(random.normal(size=(8, 8)))[0]
    rows = random.normal(size=(2000, 8)) * 10.0 ** -np.arange(8.0) @ turn.T * 3 + 1000
    rows = np.column_stack([rows, rows[:, 0], np.ones(len(rows))])  # a copied and a constant column add no component
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "whitened long, x array<double>")
    model = fit_whitening(frame, "x")
    singular = np.linalg.svd(rows - rows.mean(0), compute_uv=False)[:8]
    assert len(model.eigenvalues) == 8 and model.identity_error < 1e-4
    assert np.allclose(model.eigenvalues, singular**2 / len(rows), rtol=1e-6)
    found = np.array([r["whitened"] for r in whiten(frame, model, "x").collect()])
    assert np.abs(np.cov(found.T, bias=True) - np.eye(8)).max() < 1e-4


def test_whitening_steps():
    random = np.random.default_rng(5)
    a = random.normal(size=(50, 6))
    r = shifted_cholesky(a.T @ a, 50)
    q = solve_right(a, r)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(6), atol=1e-12)
    assert np.isfinite(shifted_cholesky(np.ones((3, 3)), 50)).all()


def test_whitening_edges(spark, tmp_path):
    kind = "vec_id long, embedding array<float>, x string, dev int, deviation string"
    work = Workspace(spark, "test-whitening")
    rows = [
        (1, [0.0, 1.0], "a", 1, "z"), (1, [0.0, 1.0], "a", 1, "z"), (None, [1.0, 0.5], None, 2, None), (3, [0.5, 0.25], "", 3, ""),
        (4, None, "a", 4, "z"), (5, [NAN, 1.0], "a", 5, "z"), (6, [INF, 1.0], "a", 6, "z"), (7, [None, 1.0], "a", 7, "z"), (8, [], "a", 8, "z"), (9, [1.0, 2.0, 3.0], "a", 9, "z"), (10, [1e30, 0.0], "a", 10, "z"),
    ]
    found, model = whiten_embeddings(spark.createDataFrame(rows, kind), work)
    assert model.n == 3 and sorted((r["vec_id"] or 0, r["x"] or "", r["dev"]) for r in found.collect()) == [(0, "", 2), (1, "a", 1), (1, "a", 1), (3, "", 3)]
    assert set(found.columns) == {"vec_id", "embedding", "x", "dev", "deviation", "whitened"}
    for few in ([], rows[:1], rows[:2]):  # nothing varies: no component
        found, model = whiten_embeddings(spark.createDataFrame(few, kind), work)
        assert len(model.eigenvalues) == 0 and [list(r["whitened"]) for r in found.collect()] == [[]] * len(few)


def test_deviations_are_exact_or_null():
    from tracemill.llm.whitening import Whitening

    model = Whitening(3, [10**6 + 1, 5], np.array([333334, 2]), np.zeros(2), np.zeros((0, 2)), np.zeros(0), 1.0)
    assert deviations(model, np.array([[333334, 1]])) == [1 + 4]
    model.n, model.sums = 3_000_000_000, [0, 0]
    model.pivot = np.zeros(2, dtype=np.int64)
    assert deviations(model, np.array([[1, 0], [2, 0], [0, 0]])) == [9 * 10**18, None, 0]


def brute_neighbours(ids, vectors, k, asked):
    found = {}
    for i in np.flatnonzero(asked(ids)):
        scores = (vectors * vectors[i]).sum(1)
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        found[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return found


def test_op12_recall_and_scores(spark, embedded):
    ids, vectors = embedded
    want = brute_neighbours(ids, vectors, 20, lambda i: i % 20 == 0)
    got = {}
    for r in sorted(registry.QUERIES["op12_neighbours"](spark, SF).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        assert all(abs(s - vectors[place[q]] @ vectors[place[i]]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_neighbours_where_every_leaf_is_visited_equal_brute_force(spark):
    random = np.random.default_rng(2)
    vectors = random.integers(-2, 3, size=(400, 5)).astype(float)  # many ties and equal vectors
    vectors[:150] = vectors[0]
    vectors[0] = [1, 1, 0, 0, 2]
    vectors[:150] = vectors[0]
    ids = random.permutation(400)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    found = nearest_neighbours(frame, Workspace(spark, "test-near"), F.col("vec_id") % 7 == 0, k=6, recall=1.0)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    kept = (vectors != 0).any(1)
    index = build_index(frame.where(F.exists("embedding", lambda c: c != 0)), Workspace(spark, "test-index"), "vec_id", "embedding", 6, 1.0)
    assert index.visits == index.tree.leaves or index.recall == 1.0
    want = brute_neighbours(ids[kept], vectors[kept], 6, lambda i: i % 7 == 0)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.97 * 6 * len(want)
    hot = {int(i) for i in ids[:150]}
    for q in hot & want.keys():  # all of a hot vector's copies tie: the smallest ids, without its own
        assert got[q] == want[q]


def test_neighbours_edges(spark):
    work = Workspace(spark, "test-near-edges")
    kind = "vec_id long, embedding array<double>, rank string, score int, leaf int, found string"
    rows = [
        (0, [1.0, 0.0], "a", 1, 1, "b"), (0, [1.0, 0.0], "a", 1, 1, "b"), (1, [0.5, 0.0], None, None, None, None), (2, [0.0, 0.0], "a", 1, 1, "b"), (3, [NAN, 1.0], "a", 1, 1, "b"),
        (4, None, "a", 1, 1, "b"), (5, [], "a", 1, 1, "b"), (6, [None, 1.0], "a", 1, 1, "b"), (None, [3.0, 0.0], "a", 1, 1, "b"), (7, [0.5, 0.0], "a", 1, 1, "b"), (8, [1.0, 2.0, 3.0], "a", 1, 1, "b"), (9, [-INF, 0.0], "a", 1, 1, "b"),
    ]
    found = nearest_neighbours(spark.createDataFrame(rows, kind), work, F.lit(True), k=3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 7, 0.5), (1, 1, 0, 0.5), (1, 2, 7, 0.25), (7, 1, 0, 0.5), (7, 2, 1, 0.25)]
    empty = nearest_neighbours(spark.createDataFrame([], kind), work, F.lit(True), k=3)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    alone = nearest_neighbours(spark.createDataFrame(rows[:1], kind), work, F.lit(True), k=3)
    assert alone.collect() == []


def test_tree_visits_every_leaf_once_and_bins_hold_them():
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = fit_tree(x, 20)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves)) and len(tree.visits(x[0], 3)) == 3
    assert set(tree.descend(x).tolist()) <= set(range(tree.leaves))
    bins, rows = bins_of(np.array([3, 4, 20, 1, 9, 2]), 10)
    assert bins.tolist() == [0, 0, 1, 2, 2, 3] and rows.tolist() == [7, 20, 10, 2]
