"""Every registered query of the engine's own operators against its SQL, and small fixtures of what the tables lack."""

import pytest

from tests.oracles import compare
from tracemill.operators import curation as C
from tracemill.operators import retrieval as R
from tracemill.plans import catalog

SF = "/root/testdata/sf0.001"
#: The smallest tables hold nothing that these find; the next larger ones do, but for harness chatter, which is generated nowhere.
LARGER, NEVER = ("blob_evict", "secret_scan"), ("noise_scan",)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    rows = compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.01" if name in LARGER else SF)
    assert rows or name in NEVER, "an empty result shows nothing"


def test_flagship_keeps_order_and_budget(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows
    by_query = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    for found in by_query.values():
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        assert all(r["spent"] <= 1500 or r["rank"] == 1 for r in found)


def test_duplicates_keep_the_earliest(spark):
    rows = [("a", "m", "p", 2, "x  y"), ("b", "m", "p", 1, "x y"), ("c", "m", "p", 1, " x\ny "), ("d", "m", "q", 0, "x y"), ("e", "m", None, 0, None), ("f", "m", None, 0, "")]
    store = spark.createDataFrame(rows, "id string, kind string, project string, created_at long, text string")
    assert {(r["id"], r["kept_id"]) for r in C.duplicates(store).collect()} == {("a", "b"), ("c", "b"), ("f", "e")}


def test_mmr_skips_a_near_copy(spark):
    pool = spark.createDataFrame([(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.99, [1.0, 0.0]), (1, "c", 0.5, [0.0, 1.0]), (1, "d", 0.1, None)], "query_id long, id string, score double, vector array<double>")
    assert [r["id"] for r in R.mmr(pool, 2).orderBy("rank").collect()] == ["a", "c"]


def test_zero_vectors_match_nothing(spark):
    q = R.embed(spark.createDataFrame([(1, "")], "query_id long, query string"), "query")
    store = R.embed(spark.createDataFrame([("a", "some words"), ("b", None)], "id string, text string"))
    assert all(r["similarity"] == 0 for r in R.dense_topk(q, store, 5).collect())
