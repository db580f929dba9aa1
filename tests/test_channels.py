"""The two channels: what they cost, and the same results in blocks and over a shuffle."""

import pytest

from tracemill.operators import retrieval as R
from tracemill.plans import evaluation_queries as E
from tracemill.plans import retrieval_queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_hashed_once_to_be_embedded(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string").repartition(2)
    assert plan(R.embed(rows)).count("sha2(") == 1


def test_scores_of_a_row_are_added_up_in_one_task(spark):
    """No row per text and question is shuffled, or even made."""
    found = plan(Q.lexical(spark, SF))
    assert "explode(askers" not in found and "MapInArrow" in found


@pytest.mark.parametrize("query, lexical, dense", [(E.metrics, 1, 1), (E.compared, 1, 1), (E.suite, 1, 1)])
def test_channels_are_searched_once(spark, monkeypatch, query, lexical, dense):
    seen = []
    for name in ("bm25_topk", "dense_topk"):
        monkeypatch.setattr(R, name, lambda *a, _f=getattr(R, name), _n=name, **k: seen.append(_n) or _f(*a, **k))
    query(spark, SF)
    assert (seen.count("bm25_topk"), seen.count("dense_topk")) == (lexical, dense)


@pytest.mark.parametrize("blocks", [5, 300])
def test_lexical_in_blocks_equals_the_shuffle(spark, monkeypatch, blocks):
    texts = [(f"t{i}", " ".join(f"w{(i * k) % 17}" for k in range(1 + i % 9))) for i in range(200)] + [("null", None), ("none", "-"), ("t3", "w1 w1")]
    asked = [(str(i), " ".join(f"W{(i + k) % 20}" for k in range(i % 6))) for i in range(30)]
    store, queries = spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(asked, "query_id string, query string")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 8)) for r in df.collect())
    monkeypatch.setattr(R, "SCORES_AT_A_TIME", blocks)
    got = rows(R.bm25_topk(queries, store, 4))
    monkeypatch.setattr(R, "MAX_ASKED_PAIRS", 0)
    assert got and got == rows(R.bm25_topk(queries, store, 4))
    monkeypatch.undo()
    assert R.bm25_topk(queries.where("query = ''"), store, 4).collect() == []
    assert R.bm25_topk(queries, store.where("text IS NULL"), 4).collect() == []


@pytest.mark.parametrize("within", [None, "project"])
def test_dense_in_narrow_blocks_of_questions(spark, monkeypatch, within):
    """A block of rows meets a bounded number of questions at a time; with all, a task's scores grow with their number."""
    vectors = [(i, [float((i * k) % 13 - 6) for k in range(1, 5)], f"p{i % 3}") for i in range(60)]
    store = spark.createDataFrame(vectors, "id long, vector array<double>, project string")
    queries = store.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    rows = lambda: sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in R.dense_topk(queries, store, 5, within=within).collect())
    whole = rows()
    monkeypatch.setattr(R, "BATCH_QUESTIONS", 7)
    assert len(whole) == 150 and rows() == whole
