"""Lenient reading of model outputs, and the states of a recall, on fixtures worked out by hand."""

from pyspark.sql import functions as F

from tracemill.operators import outputs as O


def test_memories_in_prose(spark):
    raw = [
        (1, 'Sure:\n```json\n{"memories": [{"type": "lesson", "value": " keep it ", "fact": "kept", "questions": ["a", "", 3, "b", "c", "d"]}, {"type": "rumour", "value": "x", "fact": "y"}, 7, {"type": "fact", "value": "", "fact": "y"}]}\n```\nbye'),
        (2, '{"memories": [{"type": "bugfix", "value": "v", "fact": "f"}]}'), (3, "no json"), (4, None), (5, "[1, 2]"), (6, '{"memories": "none"}'),
        (7, '```\n{"memories": [{"type": "fact", "value": 5, "fact": "f"}, {"type": "fact", "value": "v", "fact": "f", "questions": "q"}]}\n```'),
    ]
    outputs = spark.createDataFrame(raw, "id long, raw string")
    got = {(r["id"], r["place"], r["type"], r["value"], r["fact"], tuple(r["questions"]), r["error"]) for r in O.memories_in(outputs, True).collect()}
    assert got == {
        (1, 0, "lesson", "keep it", "kept", ("a", "b", "c"), None), (2, 0, "bugfix", "v", "f", (), None), (7, 1, "fact", "v", "f", (), None),
        (3, None, None, None, None, (), "no JSON"), (4, None, None, None, None, (), "no JSON"),
    }
    assert all(r["questions"] == [] for r in O.memories_in(outputs).collect())


def test_verdicts_in_prose(spark):
    raw = [(1, 'I think {"outcome": " WIN ", "reasoning": "r {x}", "confidence": 0.9} so'), (2, '{"outcome": "draw", "confidence": "high"}'), (3, "none"), (4, "{}"), (5, None), (6, '{"outcome": 3, "confidence": "0.25"}')]
    got = {r["id"]: (r["outcome"], r["reasoning"], r["confidence"], r["error"]) for r in O.verdicts_in(spark.createDataFrame(raw, "id long, raw string")).collect()}
    assert got == {
        1: ("win", "r {x}", 0.9, None), 2: ("tie", "", 0.5, None), 3: (None, None, None, "no JSON"), 4: ("tie", "", 0.5, None), 5: (None, None, None, "no JSON"), 6: ("tie", "", 0.25, None),
    }


def test_real_prompts(spark):
    contents = ['"fix it"', '"  "', '[{"type":"text","text":"a"}]', '[{"type":"text"},{"type":"tool_result"}]', '[{"type":"image"}]', '["plain"]', "{}", None, "[]"]
    rows = spark.createDataFrame([(k, "user", c) for k, c in enumerate(contents)] + [(99, "assistant", '"x"')], "id long, type string, content string")
    assert sorted(r["id"] for r in rows.where(O.is_real_prompt(F.col("type"), F.col("content"))).collect()) == [0, 2]


def test_status_and_its_line(spark):
    store = spark.createDataFrame([("p", "memory", True, "lesson"), ("q", "memory", True, "extract"), ("r", "memory", False, "lesson")], "project string, kind string, active boolean, mem_type string")
    recalls = spark.createDataFrame([("p", 2), ("q", 1), ("r", 1), ("p", 0), (None, 3), ("p", None)], "project string, hits_count int")
    rows = O.recall_status(recalls, store)
    assert sorted((r["project"] or "", r["hits_count"] or 0, r["served_status"]) for r in rows.collect()) == [
        ("", 3, "extractive_only"), ("p", 0, "no_hits"), ("p", 0, "no_hits"), ("p", 2, "ok"), ("q", 1, "extractive_only"), ("r", 1, "extractive_only"),
    ]
    line = rows.where("hits_count = 2").select(O.status_line(F.col("served_status"), F.col("project"), F.col("hits_count"), F.lit(40), F.lit(0.5)).alias("l")).first()["l"]
    assert line == "recalled 2 memories (40 tokens, 0.50 top score)"
