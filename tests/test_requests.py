"""Payloads of request bodies and rewritten bodies, on bodies written here and against a walk over parsed JSON."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions.workspace import Workspace
from tracemill.operators import requests as Q

LOG = "\n".join(["start", *[f"line {k} fine" for k in range(60)], "ERROR broken", *[f"line {k} fine" for k in range(60)], "end"])
BLOCKS = {
    "model": "m", "max_tokens": 4096, "temperature": 0.25, "stream": None, "metadata": {"user": "ü", "deep": [1, {"a": [True, 1.5e-7]}]},
    "messages": [
        {"role": "user", "content": "read it"},
        {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "Read", "input": {"path": " ", "file_path": "a.log"}}, {"type": "tool_use", "id": "c2", "name": "", "input": '{"file": "b.md"}'}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": LOG, "is_error": False}, {"type": "tool_result", "tool_use_id": "c2", "content": [{"type": "text", "text": "two "}, "parts", {"type": "image", "source": "x"}]}]},
        {"role": "assistant", "content": [{"type": "tool_use", "id": "c1", "name": "Grep", "input": {"file_path": "a.log"}}, {"type": "tool_use", "id": 7, "name": "Odd", "input": {}}]},
        {"role": "user", "content": [{"type": "text", "text": "again"}, {"type": "tool_result", "tool_use_id": "c1", "content": LOG}, {"type": "tool_result", "tool_use_id": "gone", "content": "[stored:0123] short"}, {"type": "tool_result", "tool_use_id": "c2", "content": {"no": "text"}}]},
    ],
}
MESSAGES = {
    "messages": [
        {"role": "system", "content": "s"},
        {"role": "assistant", "content": None, "tool_calls": [{"id": "t1", "type": "function", "function": {"name": "run", "arguments": '{"filename": "x.log"}'}}, {"id": "t2", "function": {"name": "run", "arguments": "no json"}}]},
        {"role": "tool", "tool_call_id": "t1", "content": "old"},
        {"role": "user", "content": "and now"},
        {"role": "tool", "tool_call_id": "t1", "content": LOG},
        {"role": "tool", "tool_call_id": "t2", "content": ["a list"]},
        {"role": "tool", "tool_call_id": "t9", "content": ""},
    ],
    "n": 12345678901234567890,
}


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(1, "anthropic", json.dumps(BLOCKS)), (2, "openai", json.dumps(MESSAGES)), (3, "openai", "not json"), (4, "anthropic", None), (5, "anthropic", '{"messages": "none"}'), (6, "other", json.dumps(MESSAGES)), (7, "openai", '{"messages": []}')]
    return spark.createDataFrame(rows, "request_id long, provider string, body string")


def test_payloads_with_their_calls(bodies):
    got = sorted(((r["request_id"], r["message"], r["place"], r["text"], r["tool"], r["file_path"], r["is_latest"]) for r in Q.payloads_of(bodies).collect()), key=repr)
    assert got == sorted(
        [
            (1, 2, 0, LOG, "Grep", "a.log", False), (1, 2, 1, "two parts", "unknown", "b.md", True), (1, 4, 1, LOG, "Grep", "a.log", True), (1, 4, 2, "[stored:0123] short", None, None, True),
            (2, 2, None, "old", "run", "x.log", False), (2, 4, None, LOG, "run", "x.log", True), (2, 6, None, "", None, None, True),
        ], key=repr,
    )
    latest = {(r["request_id"], r["message"], r["place"]) for r in Q.payloads_of(bodies, latest_only=True).collect()}
    assert latest == {(1, 4, 1), (1, 4, 2), (2, 4, None), (2, 6, None)}


def walk(value, path=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walk(v, (*path, k))
    else:
        yield path, value


@pytest.mark.parametrize("latest_only", [True, False])
def test_rewritten_bodies_differ_in_payloads_only_and_come_back(bodies, latest_only, spark):
    done, summary, stored = Q.compress_requests(bodies, Workspace(spark, "t-requests"), latest_only)
    got = {r["request_id"]: r["body"] for r in done.collect()}
    held = {r["stored_id"]: r["text"] for r in stored.collect()}
    assert list(held.values()) == [LOG]
    places = {1: [(4, 1)] if latest_only else [(2, 0), (4, 1)], 2: [(4, None)]}
    for key, before in ((1, BLOCKS), (2, MESSAGES)):
        changed = {("messages", m, "content") if p is None else ("messages", m, "content", p, "content") for m, p in places[key]}
        after = dict(walk(json.loads(got[key])))
        before = dict(walk(before))
        assert after.keys() == before.keys() and {p for p in after if after[p] != before[p]} == changed
        assert all(after[p].startswith("[stored:") and "ERROR broken" in after[p] and len(after[p]) < len(LOG) for p in changed)
    assert got[3] == "not json" and got[4] is None and got[7] == '{"messages": []}'
    sums = {r["request_id"]: r for r in summary.collect()}
    assert len(sums) == 7 and sums[1]["content_types"] == {"log": len(places[1])} and not sums[2]["passthrough"] and sums[3]["passthrough"] and sums[6]["tokens_before"] == 0
    assert sums[1]["tokens_after"] < sums[1]["tokens_before"]
    back = {r["request_id"]: r["body"] for r in Q.restored(done, stored).collect()}
    assert json.loads(back[1]) == BLOCKS and json.loads(back[2]) == MESSAGES
    again, sums, _ = Q.compress_requests(done, Workspace(spark, "t-requests"), latest_only)  # what carries a mark is not counted
    assert {r["request_id"]: r["body"] for r in again.collect()} == got and all(r["passthrough"] for r in sums.collect())


def test_questions_and_injected_memories(bodies, spark):
    asked = {r["request_id"]: (r["message"], r["query"]) for r in Q.questions_of(bodies).collect()}
    assert asked == {1: (4, "again"), 2: (3, "and now"), 6: (3, "and now")}
    told = spark.createDataFrame([(1, "## Recalled\nuse b"), (2, "## Recalled"), (3, "x"), (6, "  "), (99, "y")], "request_id long, memories string")
    got = {r["request_id"]: r["body"] for r in Q.inject_memories(bodies, told).collect()}
    first, second = json.loads(got[1]), json.loads(got[2])
    assert first["messages"][4]["content"] == [*BLOCKS["messages"][4]["content"], {"type": "text", "text": "## Recalled\nuse b"}]
    assert second["messages"][3]["content"] == "and now\n\n## Recalled" and second["n"] == MESSAGES["n"]
    assert [m for k, m in enumerate(first["messages"]) if k != 4] == BLOCKS["messages"][:4]
    assert got == {r["request_id"]: r["body"] for r in bodies.where(~F.col("request_id").isin(1, 2)).collect()} | {1: got[1], 2: got[2]}
