"""Transcripts as files and as bundles, whole and in cycles."""

import json
import os
import time

import pytest

from tracemill.plans import ingest_queries as I
from tracemill.sources import incremental as N
from tracemill.sources import transcripts as T


def said(turn, text):
    return json.dumps({"type": "user", "uuid": str(turn), "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": text}})


def collect(spark, sessions, home, bundled):
    """Sessions (name: lines) under ``home``, replacing what they were."""
    if bundled:
        rows = [("p", name, turn, line) for name, lines in sessions.items() for turn, line in enumerate(lines)]
        T.write_bundles(spark.createDataFrame(rows, "project string, session string, turn long, value string"), str(home))
        return
    for name, lines in sessions.items():
        folder = home / "project=p" / f"session={name}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "t.jsonl").write_text("\n".join(lines))
        now = time.time() + 2 * len(os.listdir(home)) + len(lines)
        os.utime(folder / "t.jsonl", (now, now))


@pytest.mark.parametrize("bundled", [False, True])
def test_cycles_replace_what_changed(spark, tmp_path, bundled):
    files, home = tmp_path / "files", str(tmp_path / "home")
    files.mkdir()
    collect(spark, {f"s{k}": [said(0, f"please fix the parser of long lines, number {k}"), *["{broken"] * (k < 2)] for k in range(40)}, files, bundled)
    cycle = lambda: N.ingest_cycle(spark, str(files), home, bundled=bundled)
    held = lambda: {(r["id"], r["text"][:10]) for r in N.ingested(spark, home, I.CHUNK).collect()}
    dead = lambda: {r["unit"].split("session=")[1] for r in N.dead_letters(spark, home).collect()}
    assert cycle() == 40 and cycle() == 0
    assert held() == {(f"s{k}:0", "please fix") for k in range(40)} and dead() == {"s0", "s1"}
    collect(spark, {"s0": [said(0, "now write a test of the long lines too"), "", said(1, "then look at the reader of the lines")], "new": ["{broken"]}, files, bundled)
    assert cycle() == 2 and cycle() == 0
    assert held() == {("s0:0", "now write "), ("s0:2", "then look ")} | {(f"s{k}:0", "please fix") for k in range(1, 40)}
    assert dead() == {"s1", "new"}


def test_bundles_are_no_more_than_tasks(spark, tmp_path):
    """With a file a session, the driver lists, plans and renames hundreds of thousands."""
    collect(spark, {f"s{k}": [said(0, "a"), " ", said(2, "b\nc")] for k in range(100)}, tmp_path / "b", True)
    assert len([f for f in os.listdir(tmp_path / "b") if f.endswith(".json")]) <= 8
    found = T.scan_bundles(spark, str(tmp_path / "b")).select("session_id", "project", "ord", "line").collect()
    assert {(r["session_id"], r["project"], r["ord"]) for r in found} == {(f"s{k}", "p", o) for k in range(100) for o in (0, 2)}
    assert {r["line"] for r in found} == {said(0, "a"), said(2, "b\nc")}


def test_registered_transcripts_are_bundled(spark):
    lines = I.transcript_lines(spark, "/root/testdata/sf0.01")
    assert lines.select("session_id").distinct().count() == 100 and len(lines.inputFiles()) <= 8
