"""Builds, snapshots, reports, answers, the line protocol, questions and the gate."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import questions
from graphloom.plans import build, engine, render
from graphloom.schema import COMMITS, EDGES, NODES


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "lib").mkdir()
    (root / "lib" / "a.py").write_text("from lib.b import f\n\ndef g():\n    return f()\n")
    (root / "lib" / "b.py").write_text("def f():\n    return 1\n")
    (root / "lib" / "c.py").write_text("def lonely():\n    return 2\n")
    return root


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_incremental_build_equals_a_full_one(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    build.build(spark, str(repo), store)
    (repo / "lib" / "b.py").write_text("def f():\n    return 1\n\ndef h():\n    return f()\n")
    (repo / "lib" / "d.py").write_text("import lib.c\n")
    (repo / "lib" / "c.py").unlink()
    again = build.build(spark, str(repo), store, incremental=True)
    full = build.build(spark, str(repo))
    assert rows(again.nodes) == rows(full.nodes) and rows(again.edges) == rows(full.edges)
    assert {(r["path"], r["change"]) for r in again.changes.collect()} == {("lib/a.py", "unchanged"), ("lib/b.py", "changed"), ("lib/c.py", "removed"), ("lib/d.py", "added")}


def test_report_answers_and_lines(spark, repo):
    made = build.build(spark, str(repo))
    commits = spark.createDataFrame([(0, "2024-01-01T00:00:00+00:00", "lib/b.py")], "seq long, date_iso string, path string").withColumn("ts", F.to_timestamp("date_iso"))
    e = engine.Engine(made.nodes, made.edges, commits, F.lit("2024-01-02").cast("timestamp"), build.complexity_facts(made.files), made.files)
    report = e.report()
    assert report["nodes"]["file"] >= 3 and report["coverage"]["covered_files"] == 0
    assert e.ask("what depends on f?")["dependents"][0]["node"] in {"fn:lib/a.py#g", "fn:lib/b.py#h"}
    assert report["complexity"]["functions"] >= 2 and report["complexity"]["top"][0]["complexity"] == 1
    assert report["untested_and_changing_first"] == ["lib/b.py"] and report["parse_errors"] == 0 and report["cycle_paths"]["calls"] == []
    assert "changing without tests: 1\n  lib/b.py" in render.report(report)
    assert e.ask("sing a song")["refused"]
    assert e.ask("who calls nobody")["status"] == "not-found"
    assert e.ask("what's the riskiest file")["file"]["path"] == "lib/b.py"
    ask = lambda **m: json.loads(engine.handle(e, json.dumps({"jsonrpc": "2.0", **m})))
    assert json.loads(engine.handle(e, "{"))["error"]["code"] == -32700
    assert ask(id=1, method="nope")["error"]["code"] == -32601
    assert ask(id=1, method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert engine.handle(e, json.dumps({"jsonrpc": "2.0", "method": "ping"})) is None
    tool = lambda t, /, **args: ask(id=2, method="tools/call", params={"name": t, "arguments": args})
    text = lambda *a, **k: json.loads(tool(*a, **k)["result"]["content"][0]["text"])
    hit = text("find-symbol", name="F")
    assert hit["mode"] == "exact" and hit["matches"][0]["id"] == "fn:lib/b.py#f" and hit["matches"][0]["exported"] in (True, False)
    assert tool("find-symbol")["error"]["code"] == -32602 and tool("find-symbol", name="")["error"]["code"] == -32602
    listed = {t["name"]: t["inputSchema"] for t in ask(id=3, method="tools/list")["result"]["tools"]}
    assert listed["blast-radius"]["required"] == ["node_id"] and listed["riskiest-files"]["properties"] == {"limit": {"type": "number"}}
    assert text("blast-radius", node_id="fn:lib/b.py#f")["confirmed"] >= 1
    assert tool("blast-radius", node_id="fn:gone")["error"]["code"] == -32602
    assert text("is-dead-code", node_id="fn:lib/b.py#f")["verdict"] == "referenced" and text("is-dead-code", node_id="f:lib/b.py")["verdict"] == "not-a-candidate"
    assert text("is-dead-code", node_id="fn:gone")["verdict"] == "not-found"
    files = text("riskiest-files", limit=-1)["files"]
    assert files[0] == {"path": "lib/b.py", "score": 37, "commits_in_window": 1, "untracked": False, "tested": False, "last_modified": "2024-01-01T00:00:00+00:00"}
    left = text("whats-not-tested", scope="nowhere")
    assert left["files"] == [] and left["untested"] == left["source_files"] >= 3


def test_verdicts_and_candidates(spark):
    nodes = spark.createDataFrame([(i, t, n, "a.py", 1, 2, False, False, "python") for i, t, n in [
        ("f:a.py", "file", "a.py"), ("cls:a.py#Old", "class", "Old"), ("m:a.py#Old.go", "method", "go"), ("m:a.py#Old.run", "method", "run"), ("fn:a.py#run", "function", "run"), ("fn:a.py#called", "function", "called")]], NODES)
    edges = spark.createDataFrame([
        ("cls:a.py#Old", "m:a.py#Old.go", "defines", 1, None, "resolved"), ("cls:a.py#Old", "m:a.py#Old.run", "defines", 1, None, "resolved"),
        ("f:a.py", "fn:a.py#called", "calls", 1, None, "resolved"), ("f:a.py", "fn:a.py#called", "calls", 2, None, "resolved"), ("f:a.py", None, "calls", 3, "x.run", "ambiguous")], EDGES)
    e = engine.Engine(nodes, edges, spark.createDataFrame([], COMMITS), F.current_timestamp())
    assert {(r["id"], r["verdict"], r["tier"], r["inbound"]) for r in e.verdicts.collect()} == {
        ("f:a.py", "not-a-candidate", None, 0), ("cls:a.py#Old", "dead-candidate", "confirmed-unreferenced", 0), ("m:a.py#Old.go", "dead-candidate", "confirmed-unreferenced", 0),
        ("m:a.py#Old.run", "dead-candidate", "no-resolved-references", 0), ("fn:a.py#run", "dead-candidate", "no-resolved-references", 0), ("fn:a.py#called", "referenced", None, 2)}
    told = e.ask("what depends on run?")
    assert told["status"] == "multiple" and [c["id"] for c in told["candidates"]] == ["fn:a.py#run", "m:a.py#Old.run"]
    assert render.answer(told).splitlines()[1:] == ["  fn:a.py#run", "  m:a.py#Old.run"]


@pytest.mark.parametrize("question, expected", [
    ("What depends on src/a.ts?", {"intent": "blast-radius", "target": "src/a.ts"}),
    ("is foo dead code", {"intent": "dead-code-check", "target": "foo"}),
    ("what's untested in lib", {"intent": "untested", "scope": "lib"}),
    ("which file is the riskiest?", {"intent": "riskiest-file", "scope": None}),
    ("write a poem", None),
])
def test_questions(question, expected):
    assert questions.parse(question) == expected


def test_stream_of_changes_rebuilds(spark, tmp_path):
    from graphloom.streaming import watch

    folder = tmp_path / "events"
    spark.createDataFrame([("2024-01-01 00:00:00", "r", "a.py"), ("2024-01-01 00:00:00.05", "r", "b.py"), ("2024-01-01 00:00:00", "r", ".git/x.py"), ("2024-01-01 01:00:00", "other", "c.py"), ("2024-01-01 02:00:00", "other", "c.py")], "ts string, root string, path string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(folder))
    stream = spark.readStream.schema("ts timestamp, root string, path string").parquet(str(folder))
    seen = []
    q = watch.rebuild_on_change(stream, seen.append, str(tmp_path / "state"), trigger={"availableNow": True})
    q.awaitTermination(60)
    assert sorted(set(seen)) == ["other", "r"]


def test_queries_and_oracles_agree_on_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
