"""Repository, history and change sources, snapshots by number, and state by path."""

import os
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.operators import resolve
from graphloom.sources import facts, gitlog, snapshot, walk
from graphloom.streaming import watch


@pytest.fixture
def repo(tmp_path):
    for path, text in {"a.py": "import lib.b\n", "lib/b.py": "def f():\n    return 1\n", "lib/deep/c.py": "x = 1\n", "lib/.gitignore": "no*.py\n", "lib/none.py": "", "lib/deep/no1.py": "", "node_modules/x.js": "", ".hidden/h.py": "h = 1\n", "src/_u.ts": "", "doc.txt": "", ".gitignore": "src/*.go\n", "src/m.go": ""}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    return str(tmp_path)


def test_repository_source_lists_by_folder(spark, repo):
    got = walk.source_files(spark, repo)
    wanted = [".hidden/h.py", "a.py", "lib/b.py", "lib/deep/c.py", "src/_u.ts"]
    assert sorted(r["path"] for r in got.collect()) == wanted == walk.walk(repo)
    assert got.rdd.getNumPartitions() == len(walk.tops(repo)) == 4
    assert {r["path"] for r in walk.every_path(spark, repo).collect()} == {*wanted, "lib/.gitignore", "lib/none.py", "lib/deep/no1.py", "doc.txt", ".gitignore", "src/m.go"}
    with pytest.raises(NotADirectoryError):
        walk.source_files(spark, f"{repo}/nowhere")


def test_repository_source_prunes_folders(spark, repo):
    one = walk.source_files(spark, repo, "lib")
    assert one.rdd.getNumPartitions() == 1 and sorted(r["path"] for r in one.collect()) == ["lib/b.py", "lib/deep/c.py"]


def test_changed_files_stream(spark, repo, tmp_path_factory):
    state, seen = str(tmp_path_factory.mktemp("state")), []

    def run():
        q = walk.changed_files(spark, repo).writeStream.foreachBatch(lambda f, _: seen.append(sorted(r["path"] for r in f.collect()))).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run()
    assert [x for x in seen if x] == [[".hidden/h.py", "a.py", "lib/b.py", "lib/deep/c.py", "src/_u.ts"]]
    with open(f"{repo}/lib/b.py", "a") as file:
        file.write("y = 2\n")
    seen.clear()
    run()
    assert [x for x in seen if x] == [["lib/b.py"]]


def test_history_by_ranges_of_commits(spark, tmp_path):
    run = lambda *a, at="": subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at})
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "sub").mkdir()
    for k in range(7):
        (tmp_path / ("a.py" if k % 2 else "sub/b.py")).write_text(str(k))
        run("add", ".")
        run("commit", "-qm", "x", at=f"2021-01-0{k + 1}T00:00:00+00:00")
    rows = lambda step, at=tmp_path: sorted((r["seq"], r["date_iso"][:10], r["path"]) for r in gitlog.commits(spark, str(at), step).collect())
    assert rows(2) == rows(100) == [(k, f"2021-01-0{7 - k}", "sub/b.py" if k % 2 == 0 else "a.py") for k in range(7)]
    assert rows(2, tmp_path / "sub") == [(k, f"2021-01-0{7 - 2 * k}", "b.py") for k in range(4)]
    assert gitlog.commits(spark, str(tmp_path), 2).rdd.getNumPartitions() == 4
    assert gitlog.commits(spark, "/").count() == 0


def test_snapshots_of_two_writers(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshot.current(spark, root)
    got: list[int] = []
    threads = [threading.Thread(target=lambda: got.append(snapshot.claim(spark, root))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4, 5, 6]  # no number twice
    snapshot.publish(spark, root, 5)
    assert snapshot.current(spark, root).endswith("5")
    snapshot.publish(spark, root, 3)  # the older writer ends later
    assert snapshot.current(spark, root).endswith("5")


def test_snapshot_keyed_reads(spark, repo, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    files = keep(facts.extract(walk.source_files(spark, repo)))
    nodes, edges = resolve.build_graph(files)
    assert snapshot.write(root, nodes, edges, files, {"root": repo}) == 1
    one = snapshot.read_files(spark, root, ["lib/b.py", "none.py"])
    assert [r["path"] for r in one.collect()] == ["lib/b.py"]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in one._jdf.queryExecution().toString()
    assert snapshot.meta(spark, root, "root") == repo and snapshot.meta(spark, root, "other") is None


def test_a_stream_of_changes_equals_a_full_build(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        inbox, table, state = (str(tmp_path / x) for x in ("inbox", "table", "state"))
        kinds, seq, now = "path string, seq long, content binary", 0, {}
        steps = [
            {"a.py": "from b import f\n\ndef g():\n    return f()\n", "b.py": "def f():\n    return 1\n", "c.py": "def lonely():\n    return 2\n"},
            {"b.py": "def f():\n    return 1\n\ndef h():\n    return f()\n", "c.py": None, "a.py": "from b import f\n\ndef g():\n    return f()\n"},
            {"d.py": "import c\n", "none.py": None},
            {"c.py": "def back():\n    return 3\n", "d.py": None},
        ]
        told = []
        for step in steps:
            rows = []
            for path, text in step.items():
                seq += 1
                rows.append((path, seq, text and text.encode()))
            now = {p: t for p, t in (now | step).items() if t is not None}
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(inbox)
            watch.record_changes(spark.readStream.schema(kinds).parquet(inbox), table, state, {"availableNow": True}).awaitTermination(90)
            told.append(sorted((r["path"], r["change"]) for r in spark.read.parquet(table).filter(F.col("seq") > seq - len(step)).collect()))
        assert told == [[("a.py", "added"), ("b.py", "added"), ("c.py", "added")], [("b.py", "changed"), ("c.py", "removed")], [("d.py", "added")], [("c.py", "added"), ("d.py", "removed")]]
        full = facts.extract(spark.createDataFrame([(p, "python", t.encode()) for p, t in now.items()], "path string, language string, content binary").withColumn("content_hash", F.sha2("content", 256)))
        full, kept = keep(full), keep(watch.current_records(spark, table))
        for one, two in zip(resolve.build_graph(kept), resolve.build_graph(full), strict=True):
            assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
