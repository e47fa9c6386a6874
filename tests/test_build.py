"""A small repository of our own, read, resolved and analysed end to end."""

import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.functions.ship import ship
from graphloom.operators import analysis, coverage, reach, resolve
from graphloom.sources import facts, gitlog, walk

FILES = {
    "app/core.py": "class Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return 1\n\ndef helper(x):\n    if x and x > 1:\n        return 1\n    return 2\n",
    "app/use.py": "import os\nfrom app.core import Base, helper\n\nclass Child(Base):\n    def go(self):\n        self.run()\n        super().step()\n        self.missing()\n        helper(1)\n        os.getcwd()\n        unknown()\n\ndef passed():\n    return 1\n\ndef top():\n    return list(map(passed, []))\n",
    "tests/test_use.py": "from app.use import top\n\ndef test_top():\n    top()\n",
    "app/__init__.py": "",
    "app/broken.py": "def (:\n",
    "build/out.py": "x = 1\n",
    "ignored/a.py": "x = 1\n",
    ".gitignore": "ignored/\n",
    "notes.txt": "no source\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def graph(spark, repo):
    ship(spark)
    records = facts.extract(walk.source_files(spark, str(repo))).cache()
    nodes, edges = resolve.build_graph(records)
    return records, nodes.cache(), edges.cache()


def test_walk_skips_what_is_ignored(repo):
    assert walk.walk(str(repo)) == ["app/__init__.py", "app/broken.py", "app/core.py", "app/use.py", "tests/test_use.py"]
    with pytest.raises(NotADirectoryError):
        walk.walk(str(repo / "none"))


def test_records(graph):
    rows = {r["path"]: r for r in graph[0].collect()}
    assert rows["app/broken.py"]["has_parse_errors"] and not rows["app/core.py"]["has_parse_errors"]
    assert [f["name"] for f in rows["app/core.py"]["functions"]] == ["helper"]
    assert {(c["name"], c["complexity"]) for c in rows["app/core.py"]["complexity"]} == {("run", 1), ("step", 1), ("helper", 3)}
    assert [c["extends"] for c in rows["app/use.py"]["classes"]] == [["Base"]]


def test_edges_are_proven_or_keep_their_text(graph):
    edges = {(r["type"], r["src"], r["dst"], r["callee_text"]) for r in graph[2].collect()}
    go = "m:app/use.py#Child.go"
    assert ("inherits", "cls:app/use.py#Child", "cls:app/core.py#Base", None) in edges
    assert ("calls", go, "m:app/core.py#Base.run", None) in edges
    assert ("calls", go, "m:app/core.py#Base.step", None) in edges
    assert ("calls", go, "fn:app/core.py#helper", None) in edges
    assert ("calls", go, "xf:os#getcwd", None) in edges
    assert ("calls", go, None, "unknown") in edges
    assert ("calls", go, None, "self.missing") in edges or ("calls", go, None, "missing") in edges
    assert ("calls", "m:app/core.py#Base.run", "m:app/core.py#Base.step", None) in edges
    assert ("imports", "f:app/use.py", "f:app/core.py", None) in edges
    assert ("imports", "f:app/use.py", "xm:os", None) in edges
    assert ("references", "f:app/use.py", "fn:app/use.py#passed", None) in edges


def test_blast_radius_and_coverage(spark, graph):
    _, nodes, edges = graph
    got = {(r["node"], r["depth"]) for r in reach.blast_radius(nodes, edges, "fn:app/core.py#helper").collect()}
    assert got == {("m:app/use.py#Child.go", 1)}
    with pytest.raises(ValueError):
        reach.blast_radius(nodes, edges, "fn:none")
    from graphloom.functions import paths

    pairs = {(r["test"], r["path"]) for r in coverage.coverage_pairs(nodes, edges, paths.is_test).collect()}
    assert ("tests/test_use.py", "app/core.py") in pairs and ("tests/test_use.py", "app/use.py") in pairs


def test_git_history_and_risk(spark, tmp_path):
    run = lambda *a, **e: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "GIT_AUTHOR_DATE": e.get("at", ""), "GIT_COMMITTER_DATE": e.get("at", "")})
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for at in ("2020-01-01T00:00:00+00:00", "2021-05-01T00:00:00+00:00", "2021-06-01T00:00:00+00:00"):
        (tmp_path / "a.py").write_text(at)
        run("add", ".")
        run("commit", "-qm", "x", at=at)
    history = analysis.churn(gitlog.commits(spark, str(tmp_path)), F.lit("2021-06-02").cast("timestamp")).collect()
    assert [(r["path"], r["commits_total"], r["commits_in_window"]) for r in history] == [("a.py", 3, 2)]
    assert gitlog.commits(spark, "/").count() == 0
