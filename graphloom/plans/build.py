"""Builds of a repository's graph: in full, or reading again only what changed. Both give the same graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.functions.ship import ship
from graphloom.operators import analysis, resolve
from graphloom.sources import facts, snapshot, walk


@dataclass
class Build:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    changes: DataFrame | None = None


def _manifest(root: str, name: str, pattern: str) -> str | None:
    import os
    import re

    path = os.path.join(root, name)
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as file:
        found = re.search(pattern, file.read(), re.MULTILINE)
    return found[1].strip("\"'") if found else None


def build(spark: SparkSession, root: str, store: str | None = None, incremental: bool = False) -> Build:
    """The graph of the repository at ``root``; with ``store`` it is written there as a snapshot.

    Incremental: files whose content hash is new, and files that import changed
    or removed ones, are read again, all others come from the last snapshot.
    Names are always resolved anew over all files, so the result is that of a
    full build.
    """
    ship(spark)
    now = walk.source_files(spark, root)
    changes = None
    if incremental and store:
        before = snapshot.read(spark, store, "files")
        changes = keep(analysis.incremental_diff(before.select("path", "content_hash"), now.select("path", "content_hash")))
        again = changes.filter("change in ('added', 'changed')").select("path").union(analysis.reverse_dependents(snapshot.read(spark, store, "edges"), changes).select("path"))
        kept = before.join(changes.filter("change = 'unchanged'").join(again, "path", "left_anti"), "path", "left_semi")
        files = facts.extract(now.join(again, "path", "left_semi")).unionByName(kept)
    else:
        files = facts.extract(now)
    files, every = keep(files), keep(walk.every_path(spark, root))  # read and parsed once; names are looked up in them many times
    nodes, edges = resolve.build_graph(files, every, _manifest(root, "go.mod", r"^module\s+(\S+)"), _manifest(root, "Cargo.toml", r'^name\s*=\s*"([^"]+)"'))
    if store:
        snapshot.write(store, nodes, edges, files, {"root": root, "build_mode": "incremental" if incremental else "full"})
        nodes, edges, files = (snapshot.read(spark, store, t) for t in ("nodes", "edges", "files"))
    return Build(nodes, edges, files, changes)


def complexity_facts(files: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, complexity) from the same records."""
    return files.select("path", F.explode("complexity").alias("c")).select("path", "c.name", "c.start_line", "c.end_line", "c.complexity")
