"""Lookup of nodes by name, path or id, as questions give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that the results depend on.
NODE_ID = "^(f|fn|cls|m|xm|xf|xc):"
PATH_LIKE = "/|[.](js|jsx|mjs|cjs|ts|tsx|mts|cts|py)$"


def find_exact(nodes: DataFrame, names: list[str], top: int = 20) -> DataFrame:
    """Nodes of any of ``names``, whatever the case, first ids first."""
    return nodes.filter(F.lower("name").isin(*[n.lower() for n in names])).select("id", "type", "name", "path").orderBy("id").limit(top)


def find_symbol(nodes: DataFrame, name: str, top: int = 20) -> DataFrame:
    """Nodes of a name; if there are none, nodes whose name holds it (taken literally)."""
    exact = find_exact(nodes, [name], top)
    if exact.limit(1).count():
        return exact
    return nodes.filter(F.contains(F.lower("name"), F.lit(name.lower()))).select("id", "type", "name", "path").orderBy("id").limit(top)


def path_ends(files: DataFrame) -> DataFrame:
    """(tail, id, path): every end of a path that follows a slash, so that a search for an end is an equi-join."""
    steps = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))
    return files.filter(F.contains("path", F.lit("/"))).select("id", "path", F.explode(tails).alias("tail"))


def _folded(c: str) -> Column:
    """A to Z in lower case, other letters as they are."""
    return F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def target_hits(nodes: DataFrame, targets: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target) asked for, and (target, rank, id) of all nodes that a rule names; the rule of least rank counts.

    What begins as a node id is one or nothing. What has a slash or a known
    suffix is a whole path, else the end of one, whatever the case of A to Z.
    Anything else is the name of a function, class or method in any case, else
    the name of a file. External nodes are no targets. All is taken literally.
    """
    asked = targets.select("target").distinct() if isinstance(targets, DataFrame) else nodes.sparkSession.createDataFrame([(t,) for t in targets], "target string").distinct()
    own = nodes.filter("not external").select("id", "type", "name", "path")
    files = own.filter("type = 'file' and path is not null")
    kind = F.when(F.col("target").rlike(NODE_ID), "id").when(F.lower("target").rlike(PATH_LIKE), "path").otherwise("name")
    asked = asked.withColumn("kind", kind)
    of = lambda k: asked.filter(F.col("kind") == k).select("target")
    ends = path_ends(files)
    folded = of("path").withColumn("tail", _folded("target")).join(ends.select("id", _folded("tail").alias("tail")), "tail")
    named = own.filter("type in ('function', 'class', 'method')").select("id", _folded("name").alias("folded"))
    last = files.select("id", F.substring_index("path", "/", -1).alias("target"))
    tries = (
        of("id").join(own.select("id", F.col("id").alias("target")), "target"),
        of("path").join(files.select("id", F.col("path").alias("target")), "target"),
        folded,
        of("name").withColumn("folded", _folded("target")).join(named, "folded"),
        of("name").join(last.unionByName(ends.select("id", F.col("tail").alias("target"))).distinct(), "target"),
    )
    hits = None
    for rank, found in enumerate(tries):
        one = found.select("target", F.lit(rank).alias("rank"), "id")
        hits = one if hits is None else hits.unionByName(one)
    return asked, hits


def resolve_targets(nodes: DataFrame, targets: list[str] | DataFrame) -> DataFrame:
    """(target, status, id) of each target: found, multiple (with the smallest id) or not-found, by the rules of ``target_hits``."""
    asked, hits = target_hits(nodes, targets)
    best = hits.groupBy("target", "rank").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).groupBy("target").agg(F.min_by(F.struct("n", "id"), "rank").alias("hit"))
    status = F.when(F.col("hit").isNull(), "not-found").when(F.col("hit.n") == 1, "found").otherwise("multiple")
    return asked.select("target").join(best, "target", "left").select("target", status.alias("status"), F.col("hit.id").alias("id"))


def candidates(nodes: DataFrame, targets: list[str] | DataFrame) -> DataFrame:
    """(target, id, type, path) of every node that a target may mean: those of its first rule that names any."""
    _, hits = target_hits(nodes, targets)
    first = hits.groupBy("target").agg(F.min("rank").alias("rank"))
    return hits.join(first, ["target", "rank"]).select("target", "id").distinct().join(nodes.select("id", "type", "path"), "id").select("target", "id", "type", "path")
