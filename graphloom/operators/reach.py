"""Reachability over edges: blast radius, scope seeds, what a set reaches.

Searches run breadth-first for all roots at once. Roots are numbered, 64 make a
block, and a row of a search is a node and a block with the bits of the roots
that have come there, so that one row and one join serve up to 64 roots. A
round joins only what the last round found with the edges, and takes out the
bits that were there before. Rounds are checkpointed in the shared folder, so
that plans don't grow with depth; what was found is appended, and runs of like
size are merged, so that each row is written again a few times at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.functions.paths import last_segment
from graphloom.schema import AMBIGUOUS, DEPENDENCY, RESOLVED

RUNS = 4  # that are left unmerged
SENT = 50_000  # rows of a front, counted, up to which it goes to the edges, rather than the edges to it


class Found:
    """What a search has found, as a few runs; small ones are merged as they come."""

    def __init__(self):
        self.runs: list[tuple[DataFrame, int]] = []

    def add(self, rows: DataFrame, n: int) -> None:
        self.runs.append((rows, n))
        while len(self.runs) > RUNS and self.runs[-2][1] <= 2 * self.runs[-1][1]:
            (a, n), (b, m) = self.runs[-2:]
            self.runs[-2:] = [(keep(a.unionByName(b)), n + m)]
        if len(self.runs) > 4 * RUNS:
            self.runs = [(keep(self.all()), sum(n for _, n in self.runs))]

    def all(self) -> DataFrame:
        out = self.runs[0][0]
        for rows, _ in self.runs[1:]:
            out = out.unionByName(rows)
        return out


def _numbered(seeds: DataFrame) -> DataFrame:
    """(root, block, bit): neighbours in order share blocks, as they tend to reach the same nodes."""
    numbered = seeds.select("root").distinct().sort("root").withColumn("number", F.monotonically_increasing_id())
    return keep(numbered.select("root", F.shiftright("number", 6).alias("block"), F.expr("shiftleft(1L, cast(number & 63 as int))").alias("bit")))


def _fresh(step: DataFrame, found: Found) -> DataFrame:
    """``step`` (node, block, bits, ...) without the bits that were found before."""
    if not found.runs:
        return step
    old = found.all().groupBy("node", "block").agg(F.bit_or("bits").alias("old"))
    left = step.join(old, ["node", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))))
    return left.filter("bits != 0").drop("old")


def _search(seeds: DataFrame, edges: DataFrame, ways: bool) -> tuple[DataFrame, Found]:
    """The numbered roots, and (node, block, bits, depth) of all that they reach; with ``ways`` a row for each (parent, relation) that bits came by first."""
    roots = _numbered(seeds)
    front = seeds.join(roots, "root").groupBy("node", "block").agg(F.bit_or("bit").alias("bits"))
    found, depth, n = Found(), 0, SENT + 1
    while True:
        depth += 1
        step = (F.broadcast(front) if n <= SENT else front).join(edges, front["node"] == edges["src"])
        if ways:
            step = _fresh(step.select(F.col("dst").alias("node"), "block", "bits", F.col("src").alias("parent"), "relation"), found)
            before = Window.partitionBy("node", "block").orderBy("parent", "relation").rowsBetween(Window.unboundedPreceding, -1)
            taken = F.coalesce(F.bit_or("bits").over(before), F.lit(0).cast("long"))
            step = step.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(taken))).filter("bits != 0")
        else:
            step = _fresh(step.groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits")), found)
        step = keep(step.withColumn("depth", F.lit(depth)))
        n = step.count()
        if not n:
            return roots, found
        found.add(step, n)
        front = step.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))


def _inside(roots: DataFrame, found: Found) -> DataFrame:
    """What was found, with the names of its ``roots``."""
    blocks = roots.groupBy("block").agg(F.collect_list(F.struct("root", "bit")).alias("own"))
    inside = F.filter("own", lambda x: x["bit"].bitwiseAND(F.col("bits")) != 0)
    return found.all().join(blocks, "block").withColumn("roots", F.transform(inside, lambda x: x["root"]))


def _each(roots: DataFrame, found: Found, columns: list[str]) -> DataFrame:
    """A row for each root and node."""
    return _inside(roots, found).select(F.explode("roots").alias("root"), "node", *columns)


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth, parent, relation) of all nodes that ``seeds`` (root, node) reach over ``edges`` (src, dst, relation).

    depth is the least number of edges, at least 1; seeds are in the result only
    if an edge leads back to them. Of several ways of least depth the smallest
    (parent, relation) is told.
    """
    spark = seeds.sparkSession
    edges = keep(edges.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("relation").alias("relation")))
    roots, found = _search(keep(seeds.select("root", "node").distinct()), edges, True)
    if not found.runs:
        return spark.createDataFrame([], "root string, node string, depth int, parent string, relation string")
    return _each(roots, found, ["depth", "parent", "relation"])


def reach_sets(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node) as ``closure``, without ways."""
    edges = keep(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    roots, found = _search(keep(seeds.select("root", "node").distinct()), edges, False)
    if not found.runs:
        return seeds.sparkSession.createDataFrame([], "root string, node string")
    return _each(roots, found, [])


def reach_lists(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, roots): who comes to each node as ``reach_sets``, in a row for each block of roots and round that brought some, each root in one of them."""
    edges = keep(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    roots, found = _search(keep(seeds.select("root", "node").distinct()), edges, False)
    if not found.runs:
        return seeds.sparkSession.createDataFrame([], "node string, roots array<string>")
    return _inside(roots, found).select("node", "roots")


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): what any of ``seeds`` (node) reaches by one edge or more; one row a node, whoever came first."""
    edges = keep(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    front, found, n = seeds.select("node").distinct(), Found(), SENT + 1
    while True:
        step = (F.broadcast(front) if n <= SENT else front).join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        if found.runs:
            step = step.join(found.all(), "node", "left_anti")
        front = keep(step)
        n = front.count()
        if not n:
            return found.all() if found.runs else front
        found.add(front, n)


def confirmed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Dependents of ``roots`` (root) over resolved calls, imports and inherits, backwards."""
    back = edges.filter((F.col("confidence") == RESOLVED) & F.col("type").isin(*DEPENDENCY)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("type").alias("relation"))
    return closure(roots.select("root", F.col("root").alias("node")), back)


def ambiguous_only(nodes: DataFrame, edges: DataFrame, roots: DataFrame, certain: DataFrame) -> DataFrame:
    """Sources of unresolved edges whose last segment is the root's name, unless already certain; depth 1, no parent."""
    names = nodes.join(roots, nodes["id"] == roots["root"]).select("root", nodes["name"].alias("wanted"))
    loose = edges.filter((F.col("confidence") == AMBIGUOUS) & F.col("callee_text").isNotNull()).select(F.col("src").alias("node"), last_segment(F.col("callee_text")).alias("wanted"))
    found = loose.join(names, "wanted").select("root", "node").distinct().join(certain, ["root", "node"], "left_anti")
    return found.select("root", "node", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit("ambiguous-reference").alias("relation"))


def blast_radius(nodes: DataFrame, edges: DataFrame, root_id: str | DataFrame) -> DataFrame:
    """(root, node, depth, parent, relation, via) of everything that depends on a root, or on each of many (root).

    A root on a cycle, or one that calls itself, is among its own dependents.
    An unknown root is an error.
    """
    spark = nodes.sparkSession
    roots = root_id if isinstance(root_id, DataFrame) else spark.createDataFrame([(root_id,)], "root string")
    roots = keep(roots.select("root").distinct())
    if roots.join(nodes, roots["root"] == nodes["id"], "left_anti").limit(1).count():
        raise ValueError("blast radius of an unknown node")
    certain = confirmed(edges, roots)
    loose = ambiguous_only(nodes, edges, roots, certain)
    via = F.when(F.col("relation") == "ambiguous-reference", "ambiguous").otherwise("resolved")
    return certain.unionByName(loose).withColumn("via", via)


def scope_seeds(edges: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, id): each scope and what it defines, down to methods."""
    defines = edges.filter((F.col("type") == "defines") & (F.col("confidence") == RESOLVED))
    below = reach_sets(scopes.select(F.col("scope").alias("root"), F.col("scope").alias("node")), defines)
    return scopes.select("scope", F.col("scope").alias("id")).union(below.select("root", "node")).distinct()
