"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every end of ``edges`` (a, b, longs); root is the smallest node of the component.

    In each round every vertex hooks onto that of its neighbours and itself
    which comes first in an order that is drawn anew, by hash, for the round,
    and the edges are contracted. Whatever the labels, half the vertices of a
    path go in expectation, more where vertices have more neighbours, and a
    star is done in two rounds or so. Each round's tables are written to the
    shared folder. Neither edges nor vertices reach the driver.
    """
    edges = materialize(edges.select("a", "b").filter("a != b").distinct(), "components-edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = materialize(ends.withColumn("root", F.col("node")), "components-roots")
    turn = 0
    while not edges.isEmpty():
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
        hooks = materialize(both.groupBy("v").agg(F.min(drawn("u")).alias("best")).select("v", F.least("best", drawn("v"))["to"].alias("to")), "components-hooks")
        roots = materialize(roots.join(hooks, roots["root"] == hooks["v"], "left").select("node", F.coalesce("to", "root").alias("root")), "components-roots")
        first = edges.join(hooks, edges["a"] == hooks["v"]).select(F.col("to").alias("a"), "b")
        second = first.join(hooks, first["b"] == hooks["v"]).select("a", F.col("to").alias("b"))
        edges = materialize(second.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
        turn += 1
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return materialize(roots.join(least, "root").select("node", F.col("least").alias("root")), "components-named")
