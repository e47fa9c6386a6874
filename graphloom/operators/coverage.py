"""Which tests reach which files over imports.

Files that import each other in a circle are reached together, so the import
graph is condensed first: what is handed on, 64 tests a word, goes along the
edges between components, and a component's members are told at the end only.
Whether a file is covered at all needs no tests' names: one search from all
tests at once, a row a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.operators.cycles import components
from graphloom.operators.reach import reach_lists, reached
from graphloom.schema import RESOLVED

SENT_NAMES = 1_000_000  # names of tests, counted, that are sent to the files: some 25 MB
NAMES_A_TASK = 4_000_000  # names of tests, counted, in the rows that a task makes


def _files(nodes: DataFrame, is_test) -> DataFrame:
    return nodes.filter("type = 'file' and path is not null").select("id", "path", is_test(F.col("path")).alias("test"))


def _imports(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("type") == "imports") & (F.col("confidence") == RESOLVED) & F.col("dst").isNotNull()).select("src", "dst")


def condensed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst) between components and single nodes, none to itself; ``members`` (component, id) names the components of two or more."""
    named = edges
    for end in ("src", "dst"):
        own = members.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
        named = named.join(own, end, "left")
    named = named.select(*(F.coalesce(f"{end}_component", end).alias(end) for end in ("src", "dst")))
    return named.filter("src != dst").distinct()


def coverage_sets(nodes: DataFrame, edges: DataFrame, is_test, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, of) of the covered files that are no tests, and (of, tests, names): the test files, sorted, that reach them over resolved imports, also through other tests, and how many they are.

    Files of a component share a list, so lists grow with the components and
    not with the files. ``members`` are the components of the imports, if they
    are known already.
    """
    files, imports = _files(nodes, is_test), _imports(edges)
    if members is None:
        imports = keep(imports.distinct())
        members = components(imports)
    placed = keep(files.join(members, "id", "left").withColumns({"round": F.col("component").isNotNull(), "component": F.coalesce("component", "id")}))
    tests = placed.filter("test").select(F.col("path").alias("root"), F.col("component").alias("node"), "round")
    found = reach_lists(tests, condensed(imports, members)).union(tests.filter("round").select("node", F.array("root")))
    wanted = placed.filter("not test").select("path", F.col("component").alias("of"))
    sets = found.groupBy(F.col("node").alias("of")).agg(F.array_sort(F.flatten(F.collect_list("roots"))).alias("tests")).withColumn("names", F.size("tests"))
    sets = keep(sets.join(wanted.select("of").distinct(), "of", "left_semi"))
    return wanted.join(sets.select("of"), "of", "left_semi").select("path", "of"), sets


def with_tests(rows: DataFrame, sets: DataFrame, covered: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (of, ...) with the ``tests`` of ``sets``: what makes long rows, so nothing should be shuffled after it; few names, counted, are sent to the rows.

    Rows are short before, and a few tasks could hold them all, so they are
    dealt to tasks by the names that the files of ``covered`` will have.
    """
    files = covered.groupBy("of").agg(F.count("*").alias("files"))
    counted = sets.join(files, "of", "left").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("names", F.col("names") * F.col("files"))))
    names, made = counted.first()
    if made > NAMES_A_TASK:
        rows = rows.repartition(max(made // NAMES_A_TASK + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sets = sets.drop("names")
    return rows.join(F.broadcast(sets) if names <= SENT_NAMES else sets, "of", how).drop("of")


def coverage_pairs(nodes: DataFrame, edges: DataFrame, is_test, members: DataFrame | None = None) -> DataFrame:
    """(test, path) of ``coverage_sets``."""
    covered, sets = coverage_sets(nodes, edges, is_test, members)
    return with_tests(covered, sets, covered).select(F.explode("tests").alias("test"), "path")


def covered_files(nodes: DataFrame, edges: DataFrame, is_test) -> DataFrame:
    """(path) of the files, no tests, that any test reaches."""
    files = _files(nodes, is_test)
    found = reached(files.filter("test").select(F.col("id").alias("node")), _imports(edges))
    return files.filter("not test").join(found, F.col("id") == F.col("node"), "left_semi").select("path")
