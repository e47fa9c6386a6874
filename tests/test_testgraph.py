"""The test graph takes every row of its tables."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions.keep import dealt_by
from graphloom.operators import resolve
from graphloom.plans import catalogue, testgraph

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet").toPandas() for t in testgraph.BASE}


def most(rows, keys, target):
    """Of each key the target with most rows, the smallest of equals."""
    counted = rows.groupby([*keys, target]).size().rename("n").reset_index().sort_values(["n", target], ascending=[False, True])
    return {tuple(r) for r in counted.groupby(keys, dropna=False).head(1)[[*keys, target]].itertuples(index=False)}


def test_every_line_and_order_counts(spark, tables):
    lines, orders, customers, parts = tables["lineitem"], tables["orders"], tables["customer"], tables["part"]
    edges = testgraph.edges(spark, SMALL)
    assert edges.filter("type = 'imports' and dst like 'xm:%'").count() == len(most(lines, ["l_partkey"], "l_suppkey"))
    # the total order of an order's lines, as in LINES
    lines = lines.sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    follows = lines.assign(b=lines.groupby("l_orderkey")["l_partkey"].shift(-1)).dropna(subset="b").rename(columns={"l_partkey": "a"})
    follows = follows[follows["a"] != follows["b"]]
    layer = parts.set_index("p_partkey")["p_size"]
    la, lb = follows["a"].map(layer), follows["b"].map(layer)
    turned = follows.assign(src=follows["a"].where(la <= lb, follows["b"]).astype(int), dst=follows["b"].where(la <= lb, follows["a"]).astype(int), kind=follows["l_linestatus"].where(la != lb, "same"))
    both = {(a, int(b)) for a, b in zip(follows["a"], follows["b"], strict=True)}
    wanted = {(src, dst) for src, _, dst in most(turned, ["src", "kind"], "dst")} | {(a, b) for a, b in both if (b, a) in both}
    number = F.regexp_extract  # of a path
    got = edges.filter("type = 'imports' and dst like 'f:%'").select(number("src", "p([0-9]+)[.]py", 1).cast("long"), number("dst", "p([0-9]+)[.]py", 1).cast("long")).collect()
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
    after = orders.assign(o_orderkey=orders["o_orderkey"] - 1)[["o_orderkey", "o_custkey"]].rename(columns={"o_custkey": "callee"})
    loose = orders.merge(after, on="o_orderkey").query("o_orderstatus == 'P' and o_custkey != callee")
    assert edges.filter("type = 'calls' and dst is null").count() == loose["o_custkey"].nunique()
    kept = customers[customers["c_custkey"] % 3 != 0]["c_custkey"]
    assert edges.filter("type = 'references'").count() == orders[orders["o_custkey"].isin(kept)]["o_custkey"].nunique()


def test_all_edges_are_every_pair(spark, tables):
    lines, orders = tables["lineitem"], tables["orders"]
    edges = testgraph.all_edges(spark, SMALL)
    lines = lines.sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    follows = lines.assign(b=lines.groupby("l_orderkey")["l_partkey"].shift(-1)).dropna(subset="b")
    assert edges.filter("type = 'imports' and dst like 'f:%'").count() == len(follows[["l_partkey", "b"]].drop_duplicates())
    assert edges.filter("type = 'imports' and dst like 'xm:%'").count() == len(lines[["l_partkey", "l_suppkey"]].drop_duplicates())
    after = orders.assign(o_orderkey=orders["o_orderkey"] - 1)[["o_orderkey", "o_custkey"]].rename(columns={"o_custkey": "callee"})
    calls = orders.merge(after, on="o_orderkey").assign(loose=lambda x: x["o_orderstatus"] == "P", line=lambda x: x["o_orderkey"] % 500 + 1)
    assert edges.filter("type = 'calls'").count() == len(calls[["o_custkey", "callee", "loose", "line"]].drop_duplicates())
    # what the queries take
    by_type = {r["type"]: r["n"] for r in catalogue.QUERIES["edge_counts_by_type"](spark, SMALL).collect()}
    assert by_type == {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()}


def test_imports_of_files_are_those_of_all_edges(spark):
    wanted = testgraph.all_edges(spark, SMALL).filter("type = 'imports' and dst like 'f:%'")
    got = testgraph.file_imports(spark, SMALL)
    assert got.columns == wanted.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert not any("once" not in f for f in catalogue._components(spark, SMALL, "imports", testgraph.file_imports).inputFiles())


def test_the_main_edges_have_structure(spark):
    small = "/root/testdata/sf0.01"
    covered = catalogue._covered(spark, small, testgraph.edges)
    assert 0.2 < catalogue.A.coverage_summary(testgraph.nodes(spark, small), covered).first()["ratio"] < 0.8
    parts = catalogue._components(spark, small, "imports", testgraph.edges).groupBy("component").count().collect()
    assert len(parts) > 20


def test_every_line_is_a_commit_and_measured(spark, tables):
    lines = tables["lineitem"]
    assert testgraph.commits(spark, SMALL).count() == len(lines[["l_orderkey", "l_partkey"]].drop_duplicates())
    assert testgraph.complexity(spark, SMALL).count() == len(lines[["l_partkey", "l_linenumber"]].drop_duplicates())


def test_records_take_every_line_and_order(spark, tables):
    records = catalogue._table_records(spark, SMALL)
    calls = records.select(F.sum(F.size("calls"))).first()[0]
    orders, parts = tables["orders"], tables["part"]
    after = orders.assign(o_orderkey=orders["o_orderkey"] - 1)[["o_orderkey", "o_custkey"]].rename(columns={"o_custkey": "callee"})
    pairs = orders.merge(after, on="o_orderkey").assign(ambiguous=lambda x: x["o_orderstatus"] == "P", line=lambda x: x["o_orderkey"] % 500 + 1)
    assert calls == len(pairs[["o_custkey", "callee", "ambiguous", "line"]].drop_duplicates())
    in_file = tables["customer"]["c_custkey"] % len(parts)
    beside = in_file.map(in_file.value_counts())
    named = orders["o_custkey"].map(dict(zip(tables["customer"]["c_custkey"], beside, strict=True))).sum()
    assert records.select(F.sum(F.size("references"))).first()[0] == named
    lines = tables["lineitem"].sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    follows = lines.assign(b=lines.groupby("l_orderkey")["l_partkey"].shift(-1)).dropna(subset="b")
    follows = follows[follows["l_partkey"] != follows["b"]]
    assert records.select(F.sum(F.size("imports"))).first()[0] == len(follows[["l_partkey", "b"]].drop_duplicates())


def test_more_rows_are_dealt_to_more_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    with dealt_by(spark, 1_000_000, 10_000):
        assert spark.conf.get(name) == "100"
    assert spark.conf.get(name, None) == before
    with dealt_by(spark, 10, 10_000):
        assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")


def test_what_is_put_together_stays_small(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    with dealt_by(spark, 1_000_000, 10_000):
        assert spark.conf.get(size) == "16m"
    assert spark.conf.get(size, None) == before


def test_records_are_made_once_and_results_in_dealt_tasks(spark):
    made = [catalogue.QUERIES[name](spark, SMALL) for name in ("call_resolution_plain", "import_resolution", "reference_edges")]
    assert not any("lineitem" in f or "orders" in f for df in made for f in df.inputFiles())


def test_an_import_means_the_same_from_anywhere_unless_relative(spark):
    rows = [("a/x.py", "python", [("m.n",), (".n",), ("..k",), ("no",)]), ("b/y.py", "python", [("m.n",), (".n",), ("..k",)]), ("m/n.py", "python", [(None,)]), ("b/n.py", "python", []), ("k/__init__.py", "python", []), ("b/z.ts", "typescript", [("./q//../n",), ("m.n",)]), ("b/n.tsx", "tsx", [])]
    files = spark.createDataFrame(rows, "path string, language string, imports array<struct<specifier:string>>")
    got = {(r["path"], r["specifier"]): r["target"] for r in resolve.resolve_imports(files).collect()}
    assert got == {
        ("a/x.py", "m.n"): "m/n.py", ("a/x.py", ".n"): None, ("a/x.py", "..k"): "k/__init__.py", ("a/x.py", "no"): None, ("b/y.py", "m.n"): "m/n.py", ("b/y.py", ".n"): "b/n.py",
        ("b/y.py", "..k"): "k/__init__.py", ("m/n.py", None): None, ("b/z.ts", "./q//../n"): "b/n.tsx", ("b/z.ts", "m.n"): None,
    }
    hits = resolve.import_candidates(files.select("path", "language", F.explode("imports.specifier").alias("specifier")).filter("specifier = 'm.n' and language = 'python'"))
    assert {r["candidate"] for r in hits.collect()} == {"m/n.py", "m/n/__init__.py"}
