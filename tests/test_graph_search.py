"""Searches, components, cycles and coverage against plain searches over small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions.keep import keep
from graphloom.functions.ship import ship
from graphloom.operators import analysis, coverage, cycles, reach

PAIR = "src string, dst string"


def graph(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):04}", f"n{r.randrange(n):04}") for _ in range(m)})


def plain_reach(edges, start):
    """node: (depth, parent) by search in breadth, smallest parent first."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    ways, front, depth = {}, [start], 0
    while front:
        depth += 1
        new = {}
        for node in sorted(front):
            for to in out.get(node, ()):
                if to not in ways:
                    new.setdefault(to, (depth, node))
        ways |= new
        front = list(new)
    return ways


def plain_components(edges):
    edges = [e for e in edges if e[0] != e[1]]
    nodes = sorted({x for e in edges for x in e})
    reached = {n: set(plain_reach(edges, n)) for n in nodes}
    out = {}
    for n in nodes:
        own = {m for m in reached[n] if n in reached[m]} | {n}
        if len(own) > 1:
            out[n] = min(own)
    return out


def plain_cycle(members, edges):
    """By trying every simple path in order."""
    out = {}
    for a, b in sorted(edges):
        if a in members and b in members and a != b:
            out.setdefault(a, []).append(b)
    start = min(members)

    def go(path):
        for to in out.get(path[-1], ()):
            if to == start:
                return path
            if to not in path and (found := go([*path, to])):
                return found
        return None

    return go([start])


def test_closure_of_many_roots(spark):
    edges = sorted({*graph(1, 150, 600), ("n0001", "n0001")})
    roots = [f"n{i:04}" for i in range(150)] + ["nowhere"]
    frame = spark.createDataFrame([(*e, "x") for e in edges] + [(*edges[0], "a"), (None, "n0001", "x"), ("n0001", None, "x")], f"{PAIR}, relation string")
    seeds = spark.createDataFrame([(n, n) for n in roots] * 2, "root string, node string")
    got = {(r["root"], r["node"]): (r["depth"], r["parent"]) for r in reach.closure(seeds, frame).collect()}
    wanted = {(root, node): way for root in roots for node, way in plain_reach(edges, root).items()}
    assert got == wanted
    assert {tuple(r) for r in reach.reach_sets(seeds, frame).collect()} == set(wanted)
    one = seeds.filter("root in ('n0003', 'n0077', 'nowhere')").select("node")
    assert sorted(r["node"] for r in reach.reached(one, frame).collect()) == sorted({n for root, n in wanted if root in ("n0003", "n0077")})


def test_closure_of_a_long_path_merges_its_runs(spark):
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(24)]
    frame = spark.createDataFrame([(*e, "x") for e in edges], f"{PAIR}, relation string")
    got = reach.closure(spark.createDataFrame([("r", "n0000")], "root string, node string"), frame).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == [(f"n{i:04}", i) for i in range(1, 25)]


@pytest.mark.parametrize(("seed", "n", "m", "rest"), [(3, 30, 60, 0), (4, 200, 220, 20), (5, 30, 300, 1000)])
def test_components_equal_mutual_reach(spark, seed, n, m, rest):
    ship(spark)
    edges = graph(seed, n, m)
    got = {r["id"]: r["component"] for r in cycles.components(spark.createDataFrame(edges, PAIR), rest=rest).collect()}
    assert got == plain_components(edges)


def test_components_of_rings_with_tails(spark):
    ring = lambda p, k: [(f"{p}{i:03}", f"{p}{(i + 1) % k:03}") for i in range(k)]
    edges = ring("a", 50) + ring("b", 2) + ring("c", 7) + [("a003", "c001"), ("c004", "t1"), ("t1", "t2"), ("s", "a000"), ("x", "x"), ("c002", "c005"), ("a010", "u1"), ("u1", "u2"), ("u2", "a010")]
    got = {r["id"]: r["component"] for r in cycles.components(spark.createDataFrame(edges, PAIR), rest=0).collect()}
    assert got == plain_components(edges)
    assert cycles.components(spark.createDataFrame([], PAIR)).count() == 0


def test_components_of_a_long_path_take_few_rounds(spark):
    n, rounds = 10_000, []
    order = [f"n{i:05}" for i in random.Random(0).sample(range(n), n)]
    path = [*zip(order, order[1:], strict=False), ("r1", "r2"), ("r2", "r1")]
    got = cycles.components(spark.createDataFrame(path, PAIR), rounds, 0).collect()
    assert {tuple(r) for r in got} == {("r1", "r1"), ("r1", "r2")}
    assert len(rounds) < 40


def test_components_of_a_long_ring(spark):
    n, rounds = 500, []
    order = [f"n{i:05}" for i in random.Random(1).sample(range(n), n)]
    ring = [*zip(order, order[1:] + order[:1], strict=True)]
    got = cycles.components(spark.createDataFrame(ring, PAIR), rounds, 0)
    assert got.count() == n and [r["component"] for r in got.select("component").distinct().collect()] == ["n00000"]
    assert len(rounds) < 40


def test_components_of_many_small_pieces_take_few_rounds(spark):
    """Labels are not learned over pieces that one task can finish; a larger piece beside them is still found."""
    ship(spark)
    many = sorted({(f"p{k:02}{a}", f"p{k:02}{b}") for k in range(60) for a, b in graph(k, 12, 40) if a != b})
    ring = [f"r{i:03}" for i in range(60)]
    large = [(a, b) for i, a in enumerate(ring) for b in (ring[(i + 1) % 60], ring[(i + 7) % 60])]
    rounds = []
    got = {r["id"]: r["component"] for r in cycles.components(spark.createDataFrame(many + large, PAIR), rounds, 100).collect()}
    assert got == plain_components(many + large)
    rounds = []
    cycles.components(spark.createDataFrame(many, PAIR), rounds, 100)
    assert len(rounds) < 10


def test_components_of_many_edges_are_found_over_few_first(spark):
    """Rounds go over four edges of a node or fewer, and over what the components of these leave; every edge counts."""
    ship(spark)
    r = random.Random(12)
    edges = graph(12, 60, 900) + [(f"a{a}", f"a{b}") for a, b in graph(13, 30, 300) if a < b]  # a large component and much without circles
    edges += [(f"n{r.randrange(60):04}", f"an{r.randrange(30):04}") for _ in range(20)] + [("x1", "n0003"), ("n0004", "x1"), ("y1", "y2"), ("y2", "y1"), ("y1", "y1")]
    for rest in (0, 30):
        rounds = []
        got = {x["id"]: x["component"] for x in cycles.components(spark.createDataFrame(edges * 2, PAIR), rounds, rest).collect()}
        assert got == plain_components(edges)
        assert max(n for n in rounds if n) < len(edges) / 2


def test_nodes_of_one_number_are_numbered_anew(spark, monkeypatch):
    drawn = cycles._drawn
    monkeypatch.setattr(cycles, "_drawn", lambda turn, c: F.pmod(drawn(turn, c), F.lit(40)) if turn < 3 else drawn(turn, c))
    names, numbered = cycles._numbered(spark.createDataFrame(graph(14, 30, 60), PAIR))
    assert names.count() == names.select("number").distinct().count()
    assert numbered.distinct().count() == len(set(graph(14, 30, 60)))


def test_what_is_kept_is_planned_with_its_own_size(spark):
    """Not with that guessed for its joins, which squares each round."""
    frame = spark.range(100).selectExpr("id", "id + 1 as to")
    for _ in range(6):
        frame = keep(frame.join(frame.selectExpr("id as to", "to as then"), "to", "left").selectExpr("id", "coalesce(then, to) as to"))
    assert frame.count() == 100
    assert int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


@pytest.mark.parametrize("longest", [cycles.LONGEST, 0])
def test_representative_cycles_follow_the_walk(spark, longest):
    ship(spark)
    edges = graph(7, 9, 16) + [("p", "q"), ("q", "p"), ("q", "q")]
    frame = spark.createDataFrame(edges, PAIR)
    members = cycles.components(frame)
    wanted, known = {}, plain_components(edges)
    for name in set(known.values()):
        own = {m for m, c in known.items() if c == name}
        wanted[name] = (len(own), plain_cycle(own, edges))
    rows = cycles.representative_cycles(frame, members, longest).collect()
    assert {r["component"]: (r["size"], r["path"]) for r in rows} == wanted
    assert all(r["length"] == len(r["path"]) for r in rows)
    assert [(-r["size"], r["component"]) for r in rows] == sorted((-r["size"], r["component"]) for r in rows)


def test_a_walk_that_has_to_come_back(spark):
    ship(spark)
    # a - b leads nowhere but back into the walk, a - c closes
    edges = [("a", "b"), ("b", "d"), ("d", "b"), ("d", "e"), ("e", "d"), ("b", "f"), ("f", "c"), ("c", "a"), ("e", "b")]
    frame = spark.createDataFrame(edges, PAIR)
    members = cycles.components(frame)
    for longest in (cycles.LONGEST, 0):
        row = cycles.representative_cycles(frame, members, longest).first()
        assert row["path"] == plain_cycle(set("abcdef"), edges) == ["a", "b", "f", "c"]


def test_coverage_equals_plain_reach(spark):
    r = random.Random(9)
    names = [f"tests/t{i}.py" if i % 4 == 0 else f"src/s{i}.py" for i in range(60)]
    edges = [(f"f:{names[a]}", f"f:{names[b]}") for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(75))]
    edges += [("f:tests/t0.py", "f:tests/t4.py"), ("f:tests/t4.py", "f:tests/t0.py"), ("f:tests/t8.py", "xm:os")]
    nodes = spark.createDataFrame([(f"f:{p}", "file", p) for p in names] + [("xm:os", "module", None)], "id string, type string, path string")
    frame = spark.createDataFrame([(a, b, "imports", "resolved") for a, b in edges], f"{PAIR}, type string, confidence string")
    wanted = {(t, n[2:]) for t in names if t.startswith("tests/") for n in plain_reach(edges, f"f:{t}") if n.startswith("f:src/")}
    assert {tuple(x) for x in coverage.coverage_pairs(nodes, frame, paths.is_test).collect()} == wanted
    assert {x["path"] for x in coverage.covered_files(nodes, frame, paths.is_test).collect()} == {p for _, p in wanted}


def test_files_of_a_component_share_their_tests(spark):
    circle = [f"src/s{i:02}.py" for i in range(40)]
    tests = [f"tests/t{i}.py" for i in range(70)]
    edges = [(a, b) for a, b in zip(circle, circle[1:] + circle[:1])] + [(t, circle[3]) for t in tests] + [(circle[7], "src/end.py"), (circle[9], tests[0]), ("src/alone.py", circle[0])]
    nodes = spark.createDataFrame([(f"f:{p}", "file", p) for p in [*circle, *tests, "src/end.py", "src/alone.py"]], "id string, type string, path string")
    frame = spark.createDataFrame([(f"f:{a}", f"f:{b}", "imports", "resolved") for a, b in edges], f"{PAIR}, type string, confidence string")
    covered, sets = coverage.coverage_sets(nodes, frame, paths.is_test)
    assert [r["tests"] for r in sets.collect()] == [sorted(tests)] * 2 and covered.count() == 41  # a list for the circle and one for the end
    history = spark.createDataFrame([], "path string, commits_total long, commits_in_window long")
    rows = {r["path"]: (r["tested"], r["tests"]) for r in analysis.risk(nodes, history, covered, None, sets).collect()}
    assert rows == {p: (True, sorted(tests)) for p in [*circle, "src/end.py"]} | {"src/alone.py": (False, [])}
    pairs = coverage.coverage_pairs(nodes, frame, paths.is_test)
    plain = {r["path"]: (r["tested"], r["tests"]) for r in analysis.risk(nodes, history, pairs).collect()}
    assert plain == rows


def circle_with_tests(spark):
    """300 files in a circle that 50 tests reach, and one that they don't."""
    circle, tests = [f"src/s{i:03}.py" for i in range(300)], [f"tests/t{i:02}.py" for i in range(50)]
    edges = [*zip(circle, circle[1:] + circle[:1], strict=True), *((t, circle[3]) for t in tests), ("src/alone.py", circle[0])]
    nodes = spark.createDataFrame([(f"f:{p}", "file", p) for p in [*circle, *tests, "src/alone.py"]], "id string, type string, path string")
    return nodes, spark.createDataFrame([(f"f:{a}", f"f:{b}", "imports", "resolved") for a, b in edges], f"{PAIR}, type string, confidence string"), circle, tests


def test_pairs_are_dealt_to_tasks_by_how_many_they_are(spark, monkeypatch):
    """Files are short rows, so few tasks may hold them all; the pairs made of them are dealt."""
    monkeypatch.setattr(coverage, "NAMES_A_TASK", 1000, raising=False)
    nodes, frame, circle, tests = circle_with_tests(spark)
    pairs = coverage.coverage_pairs(nodes, frame, paths.is_test).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert sum(sizes) == 300 * 50 and max(sizes) <= 2000
    assert {(r["test"], r["path"]) for r in pairs.collect()} == {(t, p) for t in tests for p in circle}


def test_risks_take_texts_of_tests_made_once(spark, monkeypatch):
    """A list is joined to a text where it is one row, not in each file's; rows with long texts are dealt."""
    monkeypatch.setattr(coverage, "NAMES_A_TASK", 1000, raising=False)
    nodes, frame, circle, tests = circle_with_tests(spark)
    covered, sets = coverage.coverage_sets(nodes, frame, paths.is_test)
    sets = sets.withColumn("tests", F.array_join("tests", ","))
    history = spark.createDataFrame([], "path string, commits_total long, commits_in_window long")
    risks = analysis.risk(nodes, history, covered, None, sets)
    assert {r["path"]: (r["tested"], r["tests"]) for r in risks.collect()} == {p: (True, ",".join(tests)) for p in circle} | {"src/alone.py": (False, "")}
    sizes = [r["count"] for r in risks.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 301 and max(sizes) <= 40


def test_condensed_edges_have_no_circles(spark):
    edges = spark.createDataFrame(graph(11, 40, 70), PAIR)
    members = cycles.components(edges)
    got = [tuple(r) for r in coverage.condensed(edges, members).collect()]
    assert not plain_components(got) and all(a != b for a, b in got)
    wanted = {r["id"]: r["component"] for r in members.collect()}
    assert set(got) == {(wanted.get(a, a), wanted.get(b, b)) for a, b in map(tuple, edges.collect()) if wanted.get(a, a) != wanted.get(b, b)}


