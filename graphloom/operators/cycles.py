"""Dependency cycles: strongly connected components and a representative cycle of each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keep import keep
from graphloom.functions.ship import ship
from graphloom.schema import RESOLVED

LONGEST = 100_000  # edges of a component that one task walks; larger ones are walked in rounds
REST = 200_000  # edges, counted, that one task finishes once rounds have left no more: some 80 MB
DENSE = 8  # edges a node, counted, from which those of few edges of each node are found first


def cycle_edges(edges: DataFrame, kind: str) -> DataFrame:
    """Resolved edges of a kind inside the repository: imports between files, or calls to what is not external; one may come several times."""
    found = edges.filter((F.col("confidence") == RESOLVED) & (F.col("type") == kind) & F.col("dst").isNotNull())
    found = found.filter(F.col("src").startswith("f:") & F.col("dst").startswith("f:")) if kind == "imports" else found.filter(~F.col("dst").startswith("x"))
    return found.select("src", "dst")


def components(edges: DataFrame, rounds: list | None = None, rest: int = REST, dense: int = DENSE) -> DataFrame:
    """(component, id) of strongly connected components of two members or more; a component is named by its smallest id.

    Nodes are numbered first, so that rounds shuffle numbers. If there are
    ``dense`` edges a node or more, the components of four edges of each node
    or fewer are found first (``_few``). These are in the same component in the
    whole graph, so each is made one node, and every edge is drawn between what
    its ends went into; what is left of all edges is gone over again. ``rounds``
    gets an entry for each round.
    """
    ship(edges.sparkSession)
    rounds = [] if rounds is None else rounds
    names, left = _numbered(edges.select("src", "dst").filter("src != dst"))
    n, nodes, merged = left.count(), names.count(), None
    while n > max(rest, dense * nodes):
        own = _components(_few(left), rounds, rest)
        if own.isEmpty():
            break
        left = keep(_merged(left, own))
        merged = own if merged is None else _both(merged, own)
        before, n = n, left.count()
        if n > 0.5 * before:
            break
        nodes = left.select("src").union(left.select("dst")).distinct().count() if n > rest else 0
    found = _components(left, rounds, rest) if n else None
    if merged is not None:
        found = merged if found is None else _both(merged, found)
    if found is None:
        return edges.select(F.col("src").alias("component"), F.col("src").alias("id")).limit(0)
    found = keep(found.join(names.select("number", F.col("id").alias("name")), F.col("number") == F.col("id")).select("component", F.col("name").alias("id")))
    return keep(found.join(found.groupBy("component").agg(F.min("id").alias("name")), "component").select(F.col("name").alias("component"), "id"))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, number) of the nodes, and (src, dst) of ``edges`` in numbers: hashes of ids, with another seed where two are the same."""
    ids = keep(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    n, seed = ids.count(), 0
    while ids.select(_drawn(seed, "id")).distinct().count() < n:
        seed += 1
    return ids.withColumn("number", _drawn(seed, "id")), keep(edges.select(_drawn(seed, "src").alias("src"), _drawn(seed, "dst").alias("dst")))


def _few(edges: DataFrame) -> DataFrame:
    """Of each node the edges to and from its least and its largest neighbour.

    Numbers are drawn, so nodes of very small or large ones keep most of their
    edges, and the others keep a way to these and back where they had one.
    """
    ends = [F.min("other").alias("least"), F.max("other").alias("largest")]
    ahead = edges.select("src", F.col("dst").alias("other")).groupBy("src").agg(*ends)
    behind = edges.select("dst", F.col("src").alias("other")).groupBy("dst").agg(*ends)
    both = F.explode(F.array("least", "largest"))
    return ahead.select("src", both.alias("dst")).union(behind.select(both.alias("src"), "dst")).distinct()


def _merged(edges: DataFrame, own: DataFrame) -> DataFrame:
    """``edges`` between what their ends went into, by ``own`` (component, id)."""
    for end in ("src", "dst"):
        to = own.select(F.col("id").alias(end), "component")
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    return edges.select("src", "dst").filter("src != dst").distinct()


def _both(first: DataFrame, then: DataFrame) -> DataFrame:
    """(component, id) after ``first`` and, of what that made, ``then``."""
    on = then.select(F.col("id").alias("component"), F.col("component").alias("to"))
    moved = first.join(on, "component", "left").select(F.coalesce("to", "component").alias("component"), "id")
    return keep(moved.unionByName(then.join(first.select("id"), "id", "left_anti").select("component", "id")))


def _components(edges: DataFrame, rounds: list, rest: int) -> DataFrame:
    """(component, id) of numbers, a component named by its least.

    Rounds take out nodes that nothing leads to or from, and draw edges past
    nodes with one edge in and one out: of neighbours among them those go that
    come first in an order drawn for the round, so that paths and trees are
    gone in about as many rounds as their size has digits. Such a node is in
    the component of the two beside it if these are in the same one. When that
    gets on no more, every node learns which node of least number reaches
    it, and of the nodes that this one reaches, which it is led back to; labels
    of labels are looked up too, so that the distance learned over grows by a
    factor a round. Who has the same node both ways is its component, and edges
    between different labels are in none.
    Once ``rest`` edges or fewer are left, one task finishes them, as a round
    costs about as much however few they are. Before labels are learned, what
    hangs together by ``rest`` edges or fewer goes to such tasks too, many at
    once, so that the rounds are for what is larger.
    """
    left = keep(edges.distinct())
    past, looped, named = [], [], []
    n, first = left.count(), True
    while n:
        while n > (0 if first else rest):
            first = False
            rounds.append(n)
            gone, both = _contract(left, len(rounds))
            past.append(gone)
            looped.append(both.filter("src = dst").select(F.col("src").alias("id")))
            left = both.filter("src != dst")
            before, n = n, left.count()
            if n > 0.8 * before:
                break
        if 0 < n <= rest:
            named.append(keep(left.groupBy(F.lit(0).alias("all")).applyInPandas(_finish, "label long, id long")))
            n = 0
        elif n:
            if rest:
                left, found = _small_out(left, n, rest, rounds)
                named.append(found)
                n = left.count()
            if n > rest:
                left, found = _coloured_out(left, rounds)
                named.append(found)
                n = left.count()
    return _named(edges.sparkSession, past, looped, named)


def _drawn(turn: int, c: str) -> Column:
    """An order for the round; no two numbers have the same place, as a hash of eight bytes can be undone."""
    return F.xxhash64(F.lit(turn), F.col(c))


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that go (id, and those beside it if it is drawn past), and the edges that are left, those of a node to itself included."""
    none = F.lit(None).cast(edges.schema["src"].dataType)
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), none.alias("pred"), F.col("dst").alias("succ"))
    ends = ends.union(edges.select("dst", F.lit(1), F.lit(0), "src", none))
    nodes = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.max("pred").alias("pred"), F.max("succ").alias("succ"))
    nodes = nodes.filter("i = 0 or o = 0 or (i = 1 and o = 1)")
    chain = nodes.filter("i = 1 and o = 1").select("id", "pred", "succ")
    chosen = chain
    for side in ("pred", "succ"):
        other = chain.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_too"))
        chosen = chosen.join(other, side, "left").filter(F.col(f"{side}_too").isNull() | (_drawn(turn, "id") < _drawn(turn, side)))
    gone = keep(nodes.filter("i = 0 or o = 0").select("id", none.alias("pred"), none.alias("succ")).unionByName(chosen.select("id", "pred", "succ")))
    stay = edges
    for end in ("src", "dst"):
        stay = stay.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    drawn = gone.filter("pred is not null").select(F.col("pred").alias("src"), F.col("succ").alias("dst"))
    return gone.filter("pred is not null"), keep(stay.select("src", "dst").union(drawn).distinct())


def _pieces(edges: DataFrame, rounds: list) -> DataFrame:
    """(id, piece): what hangs together, whichever way edges lead.

    Each node goes to that of its neighbours and itself which is drawn first
    for the round, and edges are drawn between where their ends went, so that
    they get fewer by a factor a round.
    """
    left = keep(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    pieces = keep(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.col("id").alias("piece")))
    while not left.isEmpty():
        rounds.append(None)
        turn = len(rounds)
        both = left.select("a", "b").union(left.select("b", "a"))
        to = keep(both.groupBy("a").agg(F.min_by("b", _drawn(turn, "b")).alias("best")).select("a", F.when(_drawn(turn, "best") < _drawn(turn, "a"), F.col("best")).otherwise(F.col("a")).alias("to")))
        pieces = keep(pieces.join(to, pieces["piece"] == to["a"], "left").select("id", F.coalesce("to", "piece").alias("piece")))
        for end in ("a", "b"):
            left = left.join(to.select(F.col("a").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        left = keep(left.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pieces


def _small_out(edges: DataFrame, n: int, rest: int, rounds: list) -> tuple[DataFrame, DataFrame]:
    """The edges of pieces of more than ``rest`` edges, and (label, id) of the components of the others; a task gets pieces of some ``rest`` edges."""
    placed = keep(edges.join(_pieces(edges, rounds).withColumnRenamed("id", "src"), "src").select("src", "dst", "piece"))
    large = keep(placed.groupBy("piece").agg(F.count("*").alias("k")).filter(F.col("k") > rest).select("piece"))
    small = placed.join(large, "piece", "left_anti")
    dealt = small.groupBy(F.pmod(F.xxhash64("piece"), F.lit(2 * n // rest + 1)).alias("task"))
    found = keep(dealt.applyInPandas(_finish, "label long, id long"))
    return keep(placed.join(large, "piece", "left_semi").select("src", "dst")), found


def _least(edges: DataFrame, rounds: list) -> DataFrame:
    """(id, best): of the nodes that reach it, itself included, the one of least number."""
    best = keep(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().select("id", F.col("id").alias("best")))
    while True:
        rounds.append(None)
        given = edges.join(best.select(F.col("id").alias("src"), "best"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("best").alias("given"))
        beyond = best.select(F.col("id").alias("through"), F.col("best").alias("beyond"))
        new = best.join(given, "id", "left").withColumn("through", F.col("best")).join(beyond, "through", "left")
        new = keep(new.select("id", F.least("best", "given", "beyond").alias("new"), "best").select("id", F.col("new").alias("best"), (F.col("new") != F.col("best")).alias("changed")))
        if new.filter("changed").isEmpty():
            return new.select("id", "best")
        best = new.select("id", "best")


def _same(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` between nodes of one label, with it as ``best``."""
    one = edges.join(labels.select(F.col("id").alias("src"), "best"), "src")
    return one.join(labels.select(F.col("id").alias("dst"), F.col("best").alias("other")), "dst").filter("best = other").select("src", "dst", "best")


def _coloured_out(edges: DataFrame, rounds: list) -> tuple[DataFrame, DataFrame]:
    """The edges that may still be in components, and (label, id) of those found."""
    within = keep(_same(edges, _least(edges, rounds)))
    back = _least(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), rounds)
    both = keep(_same(within.select("src", "dst"), back).join(within.withColumnRenamed("best", "ahead"), ["src", "dst"]))
    found = both.filter("best = ahead")
    found = keep(found.select(F.col("best").alias("label"), F.col("src").alias("id")).union(found.select("best", "dst")).distinct())
    return keep(both.filter("best != ahead").select("src", "dst")), found


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    """(label, id) of components of few edges: by the order that a walk leaves nodes in, then walks backwards from the last left."""
    ahead: dict[int, list[int]] = {}
    behind: dict[int, list[int]] = {}
    for src, dst in frame[["src", "dst"]].itertuples(index=False):
        ahead.setdefault(src, []).append(dst)
        behind.setdefault(dst, []).append(src)
    left, seen = [], set()
    for node in ahead:
        open_ = [] if node in seen else [(node, iter(ahead[node]))]
        seen.add(node)
        while open_:
            to = next((x for x in open_[-1][1] if x not in seen), None)
            if to is None:
                left.append(open_.pop()[0])
            else:
                seen.add(to)
                open_.append((to, iter(ahead.get(to, ()))))
    label: dict[int, int] = {}
    for node in reversed(left):
        open_ = [] if node in label else [node]
        label.setdefault(node, node)
        while open_:
            new = [x for x in behind.get(open_.pop(), ()) if x not in label]
            label.update((x, node) for x in new)
            open_ += new
    sizes = pd.Series(label).value_counts()
    return pd.DataFrame([(c, i) for i, c in label.items() if sizes[c] > 1], columns=["label", "id"], dtype="int64")


def _named(spark, past: list, looped: list, named: list) -> DataFrame:
    labels = None
    for found in [*named, *(x.select(F.col("id").alias("label"), "id") for x in looped)]:
        labels = found if labels is None else labels.unionByName(found)
    if labels is None:
        return spark.createDataFrame([], "component long, id long")
    # a node with an edge to itself may be in a larger component too, whose label counts; larger ones come from ``named``
    alone = F.col("label") == F.col("id")
    labels = keep(labels.groupBy("id").agg(F.min_by("label", F.struct(alone, "label")).alias("label")))
    for gone in reversed(past):
        if gone.isEmpty():
            continue
        own = gone.join(labels.select(F.col("id").alias("pred"), "label"), "pred").join(labels.select(F.col("id").alias("succ"), F.col("label").alias("other")), "succ").filter("label = other")
        own = keep(own.select("id", "label"))
        labels = keep(labels.join(own, "id", "left_anti").select("id", "label").unionByName(own))
    sizes = labels.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return keep(labels.join(sizes, "label").select("component", "id"))


def _walk(key, frame: pd.DataFrame) -> pd.DataFrame:
    """The first cycle that a walk in depth from the smallest member closes, neighbours in order.

    A member that the walk has come back from can't reach the start but through
    the walk's own members, so it is not tried again.
    """
    start, size = key[0], int(frame["size"].iloc[0])
    out: dict[str, list[str]] = {}
    for src, dst in frame.sort_values(["src", "dst"])[["src", "dst"]].itertuples(index=False):
        out.setdefault(src, []).append(dst)
    seen, path, rest = {start}, [start], [iter(out[start])]
    while True:
        to = next(rest[-1], None)
        if to is None:
            path.pop()
            rest.pop()
        elif to == start:
            return pd.DataFrame([(start, size, len(path), path)], columns=["component", "size", "length", "path"])
        elif to not in seen:
            seen.add(to)
            path.append(to)
            rest.append(iter(out.get(to, ())))


def _walk_in_rounds(inside: DataFrame) -> DataFrame:
    """As ``_walk``, of one component of any size.

    Each node points to its first neighbour that is not on the walk and not
    given up. The walk follows the pointers by jumps of 1, 2, 4 and so on, to
    where they close, end or come round; what ends is given up, and from what
    comes round the pointers are drawn anew.
    """
    spark = inside.sparkSession
    start, size = inside.select("component", "size").first()
    edges = keep(inside.select("src", "dst"))
    members = inside.select("src").distinct().count()
    path = keep(spark.createDataFrame([(0, start)], "place long, node string"))
    failed = spark.createDataFrame([], "node string")
    at, place = start, 0
    while True:
        barred = failed.union(path.filter(F.col("node") != start).select("node")).select(F.col("node").alias("dst"))
        first = edges.join(barred, "dst", "left_anti").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to"))
        # where the start is a neighbour, it is the first one, and the walk closes there
        jumps = [keep(first)]
        while 1 << len(jumps) <= members:
            last = jumps[-1]
            jumps.append(keep(last.filter(F.col("to") != start).join(last.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to"))))
        steps = keep(spark.createDataFrame([(0, at)], "place long, node string"))
        for k, jump in enumerate(jumps):
            new = steps.join(jump, "node").filter(F.col("to") != start).select((F.col("place") + (1 << k)).alias("place"), F.col("to").alias("node"))
            steps = keep(steps.union(new))
        # the first time each node comes; what follows the first return is round again
        own = keep(steps.groupBy("node").agg(F.min("place").alias("place")).filter((F.col("node") != start) | (F.lit(at) == start)))
        end = own.orderBy(F.col("place").desc()).first()
        path = keep(path.union(own.filter("place > 0").select((F.col("place") + place).alias("place"), "node")))
        at, place = end["node"], place + end["place"]
        if edges.filter((F.col("src") == at) & (F.col("dst") == start)).count():
            listed = path.agg(F.array_sort(F.collect_list(F.struct("place", "node")))["node"].alias("path"))
            return listed.select(F.lit(start).alias("component"), F.lit(size).alias("size"), F.size("path").cast("long").alias("length"), "path")
        barred = failed.union(path.select("node")).select(F.col("node").alias("dst"))
        if edges.filter(F.col("src") == at).join(barred, "dst", "left_anti").isEmpty():
            failed = keep(failed.union(path.filter(F.col("node") == at).select("node")))
            path = keep(path.filter(F.col("node") != at))
            place -= 1
            at = path.filter(F.col("place") == place).first()["node"]


def representative_cycles(edges: DataFrame, members: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(component, size, length, path), largest components first, then by name: one cycle through the smallest member of each.

    It is the one that a walk in depth from that member closes first, trying
    neighbours in order; an edge of a member to itself is none.
    """
    ship(edges.sparkSession)
    inside = edges.join(members.select(F.col("id").alias("src"), "component"), "src").join(members.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").filter("component = other and src != dst")
    sizes = members.groupBy("component").agg(F.count_distinct("id").alias("size"))
    inside = keep(inside.select("component", "src", "dst").distinct().join(sizes, "component"))
    edges_of = inside.groupBy("component").agg(F.count("*").alias("k"))
    large = [r["component"] for r in edges_of.filter(F.col("k") > longest).select("component").collect()]  # as many as have that many edges
    found = inside.filter(~F.col("component").isin(large)).groupBy("component").applyInPandas(_walk, "component string, size long, length long, path array<string>")
    for component in large:
        found = found.unionByName(_walk_in_rounds(inside.filter(F.col("component") == component)))
    return found.orderBy(F.col("size").desc(), "component")
