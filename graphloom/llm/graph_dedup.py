"""Near-duplicates among embeddings by a robust-pruned flat graph.

1. Equal vectors of a label become one node with a count.
2. Centres are fitted on a bounded sample (``SAMPLE_CELLS``), as many a label as
   its share asks for; each node joins the ``overlap`` nearest. Shards of more
   than ``CAP`` nodes, as dense families make, are dealt into chunks.
3. Each chunk gets a graph: a node's nearest and some far ones, pruned so that
   a neighbour that is nearer to a kept one than to the node goes. Where more
   than the nearest are in range, some of all the way to its end are looked at
   too, so that a node between two dense families leads to both.
4. The adjacency lists of a node's shards are united.
   Ways back are added, for in dense families few lists have a node at the edge.
5. Every node is searched for in its shards: greedily from the chunk's medoids
   and from its own place, then on through neighbours of all in range until no
   more are found. Of a shard of several chunks, every pair of chunks is a task.
6. Pairs found are verified in double precision.
7. A bounded sample of nodes (``AUDIT``) is compared with all nodes. Before the
   search its links tell how many shards must overlap, so that the ends of
   ``MEET`` of them share one. If fewer than ``RECALL`` of them were found,
   shards overlap more, and the search is made again.

Nodes of the same label only meet. Nothing but samples, centres and counts of
the audit reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, table, tidy
from graphloom.llm.components import components

AT = 0.93
SAMPLE_CELLS = 1 << 21  # numbers of the sample that centres are fitted on
SHARD = 1000  # nodes that a centre is wanted for
MOST_CENTRES = 4096
OVERLAP = 2
CAP = 4096  # nodes of a chunk
NEAR, FAR, SPREAD, DEGREE, BACK, ALPHA = 32, 8, 16, 24, 16, 1.2
BEAM, MEDOIDS = 12, 48
AUDIT, RECALL, MEET = 512, 0.95, 0.97
SLACK = 1e-3  # of single precision, before the verification


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1)


def fit_centres(spark, nodes: DataFrame, total: int, shard: int = SHARD) -> dict:
    """Unit centres by (label, dims), fitted on a sample by hash; a label too rare for the sample has none, and is one shard."""
    dims = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    rows = nodes.select("label", "v").orderBy(F.xxhash64("v"), "node").limit(max(64, SAMPLE_CELLS // dims)).toPandas()
    sizes = rows["v"].map(len)
    most, out = max(1, min(MOST_CENTRES, total // shard)), {}
    for (label, d), part in rows.groupby([rows["label"], sizes]):
        k = min(-(-len(part) * most // len(rows)), -(-len(part) // 8))
        if k < 2:
            continue
        x = unit(np.stack(part["v"].to_numpy()).astype(float))
        centres = x[:: -(-len(x) // k)][:k].copy()
        for _ in range(6):
            near = (x @ centres.T).argmax(1)
            for c in range(len(centres)):
                if (own := x[near == c]).size and np.abs(own.sum(0)).max() > 1e-9:
                    centres[c] = unit(own.sum(0, keepdims=True))[0]
        out[(label, int(d))] = centres
    return out


def _assign(centres: dict, overlap: int):
    @tidy
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, lengths = np.array(batch.column(1).to_pylist(), object), batch.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = unit(_vectors(batch.column(2).take(pa.array(at))))
                for label in set(labels[at]):
                    own = np.flatnonzero(labels[at] == label)
                    found = centres.get((label, int(d)))
                    if found is None:
                        cells = np.full((len(own), 1), -1)
                    else:
                        cells = np.argsort(-(x[own] @ found.T), 1, kind="stable")[:, :overlap]
                    k, rows = cells.shape[1], np.repeat(own, cells.shape[1])
                    data = [x[i].tobytes() for i in own]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array(at[rows])), pa.array(np.full(len(rows), d), pa.int32()), pa.array(cells.ravel(), pa.int32()), batch.column(0).take(pa.array(at[rows])), batch.column(3).take(pa.array(at[rows])), pa.array([b for b in data for _ in range(k)], pa.binary())],
                        ["label", "dims", "cell", "node", "copies", "u"],
                    )

    return run


def prune(x: np.ndarray, candidates: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """(rows, degree) of the candidates kept, -1 where there are fewer; ``near`` is their similarity, -inf for none, falling."""
    rows, out = np.arange(len(candidates)), np.full((len(candidates), degree), -1)
    between = np.matmul(x[candidates], x[candidates].transpose(0, 2, 1))
    alive = np.isfinite(near)
    for r in range(degree):
        first, some = alive.argmax(1), alive.any(1)
        if not some.any():
            break
        out[some, r] = candidates[rows, first][some]
        alive &= alpha * (1 - between[rows, first]) > 1 - near
        alive[rows, first] = False
    return out


def build(x: np.ndarray, seed: int = 7, at: float = AT) -> np.ndarray:
    """(nodes, degree) adjacency of unit vectors: nearest and far candidates, and others in range ``at``, pruned, then once more with the ways back."""
    n, random = len(x), np.random.default_rng(seed)
    k = min(NEAR, n - 1)
    if k < 1:
        return np.full((n, DEGREE), -1)
    x = x.astype(np.float32)
    first = np.full((n, DEGREE), -1)
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, 1)[:, :k]
        both = np.concatenate([best, random.integers(0, n, (len(s), FAR))], 1)
        first[i : i + 512] = _ordered(x, s, both)
        inside = (s >= at).sum(1)
        many = np.flatnonzero(inside > k)
        if len(many):
            rank = k - 1 - (k - inside[many, None]) * np.arange(1, SPREAD + 1) // SPREAD  # from the nearest ones to the last in range
            far = np.take_along_axis(np.argsort(-s[many], 1, kind="stable"), rank, 1)
            first[i + many] = _ordered(x, s[many], np.concatenate([both[many], far], 1))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(*np.nonzero(first >= 0), strict=True):
        if len(back[first[i, j]]) < NEAR:
            back[first[i, j]].append(i)
    out = np.full((n, DEGREE), -1)
    back_rows = np.array([b + [-1] * (NEAR - len(b)) for b in back])
    for i in range(0, n, 512):
        both = np.concatenate([first[i : i + 512], back_rows[i : i + 512]], 1)
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = _ordered(x, s, both)
    return out


def both_ways(near: np.ndarray) -> np.ndarray:
    """``near`` with up to ``BACK`` ways back for each node, first to those that fewest lead to, so that no node is led to by none."""
    source, place = np.nonzero(near >= 0)
    to = near[source, place]
    order = np.lexsort((source, np.bincount(to, minlength=len(near))[source], to))
    source, to = source[order], to[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    back = np.full((len(near), BACK), -1)
    some = rank < BACK
    back[to[some], rank[some]] = source[some]
    return np.concatenate([near, back], 1)


def _ordered(x, s, candidates) -> np.ndarray:
    near = np.where(candidates >= 0, np.take_along_axis(s, np.maximum(candidates, 0), 1), -np.inf)
    # of a candidate that is there twice only one counts
    by = np.argsort(candidates, 1, kind="stable")
    again = np.zeros_like(near, bool)
    ranked = np.take_along_axis(candidates, by, 1)
    np.put_along_axis(again, by[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
    near[again] = -np.inf
    order = np.argsort(-near, 1, kind="stable")
    return prune(x, np.maximum(np.take_along_axis(candidates, order, 1), 0), np.take_along_axis(near, order, 1))


def medoids(x: np.ndarray) -> np.ndarray:
    """The node nearest to the mean, then others spread by rank and the farthest from those before."""
    n = len(x)
    picked = [int((x @ x.mean(0)).argmax())]
    most = x @ x[picked[0]]
    for _ in range(min(MEDOIDS // 3, n - 1)):
        picked.append(int(most.argmin()))
        most = np.maximum(most, x @ x[picked[-1]])
    return np.unique(np.concatenate([picked, np.arange(0, n, max(1, 3 * n // (2 * MEDOIDS)))]).astype(int))


def search(asked: np.ndarray, own: np.ndarray, x: np.ndarray, near: np.ndarray, at: float = AT, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(question, node) pairs of cosine ``at`` or more: greedy from the medoids and a question's own node (-1: not here), then through all in range."""
    x, asked, low = x.astype(np.float32), asked.astype(np.float32), at - SLACK
    starts = medoids(x)
    seen, good = np.zeros((len(asked), len(x)), bool), np.zeros((len(asked), len(x)), bool)
    for a in range(0, len(asked), 512):
        q, o = asked[a : a + 512], own[a : a + 512]
        rows = np.arange(len(q))
        ids = np.concatenate([np.tile(starts, (len(q), 1)), o[:, None]], 1)
        s = np.concatenate([q @ x[starts].T, np.where(o >= 0, 2.0, -np.inf)[:, None].astype(np.float32)], 1)  # its own place comes first
        visited, found = seen[a : a + 512], good[a : a + 512]
        visited[rows[:, None], starts] = True
        found[rows[:, None], starts] = s[:, :-1] >= low
        here = o >= 0
        visited[rows[here], o[here]] = True
        done = np.zeros(ids.shape, bool)
        live = rows
        while len(live):
            order = np.argsort(-s[live], 1, kind="stable")[:, :beam]
            ids_l, s_l, done_l = (np.take_along_axis(m[live], order, 1) for m in (ids, s, done))
            open_ = ~done_l & np.isfinite(s_l)
            some = open_.any(1)
            pick = open_.argmax(1)
            done_l[np.arange(len(live)), pick] = True
            step = np.where(some[:, None], near[ids_l[np.arange(len(live)), pick]], -1)
            fresh = (step >= 0) & ~visited[live[:, None], np.maximum(step, 0)]
            visited[np.broadcast_to(live[:, None], step.shape)[fresh], step[fresh]] = True
            s_n = np.full(step.shape, -np.inf, np.float32)
            i, j = np.nonzero(fresh)
            s_n[i, j] = np.einsum("ij,ij->i", q[live[i]], x[step[i, j]])
            hit = s_n >= low
            found[np.broadcast_to(live[:, None], step.shape)[hit], step[hit]] = True
            if ids.shape[1] != beam + near.shape[1]:
                ids, s, done = (np.full((len(q), beam + near.shape[1]), fill, kind) for fill, kind in ((-1, int), (-np.inf, np.float32), (True, bool)))
            w = order.shape[1]
            ids[live, :w], s[live, :w], done[live, :w] = ids_l, s_l, done_l
            ids[live, w : w + step.shape[1]], s[live, w : w + step.shape[1]], done[live, w : w + step.shape[1]] = step, s_n, False
            live = live[some]
    front = np.nonzero(good)
    while len(front[0]):
        new_q, new_v = [], []
        for a in range(0, len(front[0]), 1 << 14):
            i, v = front[0][a : a + (1 << 14)], front[1][a : a + (1 << 14)]
            to = near[v]
            fresh = (to >= 0) & ~seen[i[:, None], np.maximum(to, 0)]
            pairs = np.unique(np.broadcast_to(i[:, None], to.shape)[fresh] * len(x) + to[fresh])
            i, v = pairs // len(x), pairs % len(x)
            seen[i, v] = True
            hit = np.einsum("ij,ij->i", asked[i], x[v]) >= low
            good[i[hit], v[hit]] = True
            new_q.append(i[hit])
            new_v.append(v[hit])
        front = np.concatenate(new_q), np.concatenate(new_v)
    return np.nonzero(good)


def _units(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["u"]), float).reshape(len(frame), -1)


def _build(at: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids, near = frame["node"].to_numpy(), build(_units(frame), at=at)
        return pd.DataFrame({"node": ids, "near": [ids[r[r >= 0]] for r in near]})

    return run


def _search(at: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        here, asks = frame[frame["role"] != "asked"], frame[frame["role"] != "node"]
        ids = here["node"].to_numpy()
        place = {n: i for i, n in enumerate(ids)}
        lists = [[place[n] for n in near if n in place] for near in here["near"]]
        wide = max(1, max((len(a) for a in lists), default=1))
        near = np.array([a + [-1] * (wide - len(a)) for a in lists]).reshape(len(lists), wide)
        near = both_ways(near)
        x, q = _units(here), _units(asks)
        own = np.array([place.get(n, -1) for n in asks["node"]])
        i, v = search(q, own, x, near, at) if len(x) and len(q) else (np.zeros(0, int),) * 2
        sure = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], x[v[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)]) >= at
        i, v = i[sure], v[sure]
        a, b, ca, cb = asks["node"].to_numpy()[i], ids[v], asks["copies"].to_numpy()[i], here["copies"].to_numpy()[v]
        less = a < b
        out = pd.DataFrame({"a": np.where(less, a, b), "b": np.where(less, b, a), "a_copies": np.where(less, ca, cb), "b_copies": np.where(less, cb, ca)})
        return out[out["a"] != out["b"]].drop_duplicates(["a", "b"])

    return run


def find_links(nodes: DataFrame, centres: dict, overlap: int, at: float = AT, cap: int = CAP) -> DataFrame:
    """(a, b, a_copies, b_copies), a < b, of nodes of a label with cosine ``at`` or more."""
    kind = nodes.schema["label"].dataType.simpleString()
    dealt = nodes.select("node", "label", "v", "copies").mapInArrow(_assign(centres, overlap), f"label {kind}, dims int, cell int, node long, copies long, u binary")
    dealt = materialize(dealt, "graph-shards")
    shard = ["label", "dims", "cell"]
    chunks = dealt.groupBy(*shard).agg(F.ceil(F.count("*") / cap).cast("int").alias("chunks"))
    dealt = materialize(dealt.join(chunks, shard).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "graph-chunks")
    lists = dealt.select(*shard, "chunk", "node", "u").groupBy(*shard, "chunk").applyInPandas(_build(at), "node long, near array<long>")
    united = materialize(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-lists")
    # pairs of a shard's chunks: the one whose graph is searched, and the later or same one whose nodes ask
    as_node = F.transform(F.sequence("chunk", F.col("chunks") - 1), lambda q: F.struct(F.col("chunk").alias("n"), q.alias("q"), F.when(q == F.col("chunk"), "both").otherwise("node").alias("role")))
    as_asked = F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda n: n < F.col("chunk")), lambda n: F.struct(n.alias("n"), F.col("chunk").alias("q"), F.lit("asked").alias("role")))
    placed = dealt.join(united, "node").withColumn("place", F.explode(F.concat(as_node, as_asked))).select(*shard, "place.*", "node", "copies", "u", "near")
    found = placed.groupBy(*shard, "n", "q").applyInPandas(_search(at), "a long, b long, a_copies long, b_copies long")
    return materialize(found.distinct(), "graph-links")


def sampled_links(nodes: DataFrame, centres: dict, at: float = AT, most: int = AUDIT) -> DataFrame:
    """(a, b, need) of the true links of a sample of nodes, which is compared with all nodes; need: the overlap from which both ends share a shard."""
    sample = nodes.select("node", "label", "v").orderBy(F.xxhash64("node"), "node").limit(most).toPandas()
    asked: dict = {}

    def places(x: np.ndarray, found: np.ndarray) -> np.ndarray:
        return np.argsort(np.argsort(-(x @ found.T), 1, kind="stable"), 1)  # of each centre in a node's order

    for (label, _), part in sample.groupby([sample["label"], sample["v"].map(len)]):
        x = unit(np.stack(part["v"].to_numpy()).astype(float))
        found = centres.get((label, x.shape[1]))
        asked[(label, x.shape[1])] = (part["node"].to_numpy(), x, found, None if found is None else places(x, found))

    @tidy
    def compare(batches):
        for batch in batches:
            labels, lengths = np.array(batch.column(1).to_pylist(), object), batch.column(2).value_lengths().to_numpy()
            for (label, d), (ids, x, found, order) in asked.items():
                own = np.flatnonzero((labels == label) & (lengths == d))
                if len(own):
                    y = unit(_vectors(batch.column(2).take(pa.array(own))))
                    i, j = np.nonzero(x @ y.T >= at)
                    a, b = ids[i], batch.column(0).to_numpy()[own[j]]
                    need = np.ones(len(i), np.int64)
                    if found is not None:
                        ends = np.unique(j)
                        theirs = places(y[ends], found)
                        for k in range(0, len(i), 4096):
                            s = slice(k, k + 4096)
                            need[s] = np.maximum(order[i[s]], theirs[np.searchsorted(ends, j[s])]).min(1) + 1
                    apart = a != b
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart], pa.int64()), pa.array(np.maximum(a, b)[apart], pa.int64()), pa.array(need[apart])], ["a", "b", "need"])

    true = nodes.select("node", "label", "v").mapInArrow(compare, "a long, b long, need long")
    return materialize(true.groupBy("a", "b").agg(F.min("need").alias("need")), "graph-sampled")


def wanted_overlap(true: DataFrame, overlap: int, widest: int) -> int:
    """``overlap``, doubled until the ends of ``MEET`` of the links of ``true`` share a shard, but no more often than up to ``widest``."""
    counts = {r["need"]: r["n"] for r in true.groupBy("need").agg(F.count("*").alias("n")).collect()}  # no more rows than centres
    while overlap < widest and sum(n for need, n in counts.items() if need <= overlap) < MEET * sum(counts.values()):
        overlap *= 2
    return overlap


def share_found(true: DataFrame, links: DataFrame) -> float:
    """The share of ``true`` that ``links`` has; 1 if there are none."""
    row = true.join(links.select("a", "b", F.lit(1).alias("found")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("found").alias("k")).first()
    return row["k"] / row["n"] if row["n"] else 1.0


def audit(nodes: DataFrame, links: DataFrame, at: float = AT, most: int = AUDIT) -> float:
    """The share of the true links of a sample of nodes that ``links`` has; 1 if there are none. The sample is compared with all nodes."""
    return share_found(sampled_links(nodes, {}, at, most), links)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", at: float = AT, overlap: int = OVERLAP, cap: int = CAP, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``df``.

    Vectors link when their labels are equal and their cosine, in double
    precision, is ``at`` or more; so do equal ones. Rows whose label or vector
    is null, or whose vector is empty, zero, or holds null or non-finite
    entries, link with nothing, nor do vectors of different lengths.
    component_id is the smallest id reachable by links, null ids aside; a row
    with a null id is kept only if no id is reachable. Rows with the same id
    each have a row. An empty table gives none; other columns don't matter.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda c: c + F.lit(0.0))  # no negative zero
    fine = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    fine = F.coalesce(fine, F.lit(False))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), fine.alias("fine"), F.when(fine, F.unhex(F.sha2(v.cast("string"), 256))).alias("key"))
    own = rows.filter("fine").groupBy("label", "key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    nodes = materialize(own.withColumn("node", F.monotonically_increasing_id()), "graph-nodes")
    total = nodes.count()
    if total:
        centres = fit_centres(spark, nodes, total, shard)
        widest = max([len(c) for c in centres.values()], default=1)
        if overlap < widest:
            true = sampled_links(nodes, centres, at)
            overlap = wanted_overlap(true, overlap, widest)
        while True:
            links = find_links(nodes, centres, overlap, at, cap)
            if overlap >= widest or share_found(true, links) >= RECALL:
                break
            overlap *= 2
    else:
        links = spark.createDataFrame([], "a long, b long, a_copies long, b_copies long")
    roots = components(links.select("a", "b"))
    degree = links.select(F.col("a").alias("node"), F.col("b_copies").alias("n")).unionByName(links.select(F.col("b").alias("node"), F.col("a_copies").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.select("node", "first_id").join(roots, "node")
    least = named.groupBy("root").agg(F.min("first_id").alias("least"))
    linked = named.join(least, "root").select("node", "least").join(degree, "node")
    told = nodes.select("label", "key", "node", "copies", "first_id").join(linked, "node", "left")
    told = told.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("n").isNull(), F.col("first_id")).otherwise(F.col("least")).alias("component_id"))
    told = materialize(told, "graph-told")
    out = rows.drop("v").join(told, ["label", "key"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS kept FROM embeddings"""
