"""Exact Jaccard self-join of word-shingle sets by a partitioned universe.

Two sets of sizes r and s with Jaccard similarity of at least 3/4 differ in at
most H = (r + s) / 7 elements. Sets are put into size bands, and in a band
every element hashes to one of m segments of the universe. A segment's subset
(its elements in a set) is indexed whole, or with its one-deletion
neighbourhood (all that is left when one element goes), or not at all:

* a whole subset covers 1: one differing element in the segment spoils it;
* with its neighbourhood, a subset of two or more covers 2: of two subsets that
  differ in one element, one whole is in the other's neighbourhood;
* what is not indexed covers 0.

What is indexed is allocated by cost, in two steps. A first pass over all
documents measures for each segment of each band how many rows its signatures
have and how many partners a row meets there, by signed sums whose squares
estimate the sum of squared counts. From that each band gets a level for every
segment: whole where that is cheap, nothing where common lines make it dear,
and neighbourhoods of the cheapest segments where the rest would not cover
enough. Then each set allocates among its own signatures by their exact lists:
of two similar sets, one that covers T shares at least T - H signatures with
the other, so by the prefix principle each may drop the T - H - 1 that most sets
share, and the two still meet. A set that can't cover H + 1 gives each of its
elements besides and drops nothing; two such sets meet there. The two smallest bands
have a single segment: whole where H is 0, with its neighbourhood where H is 1.

A set near the lower end of its band may resemble smaller sets, so it also
gives its signatures in the band below.

Equal sets are one vertex from the start. Signatures are shuffled as arrays, in
buckets of bounded size; a signature that many sets of one task share is taken
out of the buckets but for a marker. Only those of two vertices or more come
out, and after the drop one stands for all that have the same vertices. Their
vertices are compared with the smallest (a star, not all pairs), then with one
drawn for each signature; a pair whose parity bits differ in more than H places
can't be similar and goes no further. Components of what is verified leave only those
signatures open that join different components; these are compared in blocks
of bounded size, vertices outside a signature's largest component with all. Every
comparison is exact, of whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import materialize, table, tidy, width
from graphloom.llm.components import components
from graphloom.llm.exact_dedup import held_in, repeated_filter

K = 5
BANDS = [(1, 2), (3, 5)] + [(6 << i, (12 << i) - 1) for i in range(40)]
_LOW = np.array([lo for lo, _ in BANDS])
_SEED = np.uint64(0xA24BAED4963EE407)
SLOTS = 1 << 12  # segments of a band whose costs are told apart
SIGNS = 4  # signed sums of a segment
PARTNER = 1.0  # cost of a partner that a row meets, in rows
DEAR = 4.0  # times the median cost of a band's segments, from which one is indexed only if it must be
ROOM = 1.3  # average cover of a band's sets, in what they need
FLUSH = 1 << 18  # signatures that a task holds before it sends them
BUCKET = 1 << 20  # elements for which there is a bucket
LEAST_BITS = 512  # of a set, by which pairs are compared first
HOT = 256  # sets of one flush with the same signature from which it goes apart


def _need(size, hi: int):
    """Cover that a set must reach in a band that ends at hi: one more than what differs between it and any set it meets there."""
    return (size + np.minimum(4 * size // 3, 4 * hi // 3)) // 7 + 1


def _segments(lo: int, hi: int) -> int:
    """The fewest segments that leave sets of the band half as much again as they need on average, and enough for all but one in a hundred."""
    sizes = np.unique((lo + (hi - lo) * np.linspace(0, 1, 5)).astype(int))
    for i in range(60):
        m = max(2, int(hi * (0.3 + 0.05 * i)))
        short, room = 0.0, math.inf
        for s in sizes:
            load = s / m
            empty = math.exp(-load)
            spread = math.sqrt(max(1e-9, m * empty * (1 - (1 + load) * empty)))
            short = max(short, 0.5 * math.erfc((m * (1 - empty) - int(_need(s, hi)) + 0.5) / spread / math.sqrt(2)))
            room = min(room, m * (1 - empty) / int(_need(s, hi)))
        if short < 0.01 and room > 1.4:
            break
    return m


SEGMENTS = [1, 1] + [_segments(lo, hi) for lo, hi in BANDS[2:16]]
SEGMENTS += [SEGMENTS[15] << i for i in range(1, 27)]  # the same share of the band's size further on


def sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles in order, text numbers, sizes, set hashes): distinct shingles of each text."""
    data = tk.lower(data)
    starts, ends, ptr = tk.words(data, offs)
    h, at = tk.shingles(tk.span_hashes(data, starts, ends), ptr, K)
    h, at, _ = tk.unique_in_group(h, at)
    n = np.bincount(at, minlength=len(offs) - 1).astype(np.int64)
    whole = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        filled = np.flatnonzero(n)
        if len(filled):
            begin = np.concatenate([[0], np.cumsum(n[filled])[:-1]])
            whole[filled] = tk.chain(n[filled].astype(np.uint64), np.add.reduceat(tk.mix(h ^ _SEED), begin))
    return h, at, n, whole & np.uint64((1 << 63) - 1)


class Cells:
    """Of the sets of one band: their filled segments and what is in them."""

    def __init__(self, k: int, docs: np.ndarray, size: np.ndarray, h: np.ndarray, e: np.ndarray):
        """docs: set numbers; h, e: elements and their hashes, set by set."""
        m = SEGMENTS[k]
        self.k, self.docs, self.size = k, docs, size
        self.base = tk.mix(np.array([k + 1], np.uint64))
        mine = np.repeat(np.arange(len(docs)), size)
        cell = mine * m + (tk.mix(h ^ self.base) % np.uint64(m)).astype(np.int64) if m > 1 else mine
        order = np.argsort(cell, kind="stable")
        cell, self.e = cell[order], e[order]
        self.start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.count = np.diff(self.start, append=len(cell))
        self.of, self.segment = cell[self.start] // m, cell[self.start] % m
        with np.errstate(over="ignore"):
            self.salt = self.base + (self.segment + 1).astype(np.uint64) * _SEED
            self.subset = np.add.reduceat(self.e, self.start)

    @property
    def slots(self) -> int:
        return min(SEGMENTS[self.k], SLOTS)

    def whole(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tk.mix(self.subset[cells] + self.salt[cells])

    def deletions(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures of the one-deletion neighbourhoods, cell of each)."""
        n = self.count[cells]
        of = np.repeat(cells, n)
        at = np.arange(n.sum()) + np.repeat(self.start[cells] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(cells) else cells
        with np.errstate(over="ignore"):
            return tk.mix(self.subset[of] - self.e[at] + self.salt[of]), of


def bands(h: np.ndarray, n: np.ndarray):
    """``Cells`` of each band that the sets have signatures in; h: their elements, set by set."""
    band = np.searchsorted(_LOW, n, "right") - 1  # -1: no elements
    first = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        e = tk.mix(h + _SEED)
    for below in (0, 1):
        b = band - below
        ask = n > 0 if not below else (band > 0) & (-(-3 * n // 4) < _LOW[np.maximum(band, 0)])
        for k in np.unique(b[ask]):
            docs = np.flatnonzero(ask & (b == k))
            size = n[docs]
            x = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            yield Cells(int(k), docs, size, h[x], e[x])


class Costs:
    """Sums over the sets of each band, by segment (number modulo ``SLOTS``), and the levels that follow from them."""

    WIDTH = 2 + SIGNS + 1  # filled subsets, those of two or more; signed sums; in the first column, what the sets need

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}

    def add(self, cells: Cells) -> None:
        if cells.k < 2:
            return
        slot, slots = cells.segment % cells.slots, cells.slots
        sig = cells.whole(np.arange(len(slot)))
        parts = [np.bincount(slot, minlength=slots), np.bincount(slot[cells.count > 1], minlength=slots)]
        parts += [np.bincount(slot, 1.0 - 2.0 * ((sig >> np.uint64(r + 20)) & np.uint64(1)), slots) for r in range(SIGNS)]
        need = np.zeros(slots)
        need[0] = _need(cells.size, BANDS[cells.k][1]).sum()
        self.merge(cells.k, np.array([*parts, need], float))

    def merge(self, k: int, sums: np.ndarray) -> None:
        self.sums[k] = self.sums[k] + sums if k in self.sums else sums

    def levels(self) -> dict[int, np.ndarray]:
        """For each band how its segments are indexed: 0 not at all, 1 whole, 2 with neighbourhoods."""
        out = {}
        for k, s in self.sums.items():
            rows, many, need = np.maximum(s[0], 1e-9), np.maximum(s[1], 1e-9), s[-1, 0]
            # what a row meets: the sum of squared counts less the rows, over the rows
            cost = 1 + PARTNER * np.maximum((s[2:-1] ** 2).mean(0) - rows, 0) / rows
            more = cost * (2 + SEGMENT_LOAD * rows / many)  # a neighbourhood's rows meet at least as many, for each unit that it covers
            level = (cost <= DEAR * np.median(cost)).astype(np.int64)
            cover = s[0][level > 0].sum()
            # (cost per unit, unit, segment, level) of the steps not taken, cheapest first
            steps = sorted([*((cost[i], s[0][i], i, 1) for i in np.flatnonzero(level == 0)), *((max(more[i], cost[i]), s[1][i], i, 2) for i in range(len(cost)))], key=lambda x: (x[0], x[3], x[2]))
            for _, unit, i, up in steps:
                if cover >= ROOM * need:
                    break
                if level[i] == up - 1:
                    level[i] = up
                    cover += unit
            out[k] = level
        return out


SEGMENT_LOAD = 2.0  # elements of a filled segment, about


def signatures(h: np.ndarray, n: np.ndarray, levels: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set numbers, slack) of sets of n elements each, given set by set in h; similar sets share one.

    The last bit of a signature is that of its band, so it tells a set's own
    band from the one below. slack[d, bit]: how many signatures set d may drop
    among those with that bit.
    """
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    slack = np.zeros((len(n), 2), np.int64)

    def give(sig, docs, k):
        out.append((sig & ~np.uint64(1)) | np.uint64(k & 1))
        of.append(docs)

    for cells in bands(h, n):
        k, every = cells.k, np.arange(len(cells.start))
        level = levels.get(k, np.ones(cells.slots, np.int64))[cells.segment % cells.slots] if k > 1 else np.full(len(every), k + 1)
        whole, near = np.flatnonzero(level > 0), np.flatnonzero((level > 1) & (cells.count > (k > 1)))
        give(cells.whole(whole), cells.docs[cells.of[whole]], k)
        sig, at = cells.deletions(near)
        give(sig, cells.docs[cells.of[at]], k)
        if k > 1:
            cover = np.bincount(cells.of[whole], minlength=len(cells.docs)) + np.bincount(cells.of[near], minlength=len(cells.docs))
            need = _need(cells.size, BANDS[k][1])
            slack[cells.docs, k & 1] = np.maximum(0, cover - need)
            alone = np.repeat((cover < need)[cells.of], cells.count)
            give(tk.mix(cells.e[alone] ^ cells.base), np.repeat(cells.docs[cells.of], cells.count)[alone], k)
    return np.concatenate(out), np.concatenate(of), slack


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _described(batches):
    """A row for each text, and at the end one for each band with the sums of its costs."""
    costs = Costs()
    for batch in batches:
        for i, j, data, offs in tk.blocks(batch.column(1)):
            h, _, n, whole = sets(data, offs)
            for cells in bands(h, n):
                costs.add(cells)
            empty = pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), _longs(whole), batch.column(2).slice(i, j - i), *empty], _DESCRIBED)
    yield from _sums(costs, _DESCRIBED)


_DESCRIBED = ["doc_id", "n", "node", "h", "band", "sums"]


def _sums(costs: Costs, names: list[str]):
    if costs.sums:
        of = len(costs.sums)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(of, pa.int64()) for _ in names[:-2]), pa.array(list(costs.sums), pa.int32()), pa.array([x.tobytes() for x in costs.sums.values()], pa.binary())], names)


def _merged(batches):
    costs = Costs()
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            costs.merge(k, np.frombuffer(raw).reshape(Costs.WIDTH, -1))
    yield from _sums(costs, ["band", "sums"])


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of signatures, in the order of the signatures."""
    return ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_SENT = "bucket long, kind int, sigs binary, nodes binary, hot binary"


def _sent(sig: np.ndarray, node: np.ndarray, buckets: int, slack: np.ndarray | None = None):
    """Rows of ``_SENT``: signatures in order and their vertices as arrays.

    Kind 0: the signatures of a bucket. Of a signature that more than ``HOT``
    of the sets have, all rows go in pieces of their own (kind 1) to buckets
    drawn by vertex, and one marker, with hot set, goes to the signature's
    bucket. Kind 2: vertices, and in place of signatures their ``slack``.
    """
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    count = np.diff(start, append=len(sig))
    many = count > HOT
    apart = np.repeat(many, count)
    rows = []
    for i in range(0, int(apart.sum()), FLUSH // 8):
        s, v = sig[apart][i : i + FLUSH // 8], node[apart][i : i + FLUSH // 8]
        rows.append((int(v[0] % np.uint64(buckets)), 1, s.tobytes(), v.tobytes(), None))
    if slack is not None and len(slack):
        rows.append((int(slack[0, 0] % buckets), 2, slack[:, 1].tobytes(), slack[:, 0].tobytes(), None))
    hot = np.zeros(len(sig), bool)
    hot[start[many]] = True
    stay = ~apart | hot
    sig, node, hot = sig[stay], node[stay], hot[stay]
    bucket = _bucket(sig, buckets)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for i, j in zip(cut, np.append(cut[1:], len(sig)), strict=True):
        rows.append((int(bucket[i]), 0, sig[i:j].tobytes(), node[i:j].tobytes(), np.packbits(hot[i:j]).tobytes()))
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "sigs", "nodes", "hot"])


MANY = 1 << 40  # rows of a signature that some have apart: more than any other


def _shared(parts: list[tuple[bytes, bytes, bytes]]):
    """(sig, node, rows) of one bucket's signatures with two vertices or more, or with rows apart."""
    sig, node = (np.concatenate([np.frombuffer(p[k], np.uint64) for p in parts]) for k in (0, 1))
    hot = np.concatenate([np.unpackbits(np.frombuffer(p[2], np.uint8), count=len(p[0]) // 8) for p in parts]).astype(bool)
    order = np.argsort(sig, kind="stable")
    sig, node, hot = sig[order], node[order], hot[order]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    count = np.diff(start, append=len(sig))
    marked = np.logical_or.reduceat(hot, start)
    keep = np.repeat((count > 1) | marked, count)
    marked = np.repeat(marked, count)[keep]
    sig, node = sig[keep], node[keep]
    order = np.lexsort((node, sig))
    sig, node, marked = sig[order], node[order], marked[order]
    if len(sig):
        new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node, marked = sig[new], node[new], marked[new]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(start, append=len(sig))
        rows = np.where(marked, MANY, np.repeat(count, count))
        keep = rows > 1
        yield pa.RecordBatch.from_arrays([_longs(sig[keep]), _longs(node[keep]), pa.array(rows[keep])], ["sig", "node", "rows"])


def _gathered(batches):
    """(sig, node, rows) by ``_shared`` of each bucket, which come one after the other; with rows -1 a vertex and its slack in place of sig."""
    bucket, parts = None, []
    for batch in batches:
        for own, kind, sigs, nodes, hot in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if own != bucket and parts:
                yield from _shared(parts)
                parts = []
            bucket = own
            if kind:
                sig, node = (np.frombuffer(x, np.uint64) for x in (sigs, nodes))
                yield pa.RecordBatch.from_arrays([_longs(sig), _longs(node), pa.array(np.full(len(sig), MANY if kind == 1 else -1))], ["sig", "node", "rows"])
            else:
                parts.append((sigs, nodes, hot))
    if parts:
        yield from _shared(parts)


def _candidates(texts: DataFrame, levels: dict[int, np.ndarray], elements: int) -> DataFrame:
    """(sig, node): vertices that share a signature after each has dropped what it may; of signatures with the same vertices one stands for all."""
    buckets = max(4 * width(texts.sparkSession), elements // BUCKET)

    def signed(batches):
        seen: set[int] = set()  # equal sets are signed once a task
        held, size = [], 0
        for batch in batches:
            for _, _, data, offs in tk.blocks(batch.column(0)):
                h, at, n, whole = sets(data, offs)
                new = np.zeros(len(n), bool)
                for d in np.flatnonzero(n):
                    if int(whole[d]) not in seen:
                        seen.add(int(whole[d]))
                        new[d] = True
                sig, of, slack = signatures(h[new[at]], np.where(new, n, 0), levels)
                loose = np.flatnonzero(new & slack.any(1))
                held.append((sig, whole[of], np.stack([whole[loose].view(np.int64), slack[loose, 0] << 31 | slack[loose, 1]], 1)))
                size += len(sig)
                if size >= FLUSH:
                    sig, node, slack = (np.concatenate([x[k] for x in held]) for k in range(3))
                    yield from _sent(sig, node, buckets, slack)
                    held, size = [], 0
        if size:
            sig, node, slack = (np.concatenate([x[k] for x in held]) for k in range(3))
            yield from _sent(sig, node, buckets, slack)

    sent = texts.mapInArrow(tidy(signed), _SENT)
    shared = sent.repartition(width(texts.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_gathered), "sig long, node long, rows long")
    shared = materialize(shared, "jaccard-shared")
    slack = shared.filter("rows < 0").select("node", F.col("sig").alias("slack")).distinct()
    band = F.col("sig").bitwiseAND(F.lit(1))
    place = F.row_number().over(Window.partitionBy("node", band).orderBy(F.col("rows").desc(), "sig"))
    loose = F.coalesce(F.when(band == 0, F.shiftright("slack", 31)).otherwise(F.col("slack").bitwiseAND(F.lit((1 << 31) - 1))), F.lit(0))
    # a vertex's own signatures are as many as its set, never more
    kept = shared.filter("rows > 0").distinct().join(slack, "node", "left").withColumn("place", place).filter(F.col("place") > loose).select("sig", "node")
    kept = materialize(kept, "jaccard-kept")
    alike = kept.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("alike")).filter("n > 1")
    standing = alike.groupBy("n", "alike").agg(F.min("sig").alias("sig")).select("sig")
    return materialize(kept.join(standing, "sig").select("sig", "node"), "jaccard-open")


def _parities(x: np.ndarray) -> bytes:
    """Bits of a set, as many as its size to the next power of two, each turned over by the elements at its place.

    Two sets differ in as many elements as bits, or more. The two halves
    together, by exclusive or, are the bits of the same set at half the number.
    """
    bits = 1 << max(LEAST_BITS.bit_length() - 1, int(len(x) - 1).bit_length())
    at = (tk.mix(x) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _half(bits: np.ndarray) -> np.ndarray:
    return bits[..., : bits.shape[-1] // 2] ^ bits[..., bits.shape[-1] // 2 :]


def _may_be_similar(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """By the bits of sets, rows of the same width or one twice as wide, and their sizes."""
    if a.shape[-1] > b.shape[-1]:
        a = _half(a)
    elif a.shape[-1] < b.shape[-1]:
        b = _half(b)
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= (n_a + n_b) // 7


def _near(n_a: pd.Series, bits_a: pd.Series, n_b: pd.Series, bits_b: pd.Series) -> pd.Series:
    """``_may_be_similar`` of pairs whose sizes are within 4/3 of each other, so that widths are within 2."""
    out = np.zeros(len(n_a), bool)
    wide = bits_a.str.len().to_numpy() * (1 << 32) + bits_b.str.len().to_numpy()
    for w in np.unique(wide):
        at = np.flatnonzero(wide == w)
        a, b = (np.frombuffer(b"".join(x.iloc[at]), np.uint64).reshape(len(at), -1) for x in (bits_a, bits_b))
        out[at] = _may_be_similar(a, n_a.to_numpy()[at], b, n_b.to_numpy()[at])
    return pd.Series(out)


def _elements(docs: DataFrame, described: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements) of the vertices in ``wanted``, each from one text, found by a bounded filter on the hashes of texts."""
    picked = materialize(described.join(wanted, "node").groupBy("node").agg(F.min("h").alias("h")), "jaccard-wanted")
    bloom, bits = repeated_filter(picked.select("h"), picked.count(), again=False)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def given(batches):
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(held_in(shared.value, bits, batch.column(1).to_numpy())))
            for _, _, data, offs in tk.blocks(batch.column(0)):
                h, _, n, whole = sets(data, offs)
                rows = [d for d in np.flatnonzero(n) if not (int(whole[d]) in seen or seen.add(int(whole[d])))]
                if rows:
                    first = np.concatenate([[0], np.cumsum(n)])
                    parts = [h[first[d] : first[d + 1]] for d in rows]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)), _longs(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([_longs(whole[rows]), pa.array(n[rows]), pa.array([_parities(x) for x in parts], pa.binary()), lists], ["node", "n", "bits", "elements"])

    return materialize(docs.select("text", "h").mapInArrow(tidy(given), "node long, n long, bits binary, elements array<long>").dropDuplicates(["node"]), "jaccard-sets")


def _verified(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: vertices) whose sets are similar: by bits first, which are few bytes, and then whole."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda name, *columns: elements.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    near = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    near = near.filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").filter(F.pandas_udf(_near, "boolean")("n_a", "bits_a", "n_b", "bits_b"))
    near = materialize(near.select("a", "b"), "jaccard-pairs")
    both = near.join(side("a", "elements"), "a").join(side("b", "elements"), "b")
    common = F.size(F.array_intersect("elements_a", "elements_b"))
    return both.filter(100 * common >= 75 * (F.size("elements_a") + F.size("elements_b") - common)).select("a", "b")


BLOCK = 1024  # vertices of one side of a block


def _block_near(key, frame):
    """The rows of a block, of both sides, that may be similar to one across roots, by their bits."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    near_left, near_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    wide = [side["bits"].str.len().to_numpy() for side in (left, right)]
    tables = {}
    for w in np.unique(wide[1]):
        at = np.flatnonzero(wide[1] == w)
        tables[w] = at, np.frombuffer(b"".join(right["bits"].iloc[at]), np.uint64).reshape(len(at), -1), right["n"].to_numpy()[at], right["root"].to_numpy()[at]
    for i, (own, n, root) in enumerate(zip(left["bits"], left["n"], left["root"], strict=True)):
        for w in (len(own) // 2, len(own), 2 * len(own)):
            if w in tables:
                at, bits, size, roots = tables[w]
                ask = np.flatnonzero((roots != root) & (4 * np.minimum(size, n) >= 3 * np.maximum(size, n)))
                if len(ask):
                    ask = ask[_may_be_similar(np.frombuffer(own, np.uint64)[None], n, bits[ask], size[ask])]
                    near_right[at[ask]] = True
                    near_left[i] |= len(ask) > 0
    return pd.concat([left[near_left], right[near_right]])[["large", "place", "c", "m", "side", "node", "root"]]


def _block_links(key, frame):
    """Links across roots between the two sides of a block, as many as connect what they connect."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    tokens, at = np.unique(np.concatenate([*right["elements"], np.zeros(0, np.int64)]), return_inverse=True)
    size = np.array([len(x) for x in right["elements"]], np.int64)
    owner = np.repeat(np.arange(len(right)), size)[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tokens)))])
    parent = {r: r for r in frame["root"]}

    def top(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    nodes, roots = right["node"].to_numpy(), right["root"].to_numpy()
    out = []
    for node, root, x in zip(left["node"], left["root"], left["elements"], strict=True):
        i, found = tk.lookup(tokens, x)
        i = i[found]
        count = first[i + 1] - first[i]
        places = np.repeat(first[i] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(i) else np.zeros(0, np.int64)
        common = np.bincount(owner[places], minlength=len(right))
        for j in np.flatnonzero(100 * common >= 75 * (len(x) + size - common)):
            a, b = top(root), top(roots[j])
            if a != b:
                parent[a] = b
                out.append((node, nodes[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _linked(elements: DataFrame, open_: DataFrame) -> DataFrame:
    """(node, root) of vertices that are linked, from ``open_`` (sig, node: vertices that share signatures)."""
    links = None
    for k in range(2):
        # one vertex for all signatures of a group first, then one drawn for each signature
        lot = F.struct("node") if k == 0 else F.struct(F.xxhash64("node", "sig").alias("lot"), "node")
        drawn = open_.groupBy("sig").agg(F.min(lot).alias("drawn"))
        if k:
            drawn = drawn.join(roots.withColumnRenamed("root", "drawn_root"), F.col("drawn.node") == roots["node"], "left").select("sig", "drawn", F.coalesce("drawn_root", "drawn.node").alias("drawn_root"))
            stars = rows.join(drawn, "sig").filter("root != drawn_root")
        else:
            stars = open_.join(drawn, "sig").filter("node != drawn.node")
        found = _verified(elements, stars.select(F.col("drawn.node").alias("a"), F.col("node").alias("b")))
        links = materialize(links.union(found) if k else found, "jaccard-links")
        roots = components(links)
        # a centre has been compared with all others of its signature
        open_ = open_.join(drawn.select("sig", F.col("drawn.node").alias("centre")), "sig").filter("node != centre").select("sig", "node")
        rows = open_.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        mixed = rows.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("sig")
        rows = materialize(rows.join(mixed, "sig"), "jaccard-parted")
        open_ = rows.select("sig", "node")
    # what may still be similar shares a signature across components: those are compared in blocks. Signatures with the
    # same smallest vertex are one from here on, for they have much the same vertices
    least = rows.groupBy("sig").agg(F.min("node").alias("least"))
    rows = materialize(rows.join(least, "sig").select(F.col("least").alias("sig"), "node", "root").distinct(), "jaccard-gathered")
    by_root = rows.groupBy("sig", "root").agg(F.count("*").alias("k"))
    by_sig = by_root.groupBy("sig").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("most")).select("sig", "n", F.col("most.root").alias("major"), (F.col("n") - F.col("most.k")).alias("minor"))
    # small signatures share blocks, each vertex once a block; a large one has blocks of its own
    small = F.col("n") <= BLOCK // 4
    bins = max(1, rows.count() // BLOCK)
    placed = rows.join(by_sig, "sig").withColumns({"large": ~small, "place": F.when(small, F.pmod(F.xxhash64("sig"), F.lit(bins))).otherwise(F.col("sig"))})
    placed = placed.withColumns({"chunks": F.when(small, 1).otherwise(F.ceil(F.col("n") / BLOCK)), "minors": F.when(small, 1).otherwise(F.ceil(F.col("minor") / BLOCK))})
    chunk, minor = F.pmod(F.xxhash64("node"), "chunks"), F.pmod(F.xxhash64("node"), "minors")
    block = ["large", "place", "c", "m"]
    right = placed.select("large", "place", "node", "root", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)).alias("m"), F.lit(1).alias("side"))
    left = placed.filter("root != major").select("large", "place", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), minor.alias("m"), F.lit(0).alias("side"))
    blocks = left.unionByName(right).distinct().join(elements.select("node", "n", "bits"), "node")
    near = materialize(blocks.groupBy(*block).applyInPandas(_block_near, "large boolean, place long, c long, m long, side int, node long, root long"), "jaccard-near")
    blocks = near.join(elements.select("node", "elements"), "node")
    more = blocks.groupBy(*block).applyInPandas(_block_links, "a long, b long")
    return components(links.union(more))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, text, h: a hash of the text): the rows as (doc_id, n, node, h), and (node, component_id) of every vertex."""
    spark = docs.sparkSession
    described = materialize(docs.mapInArrow(tidy(_described), "doc_id long, n long, node long, h long, band int, sums binary"), "jaccard-described")
    sums = described.filter("band is not null").select("band", "sums").repartition(min(width(spark), 64)).mapInArrow(tidy(_merged), "band int, sums binary")
    costs = Costs()
    for row in sums.collect():  # 64 rows a band at most, of up to SLOTS segments
        costs.merge(row["band"], np.frombuffer(bytes(row["sums"])).reshape(Costs.WIDTH, -1))
    described = described.filter("band is null").select("doc_id", "n", "node", "h")
    total = described.agg(F.sum("n")).first()[0] or 0
    open_ = _candidates(docs.select("text"), costs.levels(), total)
    elements = _elements(docs, described, open_.select("node").distinct())
    roots = materialize(_linked(elements, open_), "jaccard-roots")
    # the smallest id of each vertex, then of each component: one row a task before the shuffle
    smallest = described.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = materialize(smallest.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "jaccard-placed")
    by_root = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "jaccard-components")
    return described, placed.join(by_root, "root").select("node", "root", "component_id")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A null, empty or blank text has no shingles and is linked with nothing; its
    component is its own id. Repeated rows and ids keep a row each. Rows with a
    null id link others and get their component's smallest id, null if it has
    none. Texts of any length are one set each, held whole by one task. Other
    columns are not read, whatever their names. An empty table gives an empty
    table.
    """
    described, found = _components(_rows(docs, id_col, text_col))
    out = described.join(materialize(found.select("node", "component_id"), "jaccard-nodes"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays, with all its columns.

    A null id comes after all others; of rows with the same id the one with the
    smallest text hash stays, and of rows with the same id and text one. Rows
    without shingles all stay. Rows are told apart by id and text hash, so an
    id that two texts share loses neither for the other. Only rows that a
    filter of the hashes of texts in components of two rows or more lets
    through are shuffled.
    """
    described, found = _components(_rows(docs, id_col, text_col))
    rows = described.filter("n > 0").join(found.select("node", "root"), "node").select("root", "doc_id", "h")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    groups = materialize(rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first"), "jaccard-groups")
    linked = rows.join(groups, "root").select("doc_id", "h", ((F.col("h") == F.col("first.h")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("stays"))
    linked = materialize(linked.distinct(), "jaccard-linked")
    bloom, bits = repeated_filter(linked.select("h"), linked.count(), again=False)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(held_in(shared.value, bits, h.to_numpy()))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_h"))
    whole = whole.withColumn("asked", maybe("own_h"))
    asked = whole.filter("asked").join(linked, F.col("own_id").eqNullSafe(linked["doc_id"]) & (F.col("own_h") == linked["h"]), "left")
    # rows that repeat id and text are as good as each other
    firsts = asked.filter("stays").groupBy("own_id", "own_h").agg(F.first("row").alias("row"))
    return whole.filter("not asked").select("row").unionByName(asked.filter("stays is null").select("row")).unionByName(firsts.select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
