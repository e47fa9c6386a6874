"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``MIN`` bytes over it also starts earlier in the
corpus: in a text of a smaller id, or earlier in the same text. That is decided
for every start: its longest previous factor must be ``MIN`` or more.

The corpus is dealt out by content. Of the hashes of ``GRAM`` bytes in a string
of ``MIN`` bytes the least one (of equals the leftmost) anchors it, so equal
strings have equal anchors, at equal places. An anchor owns a run of starts in
its text; the bytes over that run are its context.

1. Anchors with equal hashes of gram and context are settled first: all starts
   but those of the first such anchor have a previous factor. That is done in
   each batch of texts, so a context of any frequency leaves one row a batch,
   and then for the corpus in one shuffle by gram.
2. First contexts whose gram has several contexts are laid side by side by
   gram, and a suffix array over each such group (ranks by doubling, cut at
   ``MIN`` bytes) gives longest-previous-factor arrays by previous and next
   smaller positions in suffix order.
3. A gram with more than ``MOST`` contexts is not laid into one array: the
   bytes that ``STEP`` neighbouring starts have in common become a row with
   their 128-bit hash, starts whose row is not alone become rows in turn, and
   the first start of each string is found by aggregation. That is exact too,
   for any size.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import materialize, table, tidy

MIN = 100
GRAM = 24
MOST = 4000  # contexts of one gram in one suffix array
ARRAY = 1 << 20  # bytes of one suffix array, where grams are small
CHUNK = 1 << 18  # starts looked at together; a longer text is taken in overlapping chunks
STEP = 8  # neighbouring starts that are looked at together where a gram is very frequent
SIDE = 36  # a string of MIN bytes has so many beside its gram, on the left or on the right
_BITS = 20
_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _rolling(data: np.ndarray, base: np.uint64, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all strings of the given sizes, by doubling; sizes are powers of 2."""
    with np.errstate(over="ignore"):
        out, h, size, power = {}, tk._BYTE[data], 1, base
        while True:
            if size in sizes:
                out[size] = h
            if size >= max(sizes) or len(h) <= size:
                return out
            h = h[:-size] * power + h[size:]
            power = power * power
            size *= 2


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start, gram hash, context hash) of the anchors of one text."""
    n = len(data)
    found = []
    for begin in range(0, max(1, n - MIN + 1), CHUNK):
        part = data[begin : begin + CHUNK + MIN - 1]
        if len(part) < MIN:
            continue
        with np.errstate(over="ignore"):
            base = _MULT[0]
            r = _rolling(part, base, (4, 8, 16, 32, 64))
            grams = tk.mix(r[16][: len(part) - GRAM + 1] * _power(base, 8) + r[8][16 : 16 + len(part) - GRAM + 1])
            # least of each MIN - GRAM + 1 grams, with its place in the low bits
            low = (grams & ~np.uint64((1 << _BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
            span, step = MIN - GRAM + 1, 1
            while 2 * step <= span:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if span > step:
                low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
            at = (low & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            first, last, place = new, np.append(new[1:], len(at)) - 1, at[new]

            def string(s):
                # hash of the MIN bytes from s on
                return r[64][s] * _power(base, 36) + r[32][s + 64] * _power(base, 4) + r[4][s + 96]

            # both ends of the context, which overlap, and where the anchor is in it
            context = tk.chain(string(first), string(last), (last - first).astype(np.uint64), (place - first).astype(np.uint64))
            found.append((place + begin, first + begin, last + begin, grams[place], context))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First start, starts after it and anchor's place after it in one long."""
    return (first << 16) | ((last - first) << 8) | (place - first)


def _anchored(batches):
    """Batches of (key, text) -> the first anchor of each context of the batch, and as own rows the spans of the others."""
    for batch in batches:
        keys, rows, of = batch.column(0).to_numpy(), [], []
        for i, j, data, offs in tk.blocks(batch.column(1)):
            for d in range(j - i):
                rows.append(anchors(data[offs[d] : offs[d + 1]]))
                of.append(np.full(len(rows[-1][0]), keys[i + d]))
        if not rows:
            continue
        place, first, last, gram, context = (np.concatenate(x) for x in zip(*rows, strict=True))
        of = np.concatenate(of)
        order = np.lexsort((first, of, context, gram))
        g, c = gram[order], context[order]
        later = np.zeros(len(g), bool)
        later[order] = np.append(False, (g[1:] == g[:-1]) & (c[1:] == c[:-1]))[: len(g)]
        own = np.flatnonzero(later)
        if len(own):  # runs of neighbouring anchors are one span
            new = np.append(True, (of[own[1:]] != of[own[:-1]]) | (first[own[1:]] > last[own[:-1]] + MIN))
            head, tail = own[new], own[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
            yield _rows(True, np.zeros(len(head), np.uint64), last[tail] + MIN, of[head], first[head])
        rest = np.flatnonzero(~later)
        for i in range(0, len(rest), 1 << 18):
            r = rest[i : i + (1 << 18)]
            yield _rows(False, gram[r], context[r], of[r], _pack(first[r], last[r], place[r]))


def _rows(own: bool, gram, context, key, at) -> pa.RecordBatch:
    longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, context, key, at)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), own)), *longs], ["own", "gram", "context", "key", "at"])


HELD = 1 << 19  # anchors that a task holds


def _settled(most: int):
    """Rows in order of gram, context and key -> covered spans (kind 0), and first contexts beside others of
    their gram (kind 1; kind 2 if the gram has more than ``most``)."""

    def settle(rows: np.ndarray, going: tuple | None):
        """going: gram and context before these rows, if the gram is known to have more than ``most`` contexts."""
        own, gram, context, key, at = rows
        first = (at >> 16) + 0
        end = first + ((at >> 8) & 255) + MIN
        first, end = np.where(own == 1, at, first), np.where(own == 1, context, end)
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new = new_gram | np.append(True, context[1:] != context[:-1])
        if going:
            new[0] = (gram[0], context[0]) != going
        number = np.cumsum(new_gram) - 1
        contexts = np.bincount(number, new & (own == 0))[number]
        kind = np.where(own == 1, 0, np.where(~new, 0, np.where(contexts > most, 2, np.where(contexts > 1, 1, 3))))
        if going:
            kind[(gram == going[0]) & new & (own == 0)] = 2
        k = np.flatnonzero(kind < 3)
        return pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (kind, gram, key, first, end, at)], ["kind", "gram", "key", "first", "end", "at"])

    def run(batches):
        held, size, going = [], 0, None
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *(batch.column(i).to_numpy() for i in range(1, 5))]))
            size += batch.num_rows
            if size < HELD:
                continue
            rows = np.concatenate(held, 1)
            cut = int(np.searchsorted(rows[1], rows[1, -1]))  # the last gram may go on
            if cut == 0:  # one gram only, and it goes on: its first context is among kind 2 too, which does no harm
                yield settle(rows, going or (rows[1, 0], rows[2, 0] - 1))
                held, size, going = [], 0, (rows[1, -1], rows[2, -1])
            else:
                yield settle(rows[:, :cut], going)
                held, size, going = [rows[:, cut:]], rows.shape[1] - cut, None
        if size:
            yield settle(np.concatenate(held, 1), going)

    return run


def lpf_marks(texts: list[bytes], order: np.ndarray, length: int = MIN) -> list[np.ndarray]:
    """For each text, which starts have a previous factor of ``length`` or more.

    ``order``: rank of each text in the corpus; positions compare by it and then
    by place. Longest previous factors are cut at ``length``: of a start, the
    longer of its common prefixes with the nearest suffixes in suffix order
    that lie earlier in the corpus.
    """
    gap = 1  # a text's end is a symbol of its own
    turn = np.argsort(order, kind="stable")
    size = np.array([len(texts[t]) + gap for t in turn])
    start = np.concatenate([[0], np.cumsum(size)])
    s = np.zeros(start[-1] + 2 * length, np.int64)
    for t, b in zip(turn, start, strict=False):
        s[b : b + len(texts[t])] = np.frombuffer(texts[t], np.uint8).astype(np.int64) + 1
    n = int(start[-1])
    ends = start[1:] - 1
    # ranks of prefixes of doubling lengths; ends and what is beyond them stay apart
    rank = s.copy()
    rank[ends] = 257 + np.arange(len(ends))
    rank[n:] = 0
    levels, width = [(1, rank[:n])], 1
    while width < length:
        step = min(width, length - width)
        shifted = np.zeros(n, np.int64)
        shifted[: n - step] = rank[step:n]
        joined = rank[:n] * (n + 300) + shifted
        values, rank = np.unique(joined, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        width += step
        levels.append((width, rank))
    # suffix order, positions ascending among equals
    suffixes = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)  # with the suffix before, cut at length
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for width, ranks in reversed(levels):
        inside = (a < n) & (b < n) & (got + width <= length)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        got[same] += width
        a[same] += width
        b[same] += width
    common[1:] = got
    lpf = np.zeros(n, np.int64)
    for forward in (True, False):
        np.maximum(lpf, _smaller(suffixes, common, forward), out=lpf)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(texts)
    for t, b in zip(turn, start, strict=False):
        out[t] = lpf[b : b + len(texts[t])] >= length
    return out


def _smaller(suffixes: np.ndarray, common: np.ndarray, forward: bool) -> np.ndarray:
    """By position: common prefix with the previous (or next) smaller position in suffix order.

    All pointers jump at once, over runs of larger positions, until each rests
    on a smaller one; a pointer with nothing left in common stops.
    """
    n = len(suffixes)
    if not forward:
        suffixes, common = suffixes[::-1], np.append(0, common[1:][::-1])
    to, least = np.arange(n) - 1, common.copy()
    busy = np.flatnonzero((to >= 0) & (least > 0))
    busy = busy[suffixes[to[busy]] > suffixes[busy]]
    while len(busy):
        over = to[busy]
        least[busy] = np.minimum(least[busy], least[over])
        to[busy] = to[over]
        busy = busy[(to[busy] >= 0) & (least[busy] > 0)]
        busy = busy[suffixes[to[busy]] > suffixes[busy]]
    rests = (to >= 0) & (least > 0)
    rests[rests] = suffixes[to[rests]] < suffixes[rests]
    out = np.zeros(n, np.int64)
    out[suffixes] = np.where(rests, least, 0)
    return out


def _spans(marks: np.ndarray, base: int) -> list[tuple[int, int]]:
    """(first byte, end) of the runs covered by the marked starts, in the text's own places."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > MIN)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return [(int(a) + base, int(b) + base + MIN) for a, b in zip(first, last, strict=True)]


def _worth(held: list[tuple]) -> list[tuple]:
    """Those contexts that share the bytes left or right of their gram with another; no other can match."""
    sides = []
    for gram, _, at, text in held:
        a = at & 255
        sides.append(((gram, 0, text[a - SIDE : a]) if a >= SIDE else None, (gram, 1, text[a + GRAM : a + GRAM + SIDE]) if a + GRAM + SIDE <= len(text) else None))
    many = Counter(side for both in sides for side in both if side)
    return [row for row, (x, y) in zip(held, sides, strict=True) if x and many[x] > 1 or y and many[y] > 1]


def _arrays(batches):
    """Rows sorted by gram -> covered spans; whole grams together, several small ones in one array."""
    held: list[tuple] = []

    def settle():
        near = _worth(held)
        order = np.lexsort(([r[2] for r in near], [r[1] for r in near]))
        rank = np.empty(len(near), np.int64)
        rank[order] = np.arange(len(near))
        rows = []
        for (_, key, at, _), marks in zip(near, lpf_marks([r[3] for r in near], rank) if near else (), strict=True):
            rows += [(key, a, b) for a, b in _spans(marks, at >> 16)]
        keys, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "first", "end"])

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size > ARRAY and row[0] != held[-1][0]:
                yield settle()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield settle()


def _contexts(batches):
    """Texts with a list of packed places and grams -> the bytes of each context."""
    for batch in batches:
        for key, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows = [(x["gram"], key, x["at"], text[x["at"] >> 16 : (x["at"] >> 16) + (x["at"] >> 8 & 255) + MIN], x["hot"]) for x in asked]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["gram", "key", "at", "bytes", "hot"])


def _steps(batches):
    """Contexts -> for each STEP starts a row with the 128-bit hash of the bytes that their strings have in common."""
    for batch in batches:
        rows = []
        for key, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            anchor, last = at & 255, len(text) - MIN
            k = 0
            while k <= last:
                # steps end at fixed distances from the anchor, so equal strings fall into equal steps
                stop = k + STEP - (k - anchor) % STEP
                # the strings of a whole step share the bytes from its last start to its first one's end
                low = stop - STEP
                common = (low - anchor).to_bytes(2, "little", signed=True) + text[stop - 1 : low + MIN]
                rows.append((hashlib.blake2b(common, digest_size=16).digest(), key, at, k))
                k = stop
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["step", "key", "at", "k"])


def _starts(batches):
    """Contexts with asked steps -> a row per start with the 128-bit hash of its string."""
    for batch in batches:
        rows = []
        for key, at, text, steps in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for k in steps:
                stop = k + STEP - (k - (at & 255)) % STEP
                rows += [(hashlib.blake2b(text[i : i + MIN], digest_size=16).digest(), key, (at >> 16) + i) for i in range(k, min(stop, len(text) - MIN + 1))]
        for i in range(0, len(rows), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + (1 << 18)], strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["string", "key", "first"])


def _cut(batches):
    """Texts with covered spans -> what is removed and what is kept."""
    for batch in batches:
        out = []
        for key, text, spans in zip(*(batch.column(name).to_pylist() for name in ("key", "text", "spans")), strict=True):
            text, runs = text or b"", []
            for a, b in sorted((s["first"], s["end"]) for s in spans or []):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)], strict=True))
            out.append((key, len(text), len(text) - len(kept), [{"first": a, "end": b} for a, b in runs], kept, hashlib.sha256(kept).hexdigest()))
        spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        if out:
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), spans, pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*made, batch.column("rest")], ["key", "n_bytes", "n_removed", "spans", "kept", "kept_sha256", "rest"])


def repeated_spans(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(key, first, end), overlapping, of what is covered in ``texts`` (key long in corpus order, text binary)."""
    rows = texts.mapInArrow(tidy(_anchored), "own boolean, gram long, context long, key long, at long")
    rows = rows.repartition(F.when(F.col("own"), F.xxhash64("key", "at")).otherwise(F.col("gram"))).sortWithinPartitions("gram", "context", "key", "at")
    settled = materialize(rows.mapInArrow(tidy(_settled(most)), "kind long, gram long, key long, first long, end long, at long"), "suffix-settled")
    covered = settled.filter("kind = 0").select("key", "first", "end")
    asked = settled.filter("kind > 0").groupBy("key").agg(F.collect_list(F.struct("gram", "at", (F.col("kind") == 2).alias("hot"))).alias("asked"))  # at most one for each start of the text
    beside = materialize(texts.join(asked, "key").select("key", "text", "asked").mapInArrow(tidy(_contexts), "gram long, key long, at long, bytes binary, hot boolean"), "suffix-contexts")
    small = beside.filter("not hot").select("gram", "key", "at", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(tidy(_arrays), "key long, first long, end long")
    hot = beside.filter("hot").select("key", "at", "bytes")
    steps = hot.mapInArrow(tidy(_steps), "step binary, key long, at long, k int")
    several = materialize(steps.groupBy("step").agg(F.count("*").alias("n")).filter("n > 1").select("step"), "suffix-steps")
    open_ = steps.join(several, "step").groupBy("key", "at").agg(F.collect_list("k").alias("steps"))  # at most MIN - GRAM + 1
    starts = hot.join(open_, ["key", "at"]).select("key", "at", "bytes", "steps").mapInArrow(tidy(_starts), "string binary, key long, first long")
    least = materialize(starts.groupBy("string").agg(F.min(F.struct("key", "first")).alias("least"), F.count("*").alias("n")).filter("n > 1"), "suffix-strings")
    large = starts.join(least.select("string", "least"), "string").filter(F.struct("key", "first") != F.col("least")).select("key", "first", (F.col("first") + MIN).alias("end"))
    return covered.unionByName(small).unionByName(large)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept, kept_sha256 of every row, and its other columns as struct rest.

    A null text is empty. Rows of one id count as texts in an order of their
    own, and rows with a null id come before all others. Texts shorter than
    ``MIN`` bytes keep all. Other columns may have any names; those that are
    not used later are not read.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    rows = docs.select(rest.alias("rest"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    # ids are keys, if each is there once; otherwise rows get keys in the order of ids
    plain = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct")).first()
    if plain["n"] == plain["ids"] == plain["distinct"]:
        texts = rows.withColumn("key", F.col("doc_id"))
    else:
        texts = materialize(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("key", F.monotonically_increasing_id()), "suffix-keyed")
    spans = repeated_spans(texts.select("key", "text"), most)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))  # at most one for each start of the text
    whole = texts.select("key", "text", F.struct("doc_id", "rest").alias("rest"))
    kinds = whole.schema["rest"].dataType.simpleString()
    cut = whole.join(spans, "key", "left").mapInArrow(tidy(_cut), f"key long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary, kept_sha256 string, rest {kinds}")
    return cut.select("rest.doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256", "rest.rest")


def query(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
