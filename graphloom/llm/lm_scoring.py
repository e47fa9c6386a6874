"""Language-model scoring with a hashed maximum-entropy model.

The model gives each token the probability of its class and of the word in its
class, log-linear in hashed features of the words before it: the word before
(bigram), the two before (trigram), and the second before alone (skip). The
``TOP`` most frequent tokens, in classes of ``IN_CLASS``, have a softmax of
their own in their class; every other word belongs to a class by the look of
its end and is found there by the bits of its hash: each bit is a softmax of
two, which starts from the training counts of both sides and has features of
the words before, so every word has evidence of its own. Words that share all
bits part by their add-half counts, and each class has room for one unseen
word. All probabilities of a context sum to one. Words outside the top ones are
told apart as history too, by hashed rows.

Training is distributed: in each of ``ROUNDS`` rounds the tasks, with the same
weights, sum the gradient and the curvature of their texts for every weight;
the sums of all tasks are added up in slices on the executors, and the weights
take one step of gradient over curvature. So the model is the same however the
texts are split, but for rounding. A round takes its own share of the training
texts, so training reads each of them once. Hashed weights grow with the root
of the training tokens (``hashed_rows``), and so do the bits.

Counts cover the whole training part. Words are told apart by 64-bit hashes.
The ``KNOWN`` most frequent words and their counts are broadcast (16 MB at
most); what a text holds beyond them is joined with the table of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import fold, materialize, table, tidy, width

TOP, IN_CLASS, SHAPES = 768, 32, 40
OWN = TOP // IN_CLASS
CLASSES = OWN + SHAPES
SYMBOLS = TOP + SHAPES + 1  # the last: before the text
TRIGRAMS = 4096
ROWS = 2 * SYMBOLS + TRIGRAMS  # and then those of the word before, hashed
WORD_ROWS = 8192
KNOWN = 1 << 20
ROUNDS = 3
STEPS = (0.9, 0.6, 0.4)  # of gradient over curvature, in each round; the last goes on
PRIOR = 2.0  # curvature that every weight has beside the texts'
MOST = 2.0  # a weight moves no further in a round
BATCH = 8192
END = np.uint64(0x5E5E5E5E5E5E5E5F)
_SLICE = 1 << 14  # weights that travel together
_MIX, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashed_rows(tokens: float) -> int:
    """Hashed weights of bits: a power of two that grows with the root of the training tokens, 4 MB at 100 million tokens."""
    return 1 << max(16, int(np.ceil(np.log2(128 * np.sqrt(max(tokens, 1))))))


def bits(words: float, hashed: int) -> int:
    """Bits that leave four words of so many to a place on average; places are no more than a quarter of the hashed weights."""
    n = 1
    while 4 * SHAPES << n < words and SHAPES << n + 3 <= hashed:
        n += 1
    return n


def leaves(h: np.ndarray, shape: np.ndarray, depth: int) -> np.ndarray:
    """The place of each word after all its bits; a shape's first place is the unseen word's too."""
    return shape * (1 << depth) + (h * _MIX >> np.uint64(64 - depth)).astype(np.int64)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shapes, ptr) of lower-case words and an end after each text."""
    data = tk.lower(data)
    starts, ends, ptr = tk.words(data, offs)
    n = len(offs) - 1
    h, shape = np.full(len(starts) + n, END, np.uint64), np.zeros(len(starts) + n, np.int64)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(ptr))
    h[at] = tk.span_hashes(data, starts, ends)
    if len(starts):
        last = data[ends - 1].astype(np.int64)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
        shape[at] = (last * 31 + before * 7) % 2039 % SHAPES
    return h, shape, ptr + np.arange(n + 1)


TABLES = ("weights", "word_weights", "bit_weights")


class MaxEnt:
    def __init__(self, top: np.ndarray, top_count: np.ndarray, shape_n: np.ndarray, shape_v: np.ndarray, leaf: np.ndarray, leaf_room: np.ndarray, depth: int, hashed: int):
        """top: hashes of the most frequent tokens, best first, with counts; tokens and words of each shape, and the add-half counts of places of ``leaves``, without them."""
        self.rank = np.argsort(top)
        self.index = tk.Index(top[self.rank])
        self.room = shape_n + 0.5 * (shape_v + 1)  # what the share of a word in its shape is of
        counts = np.zeros(TOP)
        counts[: len(top)] = top_count
        self.depth, self.hashed = depth, hashed
        self.leaf_room = np.zeros(SHAPES << depth, np.float32)
        self.leaf_room[leaf] = leaf_room
        self.leaf_room[:: 1 << depth] += 0.5  # the unseen word
        levels = [self.leaf_room.reshape(SHAPES << k, 2, -1).sum(2) for k in range(depth)]
        self.level = np.cumsum([0, *(len(x) for x in levels)])
        share = np.concatenate(levels)
        self.parted = (share > 0).all(1)  # elsewhere a bit is certain
        self.bit_prior = np.log((share[:, 1] + 1e-9) / (share[:, 0] + 1e-9)).astype(np.float32)
        self.prior = np.log(np.concatenate([counts.reshape(OWN, IN_CLASS).sum(1), self.room]) + 1e-3).astype(np.float32)
        self.word_prior = np.log(counts.reshape(OWN, IN_CLASS) + 1e-3).astype(np.float32)
        self.weights = np.zeros((ROWS + (hashed >> 8), CLASSES), np.float32)
        self.word_weights = np.zeros((WORD_ROWS, IN_CLASS), np.float32)
        self.bit_weights = np.zeros(hashed, np.float32)

    def encode(self, h: np.ndarray, shape: np.ndarray, ptr: np.ndarray):
        """(class, word in class or -1, features (4, n), word features (2, n)) of every token."""
        at, found = self.index.find(h)
        rank = self.rank[at] if len(self.rank) else at
        symbol = np.where(found, rank, TOP + shape)
        back = []
        inside = np.arange(len(h)) - np.repeat(ptr[:-1], np.diff(ptr))
        for k in (1, 2):
            s = np.full(len(h), SYMBOLS - 1)
            s[k:] = np.where(inside[k:] >= k, symbol[:-k] if k < len(h) else s[k:], SYMBOLS - 1)
            back.append(s)
        group = np.where(found, rank // IN_CLASS, OWN + shape)
        word = np.where(found, rank % IN_CLASS, -1)
        pair = (back[0] * 7919 + back[1] * 104729) % 1000003
        before = self._place(self.before(h, ptr, 1), _MIX_2, self.hashed >> 8)
        kind = np.uint16 if len(self.weights) <= 1 << 16 else np.int32
        features = np.stack([back[0], SYMBOLS + back[1], 2 * SYMBOLS + pair % TRIGRAMS, ROWS + before]).astype(kind)
        own = np.where(found, group, 0)
        word_features = np.stack([(back[0] * 31 + own * 2477) % WORD_ROWS, (pair * 17 + own * 2477 + 4099) % WORD_ROWS]).astype(np.uint16)
        return group, word, features, word_features

    @staticmethod
    def before(h: np.ndarray, ptr: np.ndarray, k: int) -> np.ndarray:
        """The hash of the k-th word before each token, 0 before the text."""
        out = np.zeros(len(h), np.uint64)
        out[k:] = h[:-k] if k < len(h) else out[k:]
        for i in range(k):
            at = ptr[:-1] + i
            out[at[at < ptr[1:]]] = 0
        return out

    @staticmethod
    def _place(what: np.ndarray, salt: np.uint64, size: int) -> np.ndarray:
        x = (what ^ (what >> np.uint64(29))) * salt
        return (x >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def tail(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray):
        """For each bit (tokens whose bit is not certain, logits, places of both features, bits); one, two: hashes of the words before."""
        for k in range(self.depth):
            node = self.level[k] + (leaf >> self.depth - k)
            at = np.flatnonzero(self.parted[node])
            node = node[at]
            salted = node.astype(np.uint64) * _MIX
            places = self._place(one[at] + salted, _MIX_2, self.hashed), self._place((two[at] ^ salted) + _MIX_2, _MIX, self.hashed)
            yield at, self.bit_prior[node] + self.bit_weights[places[0]] + self.bit_weights[places[1]], places, leaf[at] >> self.depth - k - 1 & 1

    def tail_log(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logs of a place's probability in its shape, without the share of the word's count in it."""
        out = -np.log(self.leaf_room[leaf] + 1e-30).astype(np.float64)
        for i in range(0, len(leaf), BATCH):
            s = slice(i, i + BATCH)
            for at, logit, _, bit in self.tail(leaf[s], one[s], two[s]):
                out[i + at] -= np.log1p(np.exp(np.where(bit == 1, -logit, logit)))
        return out

    @staticmethod
    def _softmax(weights: np.ndarray, features: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shifted logits, their exponentials, the sums of these)."""
        logits = np.take(weights, features[0], axis=0)
        logits += base
        more = np.empty_like(logits)
        for f in features[1:]:
            logits += np.take(weights, f, axis=0, out=more, mode="clip")
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=more)
        return logits, more, more.sum(1)

    def log_probability(self, h: np.ndarray, shape: np.ndarray, ptr: np.ndarray, unseen: np.ndarray, doubtful: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(natural logs without the counts of words outside the top ones, whether a token is a top one, what is added if a doubtful one is unseen)."""
        out = np.zeros(len(h))
        group, word, features, word_features = self.encode(h, shape, ptr)
        for i in range(0, len(h), BATCH):
            s = slice(i, i + BATCH)
            logits, _, total = self._softmax(self.weights, features[:, s], self.prior)
            out[s] = logits[np.arange(len(logits)), group[s]] - np.log(total)
            top = np.flatnonzero(word[s] >= 0)
            logits, _, total = self._softmax(self.word_weights, word_features[:, s][:, top], self.word_prior[group[s][top]])
            out[i + top] += logits[np.arange(len(top)), word[s][top]] - np.log(total)
        own = word >= 0
        rest = np.flatnonzero(~own)
        one, two = self.before(h, ptr, 1), self.before(h, ptr, 2)
        first = shape << self.depth
        leaf = np.where(unseen, first, leaves(h, shape, self.depth))
        out[rest] += self.tail_log(leaf[rest], one[rest], two[rest])
        doubtful = np.flatnonzero(doubtful)
        more = self.tail_log(first[doubtful], one[doubtful], two[doubtful]) - self.tail_log(leaf[doubtful], one[doubtful], two[doubtful])
        return out, own, more

    def sums(self) -> list[np.ndarray]:
        """Room for gradient and curvature of each table."""
        return [np.zeros((2, getattr(self, name).size), np.float32) for name in TABLES]

    def gradient(self, sums: list[np.ndarray], h: np.ndarray, shape: np.ndarray, ptr: np.ndarray) -> None:
        """Add the tokens' gradients of the log-likelihood and its curvatures to ``sums``, in sparse batches."""
        group, word, features, word_features = self.encode(h, shape, ptr)
        one, two, leaf = self.before(h, ptr, 1), self.before(h, ptr, 2), leaves(h, shape, self.depth)
        events: list[list[np.ndarray]] = [[], [], []]
        for i in range(0, len(h), BATCH):
            s = slice(i, i + BATCH)
            self._expected(sums[0], self.weights, features[:, s], self.prior)
            top = np.flatnonzero(word[s] >= 0)
            if len(top):
                self._expected(sums[1], self.word_weights, word_features[:, s][:, top], self.word_prior[group[s][top]])
            rest = i + np.flatnonzero(word[s] < 0)
            for _, logit, places, bit in self.tail(leaf[rest], one[rest], two[rest]):
                p = 1 / (1 + np.exp(-logit))
                for place in places:
                    for kept, x in zip(events, (place, bit - p, p * (1 - p)), strict=True):
                        kept.append(x)
        if events[0]:
            place = np.concatenate(events[0])
            for k in (0, 1):
                sums[2][k] += np.bincount(place, np.concatenate(events[k + 1]), self.hashed)
        top = np.flatnonzero(word >= 0)
        for table, f, target in ((0, features, group), (1, word_features[:, top], word[top])):
            # what was seen: a gradient of one, and half the curvature of a class seen as often as expected
            seen = np.bincount((f.astype(np.int64) * (CLASSES, IN_CLASS)[table] + target).ravel(), minlength=sums[table].shape[1])
            sums[table][0] += seen
            sums[table][1] += 0.5 * seen

    @staticmethod
    def _expected(sums: np.ndarray, weights: np.ndarray, features: np.ndarray, base: np.ndarray) -> None:
        _, p, total = MaxEnt._softmax(weights, features, base)
        p /= total[:, None]
        p = np.ascontiguousarray(p.T)  # sums run over neighbours in memory
        both = sums.reshape(2, *weights.shape)
        for f in features:
            order = np.argsort(f, kind="stable")
            f = f[order]
            begin = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
            expected = np.add.reduceat(np.take(p, order, axis=1), begin, axis=1).T
            rows = f[begin]
            both[0, rows] -= expected
            both[1, rows] += 0.5 * expected

    def step(self, table: int, start: int, gradient: np.ndarray, curvature: np.ndarray, rate: float) -> None:
        """Move the weights of ``table`` from ``start`` on."""
        weights = getattr(self, TABLES[table]).reshape(-1)
        weights[start : start + len(gradient)] += rate * np.clip(gradient / (curvature + PRIOR), -MOST, MOST)


def _counted(batches):
    for batch in batches:
        for _, _, data, offs in tk.blocks(batch.column(0)):
            h, shape, _ = tokens(data, offs)
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(shape[first]), pa.array(n)], ["h", "shape", "n"])


def _summed(batches):
    """Sums of slices, added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, np.float32)
            sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["slice", "sums"])


def train_round(texts: DataFrame, model: MaxEnt, rate: float) -> MaxEnt:
    """``model`` after one step by the gradient over ``texts`` (its only column)."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def summed(batches):
        sums = shared.value.sums()
        for batch in batches:
            for _, _, data, offs in tk.blocks(batch.column(0)):
                shared.value.gradient(sums, *tokens(data, offs))
        for k, both in enumerate(sums):
            for i in range(0, both.shape[1], _SLICE):
                part = both[:, i : i + _SLICE]
                if part[1].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE * len(TABLES) + k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "sums"])

    # each task gives sums as large as the weights, so there are only as many as the cluster has cores
    parts = texts.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(tidy(summed), "slice int, sums binary")
    for row in parts.repartition(width(spark), "slice").mapInArrow(tidy(_summed), "slice int, sums binary").collect():  # twice as large as the weights
        i, k = divmod(row["slice"], len(TABLES))
        model.step(k, i * _SLICE, *np.frombuffer(bytes(row["sums"]), np.float32).reshape(2, -1), rate)
    shared.destroy()
    return model


def train(texts: DataFrame, key: str, text_col: str = "text", rounds: int = ROUNDS) -> tuple[MaxEnt, DataFrame, dict]:
    """(model, table of counts h, shape, n, totals) from all of ``texts``; ``key`` deals them to rounds."""
    counts = materialize(texts.select(text_col).mapInArrow(tidy(_counted), "h long, shape long, n long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "lm-counts")
    best = counts.orderBy(F.col("n").desc(), "h").limit(TOP).toPandas()
    end = np.int64(END.view(np.int64)) if hasattr(END, "view") else int(END)
    if len(best) and not (best["h"] == end).any():
        best = best.iloc[:-1] if len(best) == TOP else best
        best = type(best)({"h": [*best["h"], end], "shape": [*best["shape"], 0], "n": [*best["n"], counts.filter(F.col("h") == int(end)).agg(F.sum("n")).first()[0] or 0]})
    shapes = {r["shape"]: r for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    shape_n, shape_v = (np.array([float(shapes[s][k]) if s in shapes else 0.0 for s in range(SHAPES)]) for k in ("n", "v"))
    np.subtract.at(shape_n, best["shape"].to_numpy(np.int64), best["n"].to_numpy(float))
    np.subtract.at(shape_v, best["shape"].to_numpy(np.int64), 1.0)
    totals = {"n": sum(r["n"] for r in shapes.values()), "v": sum(r["v"] for r in shapes.values())}
    hashed = hashed_rows(totals["n"])
    depth, top = bits(totals["v"], hashed), best["h"].to_numpy(np.int64)

    def placed(batches):
        for batch in batches:
            h, shape, n = (batch.column(k).to_numpy() for k in range(3))
            rest = ~np.isin(h, top)
            yield pa.RecordBatch.from_arrays([pa.array(leaves(h.view(np.uint64), shape, depth)[rest]), pa.array(n[rest] + 0.5)], ["leaf", "room"])

    places = counts.mapInArrow(tidy(placed), "leaf long, room double").groupBy("leaf").agg(F.sum("room").alias("room")).toArrow()  # at most a quarter as many as hashed weights
    model = MaxEnt(top.view(np.uint64), best["n"].to_numpy(float), shape_n, shape_v, places["leaf"].to_numpy(), places["room"].to_numpy(), depth, hashed)
    for k in range(rounds):
        model = train_round(texts.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k).select(text_col), model, STEPS[min(k, len(STEPS) - 1)])
    return model, counts, totals


def score(docs: DataFrame, model: MaxEnt, counts: DataFrame, totals: dict, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is its end token alone. Repeated rows and ids keep a
    row each, a null id stays null, and other columns, whatever their names, are
    not read. Without training texts every token is unseen.
    """
    spark = docs.sparkSession
    least_n = 1 << 62  # no word, until one count fits
    at_least = 0
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).toLocalIterator():
        at_least += row["words"]
        if at_least > known:
            break
        least_n = row["n"]
    frequent = counts.filter(F.col("n") >= least_n).select("h", "n").toArrow()  # at most ``known`` rows
    keys, n = frequent["h"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((model, tk.Index(keys[order]), np.log10(n[order] + 0.5)))
    least = np.log10(totals["n"] + 0.5 * (totals["v"] + 1))
    complete = at_least <= known  # then no word is anywhere else

    def scored(batches):
        model, index, log_count = shared.value
        for batch in batches:
            for i, j, data, offs in tk.blocks(batch.column(2)):
                h, shape, ptr = tokens(data, offs)
                of = np.repeat(np.arange(j - i), np.diff(ptr))
                at, found = index.find(h)
                logs = np.where(found, log_count[at] if len(log_count) else 0.0, np.log10(0.5) if complete else 0.0)
                rare = ~found & (not complete)
                score, own, more = model.log_probability(h, shape, ptr, ~found & complete, rare)
                score = score / np.log(10) + np.where(own, 0.0, logs)
                rare = np.flatnonzero(rare)
                cut = np.searchsorted(of[rare], np.arange(j - i + 1))
                sums = [np.bincount(of, v, j - i) for v in (logs, score)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(ptr).astype(np.int64)), pa.array(np.bincount(of, found, j - i).astype(np.int64)),
                        pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(h[rare].view(np.int64)), pa.array(more / np.log(10))], ["h", "unseen"])),
                    ],
                    ["row_key", "doc_id", "n_tokens", "n_known", "logs", "score", "rare"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(tidy(scored), "row_key long, doc_id long, n_tokens long, n_known long, logs double, score double, rare array<struct<h:long,unseen:double>>"), "lm-scored")
    if not complete:
        # words beyond the frequent ones: no such word has many rows
        asked = rows.select("row_key", F.inline("rare"))
        found = asked.join(counts.select("h", "n"), "h", "left").groupBy("row_key").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n").isNull(), F.col("unseen"))).alias("unseen"))
        rows = rows.join(found, "row_key", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "logs": F.col("logs") + F.coalesce("rest", F.lit(0.0)), "score": F.col("score") + F.coalesce("rest", F.lit(0.0)) + F.coalesce("unseen", F.lit(0.0))})
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(float(least))).alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    model, counts, totals = train(docs.filter(~held_out), "doc_id")
    return score(docs, model, counts, totals).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
