"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded from
hashed words and a few measures of its form; gated attention gives each
passage a weight, and the weighted mean of the encodings is scored. Only
document labels are needed: which passages matter is learned with the rest.

The fit uses at most ``MAX_DOCS`` labelled texts of each class (the smallest by
hash of the id) and runs on the driver, for it is that small; every text is
scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import fold, labelled_sample, table, tidy

MAX_DOCS = 1500
PASSAGE = 64
BUCKETS = 128
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 12, 128, 3e-3
MARKS = [b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?", b".,;:", b"\n"]
_MARKS = np.zeros((len(MARKS), 256), bool)
for _i, _set in enumerate(MARKS):
    _MARKS[_i, list(_set)] = True
WIDTH = BUCKETS + len(MARKS) + 4


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text numbers) of all passages; a text without words has one, of zeros."""
    n = len(offs) - 1
    starts, ends, ptr = tk.words(data, offs)
    count = np.diff(ptr)
    each = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    g = np.repeat(np.arange(n), each)
    x = np.zeros((len(g), WIDTH), np.float32)
    if not len(starts):
        return x, g
    of = np.repeat(np.arange(n), count)
    of = first[of] + (np.arange(len(starts)) - ptr[of]) // PASSAGE  # passage of each word
    h = tk.span_hashes(tk.lower(data), starts, ends)
    bag = np.bincount(of * BUCKETS + (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=len(g) * BUCKETS).reshape(-1, BUCKETS)
    size = np.maximum(1, np.bincount(of, minlength=len(g)))
    x[:, :BUCKETS] = np.sqrt(bag / size[:, None])
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))  # first words of passages that have any
    own = of[begin]
    low = np.where(np.isin(begin, ptr), offs[g[own]], starts[begin])  # the white space before a text counts too
    high = np.append(low[1:], len(data))
    high = np.minimum(high, offs[g[own] + 1])
    for i, table_ in enumerate(_MARKS):
        total = np.concatenate([[0], np.cumsum(table_[data], dtype=np.int64)])
        x[own, BUCKETS + i] = (total[high] - total[low]) / size[own]
    _, at, _ = tk.unique_in_group(h, of)
    x[:, -4] = 1 - np.bincount(at, minlength=len(g)) / size
    x[:, -3] = np.bincount(of, ends - starts, len(g)) / size / 8
    x[:, -2] = size / PASSAGE
    x[:, -1] = 1
    return x, g


def _segments(v: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sums of v by g, which ascends without gaps."""
    return np.add.reduceat(v, np.flatnonzero(np.append(True, g[1:] != g[:-1])), axis=0)


class Attention:
    """The network: encoder, gated attention, and a logistic score of the weighted mean."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, a**-0.5, (a, b)).astype(np.float32)
        self.p = {"W": init(WIDTH, HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, g: np.ndarray) -> dict:
        p = self.p
        e = np.tanh(x @ p["W"])
        t, s = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        weight = np.exp((t * s) @ p["w"])  # at most exp of the sum of |w|: no overflow
        alpha = weight / _segments(weight, g)[g]
        z = _segments(alpha[:, None] * e, g)
        return {"e": e, "t": t, "s": s, "alpha": alpha, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradient(self, x: np.ndarray, g: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, g)
        e, t, s, alpha = f["e"], f["t"], f["s"], f["alpha"]
        do = (f["score"] - y) / len(y)
        dz = (do[:, None] * p["c"])[g]
        dalpha = (dz * e).sum(1)
        da = alpha * (dalpha - _segments(alpha * dalpha, g)[g])
        gate = da[:, None] * p["w"]
        dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
        de = alpha[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        return {"W": x.T @ (de * (1 - e * e)), "V": e.T @ dt, "U": e.T @ ds, "w": (t * s).T @ da, "c": f["z"].T @ do, "d": do.sum(keepdims=True)}

    def fit(self, x: np.ndarray, g: np.ndarray, y: np.ndarray, seed: int = 11) -> Attention:
        """Adam over shuffled batches of texts."""
        if not len(y):
            return self
        r, first = np.random.default_rng(seed), np.searchsorted(g, np.arange(len(y) + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step, epochs = 0, max(EPOCHS, 200 * BATCH // len(y))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH):
                docs = order[i : i + BATCH]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                step += 1
                for k, grad in self.gradient(x[rows], np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs]), y[docs]).items():
                    grad = grad + 1e-4 * self.p[k]
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.01 * (grad * grad - v[k])
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, g = passages(data, offs)
        return self.forward(x, g)["score"] if len(g) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS) -> Attention:
    picked = F.broadcast(labelled_sample(labels, id_col, label_col, max_docs))  # at most 2 * max_docs rows
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(picked, "label_id").select("label_id", "text", "label")

    def encoded(batches):
        for batch in batches:
            for i, j, data, offs in tk.blocks(batch.column(1)):
                x, g = passages(data, offs)
                rows = [x[g == k].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary()), batch.column(2).slice(i, j - i)], ["label_id", "x", "label"])

    got = texts.mapInArrow(tidy(encoded), "label_id long, x binary, label int").toPandas().sort_values(["label_id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32)
    return Attention().fit(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), got["label"].to_numpy(np.float32))


def score(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of every row; a null or empty text is one passage of zeros.

    Repeated rows and ids keep a row each, a null id stays null, and other
    columns, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offs in tk.blocks(batch.column(1)):
                out[i:j] = shared.value.score(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(scored), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
