"""Exact duplicates by two passes over a Bloom filter.

Pass one sets bits for every text's hash in two bit arrays, "seen" and "seen
again". Pass two looks each hash up in "seen again": a text whose bits are not
all set there is certainly the only one of its kind and passes straight
through. Only the rest, the possibly repeated, are shuffled and settled exactly
by the sha256 of the text. A filter that is too full only lets more rows
through to the exact part; no result depends on it.

The filter has a fixed bound, ``MAX_BITS``, which also bounds what reaches the
driver and what is broadcast (twice ``MAX_BITS / 8`` bytes, 64 MB).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, table, tidy, width

MAX_BITS = 1 << 28
BITS_PER_ROW = 16
PROBES = 2
SLICE = 1 << 14  # bytes of one piece of a filter
HELD = 1 << 20  # hashes that a task holds before it sets their bits


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each hash, one row each."""
    h = h.astype(np.uint64)
    return np.stack([(h >> np.uint64(32 * i)) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def held_in(array: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set."""
    out = np.ones(len(h), bool)
    for slot in _slots(h.view(np.uint64), bits):
        out &= (array[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return out


def _merge(into: dict, piece: int, once: np.ndarray, again: np.ndarray) -> None:
    if piece in into:
        seen, twice = into[piece]
        twice |= again | (seen & once)
        seen |= once
    else:
        into[piece] = (once.copy(), again.copy())


def _rows(pieces: dict) -> pa.RecordBatch:
    keys = list(pieces)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array([pieces[k][0].tobytes() for k in keys], pa.binary()), pa.array([pieces[k][1].tobytes() for k in keys], pa.binary())],
        ["piece", "once", "again"],
    )


def repeated_filter(hashes: DataFrame, rows: int, max_bits: int = MAX_BITS, again: bool = True) -> tuple[np.ndarray, int]:
    """The "seen again" bits of the only column of ``hashes`` ("seen" ones if not ``again``), and the filter's size in bits."""
    plane = "again" if again else "once"
    bits = 1 << 14
    while bits < max_bits and bits < BITS_PER_ROW * rows:
        bits *= 2

    def first(batches):
        # the bits that this task has set, kept as pieces of the whole array; each piece is touched once a flush
        size = min(SLICE, bits // 8)
        pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[np.ndarray] = []

        def flush():
            for probe in range(PROBES):
                slot, count = np.unique(np.concatenate([h[probe] for h in held]), return_counts=True)
                cut = np.flatnonzero(np.append(True, slot[1:] // (8 * size) != slot[:-1] // (8 * size)))
                for i, j in zip(cut, np.append(cut[1:], len(slot)), strict=True):
                    piece = int(slot[i]) // (8 * size)
                    once, again = np.zeros(8 * size, np.uint8), np.zeros(8 * size, np.uint8)
                    once[slot[i:j] - piece * 8 * size] = 1
                    again[slot[i:j][count[i:j] > 1] - piece * 8 * size] = 1
                    _merge(pieces, piece, np.packbits(once), np.packbits(again))
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            if sum(h.shape[1] for h in held) >= HELD:
                flush()
        if held:
            flush()
        if pieces:
            yield _rows(pieces)

    def merged(batches):
        pieces: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece, once, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _merge(pieces, piece, np.frombuffer(once, np.uint8), np.frombuffer(again, np.uint8))
        if pieces:
            yield _rows(pieces).select(["piece", plane])

    parts = hashes.mapInArrow(tidy(first), "piece int, once binary, again binary").repartition(min(width(hashes.sparkSession), max(1, bits // 8 // SLICE)), "piece")
    out = np.zeros(bits // 8, np.uint8)
    for piece, held in parts.mapInArrow(tidy(merged), f"piece int, {plane} binary").collect():  # at most bits / 8 bytes
        out[piece * len(held) : (piece + 1) * len(held)] = np.frombuffer(bytes(held), np.uint8)
    return out, bits


def _maybe(docs: DataFrame, h, max_bits: int):
    """A function of a hash: whether more than one row of ``docs`` may have it. ``h``: the column that gives a row's hash."""
    again, bits = repeated_filter(docs.select(h.alias("h")), docs.count(), max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(held_in(shared.value, bits, h.to_numpy()))

    return maybe


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty, and a text
    of any length is hashed whole. The row with the largest id of each group
    stays; a tie of rows with that id and text, or with null ids alone, marks
    all of them kept, for they are told apart by nothing (``keep_last`` keeps
    one of them). A null id never wins over another. Other columns, whatever
    their names, are left alone. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    maybe = _maybe(docs, F.xxhash64(text), max_bits)
    lean = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("h"))
    marked = materialize(lean.withColumn("maybe", maybe("h")).select("doc_id", F.unhex("sha").alias("sha"), "maybe"), "dedup-marked")
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    asked = marked.filter("maybe")
    # a group of any size is one row per task before it is shuffled; the join back may be split on skew
    groups = materialize(asked.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    settled = asked.join(groups, "sha").select("doc_id", "keep_id", "group_size", "sha")
    return alone.unionByName(settled).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row for each text, the one with the largest id, with all its columns.

    Null counts as empty, and a null id comes before all others; of rows that
    share id and text one stays, by a hash of the other columns. Rows outside
    the filter pass straight through; the others are one row per text and task
    before they are shuffled. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    maybe = _maybe(docs, F.xxhash64(text), max_bits)
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(*names).alias("all"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("h")).withColumn("maybe", maybe("h"))
    last = rows.filter("maybe").groupBy("sha").agg(F.max_by("row", F.struct("own_id", "all")).alias("row"))
    return rows.filter("not maybe").select("row").unionByName(last.select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
