"""Whitening of embeddings by a tiled covariance.

The distinct vectors are cut into row blocks, and each row block into column
blocks of ``WIDTH`` dimensions. A pair of column blocks is a tile; the two
column blocks of a tile and a row block meet in one task, which multiplies
them, and products are added up per tile, so that no task holds a whole row
block of very wide vectors, nor more than one tile. Only the assembled
covariance (as many cells as pairs of dimensions) reaches the driver, where it
is decomposed.

Entries are whole numbers and centred at a whole number before they are
multiplied, so sums are exact up to 2^53 and the same however rows are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, table, tidy

SCALE, SHIFT = 64, 1_000_000
TOP = 16
WIDTH = 32  # dimensions of a column block
BLOCK_BYTES = 1 << 21  # of a row block, as doubles of one column block
LIMIT = float(1 << 45)  # entries of this size have no exact whole number here
KINDS = (np.int16, np.int32, np.int64)


@dataclass
class Model:
    """n distinct vectors; sums minus n times centre are rest; columns of axes are eigenvectors over root eigenvalues (nan: no variance)."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    error: float = 0.0


def matrix(column: pa.Array, kind) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def whole(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x, the whole numbers, of the rows whose vector has only finite entries."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return df.filter(v.isNotNull() & ~bad & (F.size(v) > 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _sums(batches):
    total = None
    for batch in batches:
        if batch.num_rows:
            part = matrix(batch.column(0), np.int64)
            part = part.astype(object).sum(0) if np.abs(part).max() > (1 << 62) // len(part) else part.sum(0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total], pa.string())], ["i", "total"])


def _cut(centre: np.ndarray, width: int, rows: int):
    """Fragments of row blocks, one for each tile that the column block is part of."""
    blocks = -(-len(centre) // width)

    @tidy
    def run(batches):
        task, held, number = TaskContext.get().partitionId(), [], 0

        def out(y):
            nonlocal number
            key, number = (task << 32) + number, number + 1
            for c in range(blocks):
                part = np.ascontiguousarray(y[:, c * width : (c + 1) * width])
                kind = next(i for i, k in enumerate(KINDS) if i == 2 or np.abs(part).max(initial=0) <= np.iinfo(k).max)
                data = part.astype(KINDS[kind]).tobytes()
                tiles = [(min(c, o), max(c, o)) for o in range(blocks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t[0] for t in tiles], pa.int32()), pa.array([t[1] for t in tiles], pa.int32()), pa.array([key] * blocks, pa.int64()), pa.array([c] * blocks, pa.int32()), pa.array([kind] * blocks, pa.int32()), pa.array([data] * blocks, pa.binary())],
                    ["tile_i", "tile_j", "row_block", "part", "kind", "data"],
                )

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch.column(0), np.int64) - centre)
                n += batch.num_rows
            while n >= rows:
                y = np.concatenate(held)
                yield from out(y[:rows])
                held, n = [y[rows:]], n - rows
        if n:
            yield from out(np.concatenate(held))

    return run


def _multiply(dims: int, width: int):
    """Cells of the tiles that a task's sorted fragments add up to."""
    wide = lambda c: min(width, dims - c * width)

    @tidy
    def run(batches):
        tile, key, left, total = None, None, None, None

        def cells():
            i, j = np.indices(total.shape)
            i, j = (i + tile[0] * width).ravel(), (j + tile[1] * width).ravel()
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "j", "v"])

        for batch in batches:
            for a, b, block, part, kind, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if tile != (a, b):
                    if tile:
                        yield cells()
                    tile, total = (a, b), np.zeros((wide(a), wide(b)))
                y = np.frombuffer(data, KINDS[kind]).reshape(-1, wide(part)).astype(float)
                if a == b:
                    total += y.T @ y
                elif part == a:
                    key, left = block, y
                else:
                    assert key == block
                    total += left.T @ y
        if tile:
            yield cells()

    return run


def _project(model: Model, ids: pa.DataType, constant: dict | None):
    """Whitened rows; with ``constant``, as rows of the result, else the sums of them and of their products."""
    k = model.axes.shape[1]
    limit = (1 << 62) // max(1, model.n)

    @tidy
    def run(batches):
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch.column(batch.num_columns - 1), np.int64) - model.centre
            z = (y - model.rest.astype(float) / model.n) @ model.axes
            if constant is None:
                z = np.nan_to_num(z)
                total += z.sum(0)
                squares += z.T @ z
                continue
            apart = y * model.n - model.rest.astype(np.int64) if np.abs(y).max() < limit else y.astype(object) * model.n - model.rest
            if apart.dtype == object or int(np.abs(apart).max()) ** 2 * y.shape[1] >= 1 << 63:
                deviation = [d if (d := int((row * row).sum())) < 1 << 63 else None for row in apart.astype(object)]
            else:
                deviation = (apart * apart).sum(1)
            deviation = pa.array(deviation, pa.int64())
            each, rows = np.repeat(np.arange(len(y)), k), len(y)
            white = pa.array(z.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)).cast(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n, np.int64)), deviation.take(pa.array(each)), white, pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, model.error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        if constant is None:
            i, j = np.indices((k, k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i.ravel(), np.arange(k)]), pa.int32()), pa.array(np.concatenate([j.ravel(), np.full(k, -1)]), pa.int32()), pa.array(np.concatenate([squares.ravel(), total]), pa.float64())],
                ["i", "j", "v"],
            )

    return run


def covariance(fit: DataFrame, n: int, centre: np.ndarray, rest: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The covariance, divisor n, of ``fit`` (x), whose sums are n * centre + rest."""
    dims = len(centre)
    rows = max(1, BLOCK_BYTES // (8 * width))
    cut = fit.select("x").mapInArrow(_cut(centre, width, rows), "tile_i int, tile_j int, row_block long, part int, kind int, data binary")
    dealt = cut.repartition("tile_i", "tile_j", "row_block").sortWithinPartitions("tile_i", "tile_j", "row_block", "part")
    cells = dealt.mapInArrow(_multiply(dims, width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((dims, dims))
    out[cells["i"], cells["j"]] = cells["v"]
    out = np.triu(out) + np.triu(out, 1).T
    mean = rest.astype(float) / n
    return out / n - np.outer(mean, mean)


def fit_model(fit: DataFrame, top: int = TOP, width: int = WIDTH) -> Model | None:
    """The model of ``fit``, a written table of distinct vectors (x, dims); None without rows."""
    lengths = fit.groupBy("dims").count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if not lengths:
        return None
    dims, n = lengths["dims"], lengths["count"]
    fit = fit.filter(F.col("dims") == dims)
    sums = fit.select("x").mapInArrow(_sums, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    sums = np.array([int(r["total"]) for r in sums], object)
    centre = np.array([int(s) // n for s in sums], np.int64)
    rest = sums - centre.astype(object) * n
    cov = covariance(fit, n, centre, rest, width)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:top]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(len(order))])
    trace = float(np.trace(cov))
    some = values > max(trace, 0.0) * 1e-13
    axes = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), np.nan)
    model = Model(n, centre, rest, axes, np.where(some, values, 0.0) / trace if trace > 0 else np.zeros(len(order)))
    seen = fit.select("x").mapInArrow(_project(model, pa.int64(), None), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    squares, total = np.zeros((len(order),) * 2), np.zeros(len(order))
    for i, j, v in seen.itertuples(index=False):
        if j < 0:
            total[i] = v
        else:
            squares[i, j] = v
    found = squares / n - np.outer(total / n, total / n) - np.eye(len(order))
    model.error = float(np.abs(found[np.ix_(some, some)]).max(initial=0.0))
    return model


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: ``top`` rows (or one a dimension, if fewer) for each vector.

    Rows whose vector is null, empty, or holds null, non-finite or huge (2^45
    and more) entries give none, and so do vectors of another length than most
    distinct ones have (of equals, the longer). Null and repeated ids keep a
    result for each row; repeated vectors count once in the model. Directions
    without variance, as with one distinct vector, have null whitened and 0
    explained; deviation is null where a long can't hold it. An empty table
    gives none, and other columns of ``df`` don't matter, whatever their names.
    """
    rows = whole(df, id_col, vec_col)
    kind = df.schema[id_col].dataType.simpleString()
    fit = materialize(rows.select("x").distinct().withColumn("dims", F.size("x")), "whiten-fit")
    model = fit_model(fit, top)
    if model is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, {RESULT}")
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if ids is None:
        rows, kind, ids = rows.withColumn("vec_id", F.col("vec_id").cast("string")), "string", pa.string()
    return rows.filter(F.size("x") == len(model.centre)).mapInArrow(_project(model, ids, {}), f"vec_id {kind}, {RESULT}")


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
