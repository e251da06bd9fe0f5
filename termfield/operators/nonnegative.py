"""Non-negative reduction: targets and features as non-negative factors, by multiplicative updates on tiles.

The start comes from the singular vectors: of each pair the positive or the negative parts, whichever
weigh more, with a small value for zeros so that updates can move them.  A round updates the features'
factor, then the targets'; products with the matrix move blocks of the factors, never the matrix, and the
driver sees k x k numbers.  The squared error never rises; rounds end when it falls by less than ``tol`` of itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ModelError, TermModel
from ..shared import spent, written
from . import tiles
from .tiles import BLOCK


@dataclass(frozen=True)
class NonNegative:
    """Targets (term, vec), features (feature, vec) and the squared error before each round and at the end."""

    vectors: DataFrame
    basis: DataFrame
    errors: list[float]


def _joint(factor: DataFrame, product: DataFrame, run, schema: str) -> DataFrame:
    """``run(x, y)`` of every block of the factor and of a product, which lacks blocks that are zero."""

    def each(batches):
        import pyarrow as pa

        for b in batches:
            for at, x, y in zip(*(b.column(c).to_pylist() for c in ("block", "held", "other")), strict=True):
                yield from run(pa, at, np.frombuffer(x), np.zeros(len(x) // 8) if y is None else np.frombuffer(y))

    return factor.join(product.withColumnRenamed("held", "other"), "block", "left").select("block", "held", "other").mapInArrow(each, schema)


def _updated(factor: DataFrame, product: DataFrame, square: np.ndarray, k: int) -> DataFrame:
    def run(pa, at, x, y):
        x, y = x.reshape(-1, k), y.reshape(-1, k)
        below = x @ square
        out = x * np.divide(np.maximum(y, 0.0), below, out=np.zeros_like(y), where=below > 0)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["block", "held"])

    return written(_joint(factor, product, run, "block long, held binary"), "factor")


def _inner(factor: DataFrame, product: DataFrame) -> float:
    def run(pa, at, x, y):
        yield pa.RecordBatch.from_arrays([pa.array([float(x @ y)])], names=["v"])

    return _joint(factor, product, run, "v double").agg(F.sum("v")).first()[0] or 0.0


def _parts(factor: DataFrame, k: int) -> np.ndarray:
    """(2, k): squared lengths of the positive and the negative parts."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, k))
        for b in batches:
            for held in b.column("held").to_pylist():
                x = np.frombuffer(held).reshape(-1, k)
                total += [(np.maximum(x, 0) ** 2).sum(0), (np.minimum(x, 0) ** 2).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k), pa.int32()), pa.array(total.ravel())], names=["cell", "v"])

    out = np.zeros(2 * k)
    for r in factor.select("held").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(2, k)


def _cut(factor: DataFrame, k: int, sign: np.ndarray, scale: np.ndarray, least: float) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            held = [(np.maximum(np.maximum(np.frombuffer(h).reshape(-1, k) * sign, 0) * scale, least)).tobytes() for h in b.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(held, pa.binary())], names=["block", "held"])

    return written(factor.mapInArrow(run, "block long, held binary"), "factor")


def _packed(vectors: DataFrame, numbers: DataFrame, key: str, k: int, block: int) -> DataFrame:
    """(block, held) of a table (``key``, vec) over all numbered names."""
    at = numbers.join(vectors.withColumnRenamed(key, "term"), "term").select(F.floor(F.col("k") / block).alias("block"), F.struct("k", "vec").alias("x"))
    # A block has ``block`` rows.
    held = at.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [np.array([v for r in x for v in r["vec"]], float).tobytes() for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], names=["block", "held"])

    return written(held.mapInArrow(run, "block long, held binary"), "packed")


def reduce(model: TermModel, k: int, rounds: int = 50, tol: float = 1e-4, seed: int = 42, block: int = BLOCK) -> NonNegative:
    """``k`` non-negative dimensions of a model's scores (or counts), none of which may be negative."""
    table = model.primary
    low, square, n = table.agg(F.min("value"), F.sum(F.col("value") * F.col("value")), F.count("*")).first()
    if low is not None and low < 0:
        raise ModelError("a non-negative reduction needs values that are not negative")
    if not square:
        raise ModelError("the matrix has no values")
    start = tiles.svd(table, model.rows, model.cols, k, 2.0, 4, 0.0, seed, block=block)
    k = len(start.sigma)
    t = tiles.tiled(table, model.rows, model.cols, block)
    w, h = _packed(start.vectors, t.rows, "term", k, block), _packed(start.basis, t.cols, "feature", k, block)
    lengths = np.sqrt(_parts(w, k)) / np.maximum(start.sigma, 1e-300), np.sqrt(_parts(h, k))
    side = (lengths[0] * lengths[1]).argmax(0)
    sign = np.where(side == 0, 1.0, -1.0)
    u, v = (x[side, np.arange(k)] for x in lengths)
    # Both get the root of the pair's weight; w holds sigma already.
    weight = np.sqrt(start.sigma * u * v)
    least = float(np.sqrt(square)) / np.sqrt(max(1, t.height) * max(1, t.width)) / 100
    w0 = _cut(w, k, sign, weight / np.maximum(start.sigma * u, 1e-300), least)
    h0 = _cut(h, k, sign, weight / np.maximum(v, 1e-300), least)
    spent(w, h, start.vectors, start.basis)
    w, h = w0, h0
    errors: list[float] = []
    for at in range(rounds + 1):
        gram = tiles.gram(w, k), tiles.gram(h, k)
        vh = written(tiles.times(t, h, k, False, block), "product")
        errors.append(max(0.0, float(square - 2 * _inner(w, vh) + (gram[0] * gram[1]).sum())))
        if at == rounds or (at and errors[-2] - errors[-1] <= tol * errors[-2]):
            spent(vh)
            break
        w1 = _updated(w, vh, gram[1], k)
        back = written(tiles.times(t, w1, k, True, block), "product")
        h1 = _updated(h, back, tiles.gram(w1, k), k)
        spent(w, h, vh, back)
        w, h = w1, h1
    vectors, basis = written(tiles.unpacked(w, t.rows, k, "term", block), "vectors"), written(tiles.unpacked(h, t.cols, k, "feature", block), "basis")
    spent(w, h, t.by_col, t.by_row)
    return NonNegative(vectors, basis, errors)
