"""Embedding whitening from upper-triangle column aggregates.

One aggregation counts vectors and sums every dimension; a second, of Spark SQL expressions
generated for every pair of dimensions (i <= j), sums products of centred values.  The driver
puts the covariance together and decomposes it with LAPACK; vectors are then projected in tasks.
Of more than ``BLOCK`` dimensions each pair of blocks of dimensions is a group of the same
aggregation, so that the number of expressions stays at BLOCK².

Values are integers, x = floor(64 c) + 1000000 of an entry c, so counts, sums and squared
deviations are exact: sums are decimals, and a value is centred as (x - S div n) - (S mod n) / n.

Defined cases: a vector that is null, empty, or holds null, non-finite or too large entries (2^31
and more in size) is dropped.  Vectors of each length are fitted and whitened on their own.
Components without variance (eigenvalue at most 1e-12 of the largest) can't be scaled and are
left out, so one vector alone, or only equal ones, give no rows.  Equal eigenvalues have any
orthonormal basis.  A deviation beyond a long is null.  Repeated rows and ids count each; null ids
stay null.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

BLOCK = 64
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**31


@dataclass(frozen=True)
class Whitening:
    """Of vectors of one length: count, exact sums of x, unit components (columns) by falling eigenvalue, and all variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, dim, x): vectors that can be fitted, as arrays of integers."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(fine).select(F.col(key).alias("id"), F.size(column).alias("dim"), x.alias("x"))


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors of ``dim`` entries there are, and the exact sums of their entries."""
    got = rows.where(F.col("dim") == dim).agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")) for i in range(dim)]).first()
    return got[0], [int(s) for s in got[1:]]


def centred_products(rows: DataFrame, values: list[str], block: int = BLOCK) -> np.ndarray:
    """Sums of products of all pairs of ``values`` (SQL expressions) in one aggregation; the upper triangle is summed, the lower one mirrored."""
    d = len(values)
    out = np.zeros((d, d))
    if d <= block:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        held = rows.selectExpr(*[f"{v} AS c{i}" for i, v in enumerate(values)])
        got = held.selectExpr(*[f"sum(c{i} * c{j})" for i, j in pairs]).first()
        for (i, j), v in zip(pairs, got, strict=True):
            out[i, j] = out[j, i] = v or 0.0
        return out
    starts = range(0, d, block)
    held = rows.selectExpr(f"array({', '.join(values)}) AS c")
    met = ", ".join(f"struct({i} AS i, {j} AS j, slice(c, {i + 1}, {block}) AS u, slice(c, {j + 1}, {block}) AS v)" for i in starts for j in starts if i <= j)
    # A short last block gives null products, which count nothing.
    blocks = held.selectExpr(f"inline(array({met}))").groupBy("i", "j").agg(*[F.expr(f"sum(get(u, {a}) * get(v, {b}))") for a in range(block) for b in range(block)])
    for r in blocks.collect():  # one row for each pair of blocks of dimensions
        part = np.array([v or 0.0 for v in r[2:]]).reshape(block, block)[: d - r["i"], : d - r["j"]]
        out[r["i"] : r["i"] + block, r["j"] : r["j"] + block] = part
        out[r["j"] : r["j"] + block, r["i"] : r["i"] + block] = part.T
    return out


def fit(rows: DataFrame, dim: int, most: int, block: int = BLOCK) -> Whitening:
    """Of :func:`usable` vectors of ``dim`` entries; at most ``most`` components."""
    n, total = sums(rows, dim)
    # The whole mean leaves exactly, what is left of it as a double.
    centred = [f"CAST(x[{i}] - {s // n}L AS DOUBLE) - {(s % n) / n!r}D" for i, s in enumerate(total)]
    v = centred_products(rows.where(F.col("dim") == dim), centred, block) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept = int((e > 1e-12 * max(e[0], 0.0)).sum()) if e[0] > 0 else 0
    kept = min(most, kept)
    return Whitening(n, total, u[:, :kept], e[:kept], float(np.trace(v)))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): the exact squared distance from n times the mean, and the scaled projections."""
    d, n = len(model.sums), model.n
    whole = np.array([s // n for s in model.sums], dtype=np.int64)
    rest = np.array([s % n for s in model.sums], dtype=np.int64)
    to = model.components / np.sqrt(model.eigenvalues)

    def deviations(y: np.ndarray) -> list[int | None]:
        about = ((n * y.astype(float) - rest) ** 2).sum(1)
        if about.max(initial=0.0) < 2.0**62:
            return ((n * y - rest) ** 2).sum(1).tolist()
        exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in y]
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for b in slices(batches, 4096):
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            y = x - whole
            w = (y.astype(float) - rest / n) @ to
            kept = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviations(y), pa.int64()), kept], names=["id", "deviation", "whitened"])

    return rows.where(F.col("dim") == d).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, many: int) -> float:
    """The largest entry, in size, of the covariance of whitened vectors less the identity."""
    means = whitened.agg(*[F.sum(F.col("whitened")[k]) for k in range(many)]).first()
    v = centred_products(whitened, [f"whitened[{k}] - {m / n!r}D" for k, m in enumerate(means)]) / n
    return float(np.abs(v - np.eye(many)).max())


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component up to ``most``."""
    rows = written(usable(vectors, key, column), "whole_vectors")
    parts = []
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        model = fit(rows, dim, most)
        many = len(model.eigenvalues)
        if not many:
            continue
        held = written(whiten(rows, model), "whitened")
        error = identity_error(held, model.n, many)
        share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
        each = held.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
        parts.append(each.select(F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))
    if not parts:
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
