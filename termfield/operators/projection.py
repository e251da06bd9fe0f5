"""Dimensionality reduction: truncated and randomised SVD, random indexing, fold-in.

Rows of the matrix stay where they are.  SVD needs the right singular vectors only, found by
subspace iteration: each round multiplies a bounded basis (features x dimensions, checked
against ``limit``) by the matrix and its transpose inside the tasks and sums the products by
blocks of features.  A larger basis stays in tables of blocks (:mod:`.tiles`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.association import named
from ..model import ModelError, TermModel, in_order, values
from ..shared import written
from . import tiles

BLOCK = 4096
#: Up to so many features the cross product of features is made whole.
EXACT = 1024


@dataclass(frozen=True)
class Projection:
    """Reduced vectors (term, vec), singular values, explained share, and the basis if asked for."""

    vectors: DataFrame
    method: str
    sigma: np.ndarray | None = None
    r2: np.ndarray | None = None
    basis: DataFrame | None = None

    def long(self) -> DataFrame:
        """(target, feature, value) with features svd1, svd2, ..."""
        at = self.vectors.select(F.col("term").alias("target"), F.posexplode("vec").alias("k", "value"))
        return at.select("target", F.concat(F.lit(self.method), (F.col("k") + 1).cast("string")).alias("feature"), "value")


@dataclass(frozen=True)
class _Packed:
    rows: DataFrame  # term, at (feature numbers), v
    features: list[str]


def _packed(table: DataFrame, cols: DataFrame, rows: DataFrame | None, most: int) -> _Packed:
    """One row a target: numbers of its features and its values; at most ``most`` features are numbered."""
    names = [r["term"] for r in in_order(cols).select("term").limit(most + 1).collect()]
    if len(names) > most:
        raise ModelError(f"a basis of more than {most} features exceeds the limit; use random indexing first")
    numbers = table.sparkSession.createDataFrame(list(enumerate(names)), "at int, feature string") if names else None
    if numbers is None:
        raise ModelError("the matrix has no features")
    t = values(table).where("value != 0").join(numbers, "feature")
    held = t.groupBy(F.col("target").alias("term")).agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("v"))
    if rows is not None:
        held = rows.select("term").join(held, "term", "left")
    return _Packed(written(held, "packed"), names)


def _times(rows: DataFrame, basis: np.ndarray, width: int, transpose: bool):
    """M·B as (term, vec), or Mᵀ(M·B) as an array of features x dimensions."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def product(b):
        at, v = b.column("at"), b.column("v")
        sizes = np.diff(at.offsets.to_numpy())
        own = np.repeat(np.arange(len(sizes)), sizes)
        i, x = at.flatten().to_numpy(), v.flatten().to_numpy()
        y = np.zeros((len(sizes), shared.value.shape[1]))
        np.add.at(y, own, x[:, None] * shared.value[i])
        return own, i, x, y

    def forward(batches):
        import pyarrow as pa

        for b in batches:
            y = product(b)[3]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("term"), vec], names=["term", "vec"])

    def back(batches):
        import pyarrow as pa

        total = np.zeros((width, shared.value.shape[1]))
        for b in batches:
            own, i, x, y = product(b)
            np.add.at(total, i, x[:, None] * y[own])
        starts = list(range(0, width, BLOCK))
        for a in starts:
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([total[a : a + BLOCK].tobytes()], pa.binary()), pa.array([TaskContext.get().partitionId()], pa.int32())], names=["block", "held", "share"])

    # Lists are never null for the tasks: an empty row is a zero vector.
    fit = rows.select("term", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("v", F.array().cast("array<double>")).alias("v"))
    if not transpose:
        return fit.mapInArrow(forward, "term string, vec array<double>")
    # Sums of the tasks are added as they stream by.
    parts = tiles.added(fit.mapInArrow(back, "block long, held binary, share int"))
    found = {r["block"]: np.frombuffer(r["held"], float) for r in parts.collect()}
    return np.concatenate([found[a] for a in sorted(found)]).reshape(width, -1) if found else np.zeros((width, basis.shape[1]))


def _basis(packed: _Packed, n: int, oversampling: float, rounds: int, tol: float, seed: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) by subspace iteration."""
    width = len(packed.features)
    k = int(min(max(n + 10, n * oversampling), width)) if tol else int(min(n * oversampling, width))
    if tol and width <= EXACT:
        # Few features: one pass gives their whole cross product.
        power, turn = np.linalg.eigh(_times(packed.rows, np.eye(width), width, True))
        return turn[:, ::-1][:, :n], np.sqrt(np.maximum(power[::-1], 0))[:n]
    if width * k > limit:
        raise ModelError(f"a basis of {width} features and {k} dimensions exceeds the limit of {limit} numbers; use random indexing first")
    v, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, k)))
    before = None
    for _ in range(rounds):
        w = _times(packed.rows, v, width, True)
        small = v.T @ w
        power, turn = np.linalg.eigh((small + small.T) / 2)
        sigma = np.sqrt(np.maximum(power[::-1], 0))[:n]
        if before is not None and np.all(np.abs(sigma - before) <= tol * max(sigma[0], 1e-300)):
            return (v @ turn[:, ::-1])[:, :n], sigma
        before = sigma
        v, _ = np.linalg.qr(w)
    w = _times(packed.rows, v, width, True)
    power, turn = np.linalg.eigh((v.T @ w + w.T @ v) / 2)
    return (v @ turn[:, ::-1])[:, :n], np.sqrt(np.maximum(power[::-1], 0))[:n]


def project(
    model: TermModel,
    n: int | None = None,
    method: str = "svd",
    oversampling: float | None = None,
    q: int = 2,
    rate: float = 0.01,
    power: float = 1.0,
    with_basis: bool = False,
    seed: int = 42,
    limit: int = 16_000_000,
) -> Projection:
    """Reduce a model's scores (or counts) to ``n`` dimensions.

    svd iterates until the singular values stand still, rsvd for ``q`` rounds, asvd takes the
    basis from a sample of rows; components whose singular value is lost in rounding are
    dropped.  ri is random indexing, ri+svd puts an SVD on it.  ``power`` weights dimensions by
    sigma^power; 0 equalises them.  A basis of more than ``limit`` numbers is neither sent to the tasks
    nor held by the driver, but kept in tables of blocks.
    """
    method = named(method, ["svd", "rsvd", "asvd", "ri", "ri+svd"], "method") if method not in ("ri", "svd") else method
    if model.scores is not None:
        model = model.replaced(cells=None)
    model = model.settled()
    rows, width = model.rows.count(), model.cols.count()
    n = min(rows, width) if n is None else n
    if method == "ri" and 2 * n > width:
        raise ValueError(f"random indexing from {width} to {n} dimensions makes no sense")
    if n < 1 or (method != "ri" and n > min(rows, width)):
        raise ValueError("the number of dimensions exceeds that of the matrix")
    if with_basis and method.startswith("ri"):
        raise ValueError("random indexing has no basis")
    if not 0 <= rate <= 1:
        raise ValueError("rate must be from 0 to 1")
    table = model.primary
    if method.startswith("ri"):
        if method == "ri":
            return Projection(random_indexing(table, n, rate, seed, width, model.rows), "ri")
        between = int(max(2 * n, min(n * (oversampling or 20), width // 2)))
        middle = random_indexing(table, between, rate, seed, width, model.rows)
        at = middle.select(F.col("term").alias("target"), F.posexplode("vec").alias("k", "value"))
        long = at.select("target", F.col("k").cast("string").alias("feature"), "value")
        names = table.sparkSession.range(between).select(F.col("id").cast("string").alias("term"))
        got = project(TermModel(model.rows, names, None, long.withColumnRenamed("value", "score")), n, "svd", power=power, seed=seed, limit=limit)
        return Projection(got.vectors, "ri+svd", None, None)
    if width * n * (oversampling or 2) > limit and width > EXACT:
        return _tiled(table, model, n, method, oversampling, q, power, with_basis, seed)
    packed = _packed(table, model.cols, model.rows, limit // n)
    fitted = packed
    if method == "asvd":
        want = min(rows, int(n * (oversampling or 10)))
        few = packed.rows.orderBy(F.xxhash64("term", F.lit(seed))).limit(want)
        fitted = _Packed(few, packed.features)
    over = oversampling or 2
    v, sigma = _basis(fitted, n, over, q + 1 if method == "rsvd" else 100, 0.0 if method == "rsvd" else 1e-10, seed, limit)
    kept = sigma > 1e-7 * max(sigma[0], 1e-300)
    v, sigma = v[:, kept], sigma[kept]
    total = table.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    weighted = v if power == 1 else v * sigma[None, :] ** (power - 1)
    vectors = _times(packed.rows, weighted, len(packed.features), False)
    basis = None
    if with_basis:
        basis = table.sparkSession.createDataFrame([(f, x.tolist()) for f, x in zip(packed.features, v, strict=True)], "feature string, vec array<double>")
    r2 = sigma**2 / total if total else np.zeros(len(sigma))
    return Projection(vectors, method, sigma, r2, basis)


def _tiled(table: DataFrame, model: TermModel, n: int, method: str, oversampling: float | None, q: int, power: float, with_basis: bool, seed: int) -> Projection:
    """SVD whose basis stays in tables of blocks (:mod:`.tiles`)."""
    fitted, rows = table, model.rows
    if method == "asvd":
        # As many rows as asked for are the sample that gives the basis.
        rows = model.rows.orderBy(F.xxhash64("term", F.lit(seed))).limit(int(n * (oversampling or 10)))
        fitted = table.join(rows.select(F.col("term").alias("target")), "target", "left_semi")
    few = method == "rsvd"
    got = tiles.svd(fitted, rows, model.cols, n, (oversampling if method != "asvd" else None) or 2.0, q + 1 if few else 100, 0.0 if few else 1e-10, seed, power)
    vectors = got.vectors
    if method == "asvd":
        m = len(got.sigma)
        scaled = got.basis.select("feature", F.zip_with("vec", F.array(*[F.lit(float(s ** (power - 1))) for s in got.sigma]), lambda a, b: a * b).alias("vec"))
        found = fold_in(table, scaled)
        vectors = model.rows.select("term").join(found, "term", "left").select("term", F.coalesce("vec", F.array_repeat(F.lit(0.0), m)).alias("vec"))
    total = table.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    r2 = got.sigma**2 / total if total else np.zeros(len(got.sigma))
    return Projection(vectors, method, got.sigma, r2, got.basis if with_basis else None)


def random_indexing(table: DataFrame, n: int, rate: float, seed: int, width: int, rows: DataFrame | None = None) -> DataFrame:
    """(term, vec): sums of sparse random vectors of the features.

    A feature falls on max(1, n·rate) dimensions with random signs, both by keyed hash, so the
    basis needs no table and no broadcast; dimensions are scaled to unit length.
    """
    fill = max(1, round(n * rate))
    unit = float(np.sqrt(n / (width * fill)))
    t = values(table).where("value != 0")
    draws = F.sequence(F.lit(0), F.lit(fill - 1))
    parts = t.select("target", "feature", "value", F.explode(draws).alias("d"))
    # Each draw has a strip of dimensions of its own, so one feature never falls on one twice.
    strip = n / fill
    low, high = F.floor(F.col("d") * strip), F.floor((F.col("d") + 1) * strip)
    # Twelve hexadecimal digits place the draw, the next one has its sign; engines agree on this hash.
    drawn = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("d").cast("string"), F.col("feature")))
    k = low + F.pmod(F.conv(F.substring(drawn, 1, 12), 16, 10).cast("long"), high - low)
    sign = F.when(F.substring(drawn, 13, 1) < "8", 1.0).otherwise(-1.0)
    sums = parts.groupBy(F.col("target").alias("term"), k.cast("int").alias("k")).agg(F.sum(sign * F.col("value") * unit).alias("v"))
    maps = sums.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    if rows is not None:
        maps = rows.select("term").join(maps, "term", "left")
    every = F.sequence(F.lit(0), F.lit(n - 1))
    return maps.select("term", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def fold_in(table: DataFrame, basis: DataFrame) -> DataFrame:
    """(term, vec): new vectors in the latent space of a basis (feature, vec)."""
    t = values(table).join(basis, "feature").select(F.col("target").alias("term"), "value", F.posexplode("vec").alias("k", "b"))
    sums = t.groupBy("term", "k").agg(F.sum(F.col("value") * F.col("b")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "v")))
    return sums.groupBy("term").agg(F.transform(ordered, lambda s: s["v"]).alias("vec"))
