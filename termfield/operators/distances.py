"""Distances and similarities between the vectors of long tables.

All pairs asked for are in the result.  Where there are few features (at most ``DENSE``, as after
a projection), vectors are packed into blocks, and a task compares block with block; pairs of blocks
are made where they are compared and are never shuffled (:mod:`.swept` reduces them there).  Otherwise
what two vectors share comes from an equi-join on the feature and one aggregation per pair; the
rest of a distance follows from totals of each vector, so zeros are never stored or compared.
Only the maximum, which no totals give, is then taken from pairs of whole vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.association import named
from ..model import missing, values
from ..shared import kept, spent, written

METRICS = ["cosine", "euclidean", "maximum", "manhattan", "minkowski", "canberra", "jaccard", "overlap"]
SIMILARITIES = {"cosine", "jaccard", "overlap"}
#: Up to so many features vectors are compared as arrays, in blocks of about BLOCK.
DENSE, BLOCK = 2048, 256
#: Bytes of blocks that a task holds while others stream by; blocks of the first side a task has at least.
HELD, FEW = 32 << 20, 4


def is_similarity(method: str, convert: bool = True) -> bool:
    return not convert and named(method, METRICS, "method") in SIMILARITIES


def vectors_of(table: DataFrame, terms: list[str] | DataFrame | None, skip_missing: bool, info: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(cells of the chosen targets, their names); an unknown term is an error unless skipped."""
    t = values(table).where(F.col("value") != 0)
    known = (info.select("term") if info is not None else values(table).select(F.col("target").alias("term"))).distinct()
    if terms is None:
        return t, known
    if isinstance(terms, DataFrame):
        asked = terms.select("term").distinct()
    else:
        asked = table.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(terms)], "term string")
    if not skip_missing:
        missing(asked, known, "unknown terms:")
    names = known.join(asked, "term", "left_semi")
    return t.join(names.select(F.col("term").alias("target")), "target", "left_semi"), names


def distances(
    table: DataFrame,
    other: DataFrame | None = None,
    method: str = "cosine",
    p: float = 2.0,
    normalized: bool = False,
    by_row: bool = True,
    convert: bool = True,
    terms: list[str] | DataFrame | None = None,
    terms2: list[str] | DataFrame | str | None = None,
    skip_missing: bool = False,
    compact: bool = False,
    info: DataFrame | None = None,
    info2: DataFrame | None = None,
) -> DataFrame:
    """(a, b, distance) of all targets of ``table`` (or ``terms``) and all of ``other`` (or ``terms2``).

    Without ``other`` and ``terms2`` the first side is compared with itself; ``terms2="all"``
    compares it with every target.

    ``convert`` False leaves cosine, jaccard and overlap as similarities; else cosine is an
    angle in degrees and the others are 1 minus the similarity.  ``normalized`` takes vectors
    as they are for cosine, and gives overlap without dividing.  ``info`` names targets that
    have no cells.  A zero vector has no direction: its cosine is NaN.  ``compact`` keeps one
    of each two pairs.  jaccard and overlap are for values that are not negative.
    """
    sides = sides_of(table, other, method, p, by_row, terms, terms2, skip_missing, compact, info, info2)
    x, names, y, names2, method, same = sides.x, sides.names, sides.y, sides.names2, sides.method, sides.same
    if sides.features is not None:
        left = _blocks(x, names, sides.features)
        return _compared(left, left if y is x else _blocks(y, names2, sides.features), len(sides.features), method, p, normalized, convert, same, compact)
    pairs = names.select(F.col("term").alias("a")).crossJoin(names2.select(F.col("term").alias("b")))
    return measured(pairs.where("a < b") if compact else pairs, x, y, method, p, normalized, convert, same)


@dataclass(frozen=True)
class Sides:
    """Cells and names of the two sides of a comparison, and all features if they are few enough for blocks."""

    x: DataFrame
    names: DataFrame
    y: DataFrame
    names2: DataFrame
    features: list[str] | None
    method: str
    same: bool


def sides_of(
    table: DataFrame,
    other: DataFrame | None,
    method: str,
    p: float,
    by_row: bool = True,
    terms: list[str] | DataFrame | None = None,
    terms2: list[str] | DataFrame | str | None = None,
    skip_missing: bool = False,
    compact: bool = False,
    info: DataFrame | None = None,
    info2: DataFrame | None = None,
) -> Sides:
    """What :func:`distances` compares, checked."""
    method = named(method, METRICS, "method")
    if method == "minkowski":
        if p == float("inf"):
            method = "maximum"
        elif not 0 <= p < float("inf"):
            raise ValueError("p must be a number from 0 on")
    if compact and (other is not None or terms2 is not None or method == "overlap"):
        raise ValueError("only symmetric distances have a compact form")
    if not by_row:
        turn = lambda t: None if t is None else values(t).select(F.col("feature").alias("target"), F.col("target").alias("feature"), "value")
        table, other = turn(table), turn(other)
    # Features, names and blocks each read the table, so what it is made of is computed once.
    table, other = kept(values(table) if "_written" not in table.__dict__ else table, "vectors"), None if other is None else kept(values(other), "vectors")
    x, names = vectors_of(table, terms, skip_missing, info)
    if other is None and terms2 is None:
        y, names2 = x, names
    else:
        y, names2 = vectors_of(table if other is None else other, None if isinstance(terms2, str) else terms2, skip_missing, info if other is None else info2)
    features = [r["feature"] for r in x.select("feature").union(y.select("feature")).distinct().limit(DENSE + 1).collect()]
    return Sides(x, names, y, names2, features if len(features) <= DENSE else None, method, other is None)


def repeated(table: DataFrame, method: str) -> DataFrame:
    """(term, first) of the targets of ``table``: first is the first name among targets with equal vectors; written.

    A vector without cells has no direction, so under cosine it equals none.
    """
    cells = values(table).where("value != 0")
    held = cells.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("v"))
    every = values(table).select("target").distinct().join(held, "target", "left")
    key = F.when(F.col("v").isNull(), F.col("target") if method == "cosine" else F.lit("")).otherwise(F.sha2(F.to_json("v"), 256))
    keys = written(every.select(F.col("target").alias("term"), F.col("v").isNull().alias("none"), key.alias("key")), "keys")
    firsts = keys.groupBy("none", "key").agg(F.min("term").alias("first"))
    out = written(keys.join(firsts, ["none", "key"]).select("term", "first"), "firsts")
    spent(keys)
    return out


def _blocks(cells: DataFrame, names: DataFrame, features: list[str]) -> DataFrame:
    """(block, names, held): a row for each block of about BLOCK targets in order of names, its numbers packed row by row."""
    many = max(1, -(-names.count() // BLOCK))
    at = {f: i for i, f in enumerate(features)}
    shared = cells.sparkSession.sparkContext.broadcast(at)
    held = cells.groupBy("target").agg(F.collect_list(F.struct("feature", "value")).alias("v"))
    every = names.select(F.col("term").alias("target")).join(held, "target", "left").withColumn("block", F.pmod(F.xxhash64("target"), F.lit(many)))

    def pack(key, table):
        import pyarrow as pa

        table = table.sort_by("target")
        place, v = shared.value, table.column("v").combine_chunks()
        out = np.zeros((table.num_rows, len(place)))
        rows = np.repeat(np.arange(table.num_rows), np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
        cells = v.flatten()
        out[rows, [place[f] for f in cells.field("feature").to_pylist()]] = cells.field("value").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "names": pa.array([table.column("target").to_pylist()], pa.list_(pa.string())), "held": pa.array([out.tobytes()], pa.binary())})

    # A block is bounded: targets are dealt by hash.
    return written(every.groupBy("block").applyInArrow(pack, "block long, names array<string>, held binary"), "blocks")


def met(left: DataFrame, right: DataFrame, width: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over all pairs of blocks: rows (i, a, x, k, b, y, more), block by block of the left side.

    A task holds a share of the right side, of HELD bytes at most, and streams its blocks of the left
    side past it, so what is dealt out is blocks and never pairs of them.  Other columns of the left side are
    in the struct ``more``.
    """
    n, m = left.count(), right.count()
    lanes = max(1, -(-m * BLOCK * width * 8 // HELD))
    x = left.repartition(max(1, min(n, max(64 // lanes, -(-n // FEW)))))
    y = right.repartition(max(1, min(m, lanes)))
    more = [c for c in left.columns if c not in ("block", "names", "held")]
    x = x.select(F.col("block").alias("i"), F.col("names").alias("a"), F.col("held").alias("x"), F.struct(*more).alias("more") if more else F.lit(None).cast("string").alias("more"))
    y = y.select(F.col("block").alias("k"), F.col("names").alias("b"), F.col("held").alias("y"))
    return x.crossJoin(y.hint("shuffle_replicate_nl")).select("i", "a", "x", "k", "b", "y", "more").mapInArrow(run, schema)


def opened(batches) -> Iterator[tuple]:
    """(i, a, u, k, b, v, more) of the rows of :func:`met`: names as lists, numbers as matrices; ``more`` is a scalar."""
    last, a, names = None, None, {}
    for t in batches:
        i, k = t.column("i").to_pylist(), t.column("k").to_pylist()
        for r in range(t.num_rows):
            if i[r] != last:
                last, a = i[r], t.column("a")[r].as_py()
            if k[r] not in names:
                names[k[r]] = t.column("b")[r].as_py()
            b = names[k[r]]
            u, v = (np.frombuffer(t.column(c)[r].as_buffer()).reshape(len(s), -1) for c, s in (("x", a), ("y", b)))
            yield last, a, u, k[r], b, v, t.column("more")[r]


def _compared(left: DataFrame, right: DataFrame, width: int, method: str, p: float, normalized: bool, convert: bool, same: bool, compact: bool) -> DataFrame:
    """(a, b, distance) of all targets of two tables of blocks; ``compact`` keeps pairs with a before b."""

    def run(batches):
        import pyarrow as pa

        for k, a, u, l, b, v, _ in opened(batches):
            # Either order of two blocks gives all their pairs in compact form.
            if compact and k > l:
                continue
            far = block_distances(a, u, b, v, method, p, normalized, convert, same)
            n, m, a, b = np.array(a, dtype=object), np.array(b, dtype=object), pa.array(a), pa.array(b)
            if not compact:
                yield pa.RecordBatch.from_arrays([a.take(pa.array(np.repeat(np.arange(len(n)), len(m)))), b.take(pa.array(np.tile(np.arange(len(m)), len(n)))), pa.array(far.ravel())], names=["a", "b", "distance"])
                continue
            # Names are in order, so those after one begin at its place.
            first = np.arange(len(m))[None, :] >= np.searchsorted(m, n, side="right")[:, None]
            for i, j, x, y in ((*np.nonzero(first), a, b), *([] if k == l else [(*np.nonzero(~first), b, a)])):
                yield pa.RecordBatch.from_arrays([x.take(pa.array(i if x is a else j)), y.take(pa.array(j if x is a else i)), pa.array(far[i, j])], names=["a", "b", "distance"])

    # Every block meets every block, since all distances are asked for.
    return met(left, right, width, run, "a string, b string, distance double")


def block_distances(a: list[str], u: np.ndarray, b: list[str], v: np.ndarray, method: str, p: float, normalized: bool, convert: bool, same: bool) -> np.ndarray:
    """Distances of two blocks; with ``same`` a target is at 0 of itself, whatever the rounding."""
    far = _array_distances(u, v, method, p, normalized, convert)
    if same and method not in ("cosine", "jaccard", "overlap"):
        at = {t: j for j, t in enumerate(b)}
        for i, t in enumerate(a):
            if t in at:
                far[i, at[t]] = 0.0
    return far


def _array_distances(x: np.ndarray, y: np.ndarray, method: str, p: float, normalized: bool, convert: bool) -> np.ndarray:
    """Distances of the rows of ``x`` and of ``y``, as :func:`_plan` has them."""
    if method == "cosine":
        dot = x @ y.T
        if not normalized:
            size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                dot = np.where(size > 0, dot / size, np.nan)
        dot = np.where(dot > 1 - 1e-12, 1.0, np.where(dot < -1 + 1e-12, -1.0, dot))
        return np.degrees(np.arccos(dot)) if convert else dot
    power = {"euclidean": 2.0, "manhattan": 1.0}.get(method, float(p))
    kind = np.float64
    if method in ("manhattan", "maximum", "jaccard", "overlap") and (x == np.rint(x)).all() and (y == np.rint(y)).all():
        # Sums of small whole numbers are exact in half the width.
        most = np.abs(x).sum(1).max(initial=0.0) + np.abs(y).sum(1).max(initial=0.0)
        kind = np.float32 if most < 2**24 else kind
    xt, yt, total = np.ascontiguousarray(x.T, dtype=kind), np.ascontiguousarray(y.T, dtype=kind), np.zeros((len(x), len(y)))
    for i in range(0, len(x), 128):
        total[i : i + 128] = _summed(xt[:, i : i + 128], yt, method, p, power)
    if method in ("jaccard", "overlap"):
        low = total
        if method == "jaccard":
            every = x.sum(1)[:, None] + y.sum(1)[None, :] - low
            low = np.where(every == 0, 1.0, low / np.where(every == 0, 1.0, every))
        elif not normalized:
            whole = x.sum(1)[:, None]
            low = np.where(whole == 0, 1.0, low / np.where(whole == 0, 1.0, whole))
        return 1 - low if convert else low
    if method in ("maximum", "canberra") or (method == "minkowski" and p == 0):
        return total
    return np.sqrt(total) if method == "euclidean" else total ** (1 / power) if power > 1 else total


def _summed(xt: np.ndarray, yt: np.ndarray, method: str, p: float, power: float) -> np.ndarray:
    """What a few rows and many have apart (or share), feature by feature, so that what a step touches stays in the cache."""
    shape = (xt.shape[1], yt.shape[1])
    total, gap, size = np.zeros(shape, xt.dtype), np.empty(shape, xt.dtype), np.empty(shape, xt.dtype)
    for u, v in zip(xt[:, :, None], yt[:, None, :], strict=True):
        if method in ("jaccard", "overlap"):
            total += np.minimum(u, v, out=gap)
            continue
        if method == "minkowski" and p == 0:
            total += u != v
            continue
        np.abs(np.subtract(u, v, out=gap), out=gap)
        if method == "maximum":
            np.maximum(total, gap, out=total)
            continue
        if method == "canberra":
            np.add(np.abs(u), np.abs(v), out=size)
            np.divide(gap, size, out=gap, where=size > 0)
        elif power == 2:
            np.multiply(gap, gap, out=gap)
        elif power == 3:
            np.multiply(np.multiply(gap, gap, out=size), gap, out=gap)
        elif power == 0.5:
            np.sqrt(gap, out=gap)
        elif power != 1:
            np.power(gap, power, out=gap)
        total += gap
    return total


def measured(pairs: DataFrame, x: DataFrame, y: DataFrame, method: str, p: float = 2.0, normalized: bool = False, convert: bool = True, same: bool = True, few: bool = False) -> DataFrame:
    """(a, b, distance) of the given distinct pairs between targets of ``x`` and of ``y``.

    ``few``: the pairs are far fewer than all, so they lead the join; else vectors meet on the
    feature.  ``same``: equal names on both sides are the same vector.
    """
    if method == "maximum":
        return _maximum(x, y, pairs)
    left = x.select(F.col("target").alias("a"), "feature", F.col("value").alias("x"))
    right = y.select(F.col("target").alias("b"), "feature", F.col("value").alias("y"))
    both = pairs.join(left, "a").join(right, ["b", "feature"]) if few else left.join(right, "feature")
    shared, totals, value = _plan(method, p, normalized, convert, same)
    out = pairs.join(both.groupBy("a", "b").agg(*shared), ["a", "b"], "left")
    for side, key, cells in (("x", "a", x), ("y", "b", y)):
        total = cells.groupBy(F.col("target").alias(key)).agg(*[c.alias(f"{n}{side}") for n, c in totals.items()])
        out = out.join(total, key, "left")
    return out.fillna(0.0).select("a", "b", value.alias("distance"))


def _plan(method: str, p: float, normalized: bool, convert: bool, same: bool) -> tuple[list[Column], dict[str, Column], Column]:
    """Aggregates over shared features, totals of each vector, and the value made from them."""
    x, y, v = F.col("x"), F.col("y"), F.col("value")
    self_pair = (F.col("a") == F.col("b")) & F.lit(same)
    low = F.sum(F.least(x, y)).alias("low")
    if method == "cosine":
        dot = F.col("dot")
        cos = dot if normalized else dot / (F.col("nx") * F.col("ny"))
        nan = F.lit(float("nan"))
        if not normalized:
            cos = F.when((F.col("nx") == 0) | (F.col("ny") == 0), nan).otherwise(cos)
        # So close to parallel that only rounding tells them apart.
        cos = F.when(F.isnan(cos), cos).when(cos > 1 - 1e-12, 1.0).when(cos < -1 + 1e-12, -1.0).otherwise(cos)
        if convert:
            cos = F.degrees(F.acos(cos))
        return [F.sum(x * y).alias("dot")], {"n": F.sqrt(F.sum(v * v))}, cos
    if method in ("jaccard", "overlap"):
        total = {"s": F.sum(v)}
        got = F.col("low")
        if method == "jaccard":
            every = F.col("sx") + F.col("sy") - got
            got = F.when(every == 0, 1.0).otherwise(got / every)
        elif not normalized:
            got = F.when(F.col("sx") == 0, 1.0).otherwise(got / F.col("sx"))
        return [low], total, 1 - got if convert else got
    many = F.count("*").cast("double").alias("m")
    if method == "canberra":
        # A feature only one of the two has counts 1.
        part = F.abs(x - y) / (F.abs(x) + F.abs(y))
        value = F.col("d") + (F.col("kx") - F.col("m")) + (F.col("ky") - F.col("m"))
        return [F.sum(part).alias("d"), many], {"k": F.count("*").cast("double")}, value
    if method == "minkowski" and p == 0:
        value = F.col("d") + (F.col("kx") - F.col("m")) + (F.col("ky") - F.col("m"))
        return [F.sum((x != y).cast("double")).alias("d"), many], {"k": F.count("*").cast("double")}, value
    power = {"euclidean": 2.0, "manhattan": 1.0}.get(method, float(p))
    raised = (lambda c: c * c) if power == 2 else (lambda c: F.abs(c)) if power == 1 else (lambda c: F.pow(F.abs(c), F.lit(power)))
    shared = [F.sum(raised(x - y)).alias("d"), F.sum(raised(x)).alias("gx"), F.sum(raised(y)).alias("gy"), many]
    # What a vector has beyond the shared features; none if all are shared, whatever the rounding.
    rest = lambda s: F.when(F.col(f"k{s}") == F.col("m"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col(f"t{s}") - F.col(f"g{s}")))
    value = F.col("d") + rest("x") + rest("y")
    if method == "euclidean":
        value = F.sqrt(value)
    elif power > 1:
        value = F.pow(value, F.lit(1.0 / power))
    return shared, {"t": F.sum(raised(v)), "k": F.count("*").cast("double")}, F.when(self_pair, 0.0).otherwise(value)


def _maximum(x: DataFrame, y: DataFrame, pairs: DataFrame) -> DataFrame:
    """The largest difference, from maps of whole vectors."""
    as_map = lambda t, key, name: t.groupBy(F.col("target").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias(name))
    empty = F.create_map().cast("map<string,double>")
    out = pairs.join(as_map(x, "a", "x"), "a", "left").join(as_map(y, "b", "y"), "b", "left")
    gap = F.map_zip_with(F.coalesce("x", empty), F.coalesce("y", empty), lambda _, u, v: F.abs(F.coalesce(u, F.lit(0.0)) - F.coalesce(v, F.lit(0.0))))
    return out.select("a", "b", F.coalesce(F.array_max(F.map_values(gap)), F.lit(0.0)).alias("distance"))
