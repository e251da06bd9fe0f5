"""Two-dimensional maps of distance tables by stress majorisation.

A round is one aggregation over the pairs, which are stored by their first term: every term moves to
where the pull and push of all others put it, and stress never rises.  The map starts from
classical scaling of landmarks, a keyed sample of bounded size on the driver; every other term
is placed by its distances to them.

metric keeps distances (weight 1 a pair), sammon weighs a pair by 1 / distance, so near pairs
count more, and ordinal keeps their order: before a round, distances are replaced by a monotone
function of them that fits the map best, constant on ``STEPS`` ranges of values and made from counts and sums
of these ranges by pooling neighbours that fall.

Stress is the root of summed weighted squared errors over summed weighted squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.association import named
from ..model import ModelError, values
from ..shared import bucketed, kept, spent, written
from .distances import distances, repeated

METHODS = ["metric", "ordinal", "sammon"]
STEPS = 4096


@dataclass(frozen=True)
class Map:
    """Coordinates (term, x, y) and the stress before each round and at the end."""

    points: DataFrame
    stress: list[float]


def classical(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, triangulation) of a small distance matrix: the second places a point by its squared distances less their means."""
    n = len(d)
    if n < 2:
        return np.zeros((n, 2)), np.zeros((2, n))
    centre = np.eye(n) - 1 / n
    power, turn = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    power, turn = np.maximum(power[::-1][:2], 0), turn[:, ::-1][:, :2]
    if n < 3:
        power, turn = np.append(power, 0.0)[:2], np.pad(turn, ((0, 0), (0, 2 - turn.shape[1])))
    size = np.sqrt(power)
    # The sign of a component is that of its largest entry.
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(2)] < 0, -1.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        place = np.where(size[:, None] > 1e-12 * max(1e-300, size[0]), turn.T / size[:, None], 0.0)
    return turn * size, place


def placed(pairs: DataFrame, firsts: DataFrame, landmarks: int, seed: int) -> DataFrame:
    """:func:`started` for terms that stand for others too: landmarks are taken from all terms of ``firsts`` (term, first)."""
    chosen = [(r["term"], r["first"]) for r in firsts.orderBy(F.xxhash64("term", F.lit(seed)), "term").limit(landmarks).collect()]
    spark, chosen = firsts.sparkSession, sorted(chosen)
    reps = sorted({f for _, f in chosen})
    at = {t: i for i, t in enumerate(reps)}
    marks = spark.createDataFrame(list(at.items()), "b string, k int")
    small = np.zeros((len(at), len(at)))
    # At most landmarks² numbers.
    for r in pairs.join(F.broadcast(marks), "b").join(F.broadcast(marks.toDF("a", "i")), "a").select("i", "k", "d").collect():
        small[r["i"], r["k"]] = r["d"]
    own = np.array([at[f] for _, f in chosen])
    d = small[np.ix_(own, own)]
    _, place = classical(d)
    mean = (d * d).mean(1)
    # Equal landmarks pull together; the mean is theirs all.
    sums = np.zeros((len(at), 4))
    np.add.at(sums, own, np.stack([-0.5 * place[0], -0.5 * place[1], -0.5 * place[0] * mean, -0.5 * place[1] * mean], 1))
    weights = spark.createDataFrame([(t, *map(float, sums[i])) for t, i in at.items()], "b string, wx double, wy double, mx double, my double")
    off = F.col("d") * F.col("d")
    every = pairs.select("a", "b", "d").union(marks.select("b", F.col("b").alias("a"), F.lit(0.0)))
    return every.join(F.broadcast(weights), "b").groupBy(F.col("a").alias("term")).agg(F.sum(F.col("wx") * off - F.col("mx")).alias("x"), F.sum(F.col("wy") * off - F.col("my")).alias("y"))


def started(pairs: DataFrame, terms: DataFrame, landmarks: int, seed: int) -> DataFrame:
    """(term, x, y): landmarks by classical scaling, the others by their distances to these."""
    chosen = [r["term"] for r in terms.orderBy(F.xxhash64("term", F.lit(seed)), "term").limit(landmarks).collect()]
    spark = terms.sparkSession
    at = {t: i for i, t in enumerate(sorted(chosen))}
    marks = spark.createDataFrame([(t, i) for t, i in at.items()], "b string, k int")
    near = pairs.join(F.broadcast(marks), "b")
    d = np.zeros((len(at), len(at)))
    # At most landmarks² numbers.
    for r in near.join(F.broadcast(marks.toDF("a", "i")), "a").select("i", "k", "d").collect():
        d[r["i"], r["k"]] = r["d"]
    xy, place = classical(d)
    mean = (d * d).mean(1) if len(d) else np.zeros(0)
    weights = spark.createDataFrame([(t, *(float(-0.5 * place[c, i]) for c in (0, 1)), float(mean[i])) for t, i in at.items()], "b string, wx double, wy double, mean double")
    off = F.col("d") * F.col("d") - F.col("mean")
    others = pairs.join(F.broadcast(weights), "b").join(F.broadcast(marks.select(F.col("b").alias("a"))), "a", "left_anti").groupBy("a").agg(F.sum(F.col("wx") * off).alias("x"), F.sum(F.col("wy") * off).alias("y"))
    placed = spark.createDataFrame([(t, float(xy[i, 0]), float(xy[i, 1])) for t, i in at.items()], "term string, x double, y double")
    return placed.union(others.select("a", "x", "y"))


def pooled(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The rising means nearest to those of neighbouring groups (isotonic regression); groups without members take the one before."""
    blocks: list[list[float]] = []  # sum, count, groups
    for s, c in zip(sums.tolist(), counts.tolist(), strict=True):
        if not c:
            if blocks:
                blocks[-1][2] += 1
            else:
                blocks.append([0.0, 0.0, 1])
            continue
        blocks.append([s, c, 1])
        while len(blocks) > 1 and (not blocks[-2][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s1, c1, g1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + c1, blocks[-1][2] + g1]
    return np.concatenate([np.full(int(g), s / c if c else 0.0) for s, c, g in blocks]) if blocks else np.zeros(0)


def vector_map(table: DataFrame, method: str = "metric", rounds: int = 100, tol: float = 1e-4, landmarks: int = 500, seed: int = 42, metric: str = "cosine", p: float = 2.0) -> Map:
    """:func:`stress_map` of the targets of ``table`` (target, feature, value).

    Equal vectors lie in one place, so one of them stands for all: it weighs as many, and pairs
    grow with the square of distinct vectors.
    """
    table = kept(values(table), "vectors")
    firsts = repeated(table, metric)
    found = written(distances(table, method=metric, p=p, terms=firsts.where("term = first").select("term"), compact=True), "distances")
    m = stress_map(found, method, rounds, tol, landmarks, seed, firsts)
    spent(found)
    points = m.points.withColumnRenamed("term", "first")
    return Map(firsts.join(points, "first").select("term", "x", "y"), m.stress)


def stress_map(found: DataFrame, method: str = "metric", rounds: int = 100, tol: float = 1e-4, landmarks: int = 500, seed: int = 42, firsts: DataFrame | None = None) -> Map:
    """A map of a full table of distances (a, b, distance); rounds end when stress falls by less than ``tol`` of itself.

    Both orders of a pair may be given or one; the diagonal is not read.  Terms at distance 0 of each
    other weigh nothing in sammon.  ``firsts`` (term, first): the table has only terms that are the first
    of theirs, and each of them counts as often as it is one.
    """
    method = named(method, METHODS, "method")
    one = found.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("double").alias("d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    half = written(one, "half")
    weight = F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0) if method == "sammon" else F.lit(1.0)
    span = half.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).first()
    both = half.union(half.select("b", "a", "d"))
    # Ordered pairs of terms that one row stands for; they are at 0.
    inside, many = 0, None
    if firsts is not None:
        many = firsts.groupBy(F.col("first").alias("term")).agg(F.count("*").alias("m"))
        inside = many.agg(F.sum(F.col("m") * (F.col("m") - 1))).first()[0] or 0
    low = min(span["lo"] or 0.0, 0.0) if inside else span["lo"] or 0.0
    width = ((span["hi"] or 0.0) - low) or 1.0
    step = F.least(F.lit(STEPS - 1), F.floor((F.col("d") - F.lit(low)) / width * STEPS)).cast("int")
    heavy = lambda c: F.lit(1).alias(f"m{c}") if many is None else F.col(f"m{c}")
    for c in ("a", "b") if many is not None else ():
        both = both.join(many.toDF(c, f"m{c}"), c)
    pairs = bucketed(both.select("a", "b", "d", (weight * heavy("b")).alias("w"), step.alias("step"), heavy("a"), heavy("b")), "map_pairs", "a")
    terms = written(pairs.select(F.col("a").alias("term")).distinct(), "map_terms")
    n = terms.count()
    if span["n"] != n * (n - 1) // 2:
        raise ModelError("a pair of terms has no distance")
    spent(half)
    if inside and not n:
        # All terms are equal.
        return Map(many.select("term", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), [0.0])
    points = written(placed(pairs, firsts, landmarks, seed) if inside else started(pairs, terms, landmarks, seed), "points")
    n = firsts.count() if inside else n
    spark, history = found.sparkSession, []
    while n:
        x, y = points.toDF("a", "xa", "ya"), points.toDF("b", "xb", "yb")
        far = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
        met = pairs.join(x, "a").join(y, "b").withColumn("far", far)
        wanted = F.col("d")
        if method == "ordinal":
            times = F.col("ma") * F.col("mb")
            got = met.groupBy("step").agg(F.sum(times).alias("c"), F.sum(times * F.col("far")).alias("s")).collect()  # at most STEPS rows
            counts, sums = np.zeros(STEPS), np.zeros(STEPS)
            for r in got:
                counts[r["step"]], sums[r["step"]] = r["c"], r["s"]
            counts[0] += inside
            level = pooled(counts, sums)
            met = met.join(F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(level)], "step int, level double")), "step")
            wanted = F.col("level")
        met = met.withColumn("to", wanted)
        pull = F.col("w") * (F.when(F.col("far") > 0, F.col("to") / F.col("far")).otherwise(0.0) - 1.0)
        error = F.col("w") * F.pow(F.col("to") - F.col("far"), 2)
        # Unit weights have an exact step; others one that a bound on them allows.
        reach = F.lit(float(n)) if method != "sammon" else F.greatest(2 * F.sum("w"), F.lit(1e-300))
        moved = met.groupBy("a").agg(
            (F.first("xa") + F.sum(pull * (F.col("xa") - F.col("xb"))) / reach).alias("x"),
            (F.first("ya") + F.sum(pull * (F.col("ya") - F.col("yb"))) / reach).alias("y"),
            (F.first("ma") * F.sum(error)).alias("error"),
            (F.first("ma") * F.sum(F.col("w") * F.col("to") * F.col("to"))).alias("whole"),
        )
        moved = written(moved, "points")
        sums = moved.agg(F.sum("error").alias("e"), F.sum("whole").alias("w")).first()
        # Equal terms stay together, but the function of distances may want them apart.
        rest = inside * float(level[0]) ** 2 if method == "ordinal" and inside else 0.0
        history.append(float(np.sqrt((sums["e"] + rest) / (sums["w"] + rest))) if sums["w"] + rest else 0.0)
        if len(history) > rounds or (len(history) > 1 and history[-2] - history[-1] <= tol * history[-2]):
            spent(moved)
            break
        spent(points)
        points = moved.select(F.col("a").alias("term"), "x", "y")
        points.__dict__["_written"] = moved.__dict__.get("_written")
    spent(pairs, terms)
    return Map(points, history)
