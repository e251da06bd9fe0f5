"""Row and column norms, normalisation, and scaling of margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.association import named
from ..model import values

METHODS = ["euclidean", "maximum", "manhattan", "minkowski"]


def checked(method: str, p: float) -> tuple[str, float]:
    method = named(method, METHODS, "method")
    if method == "minkowski":
        if p == float("inf"):
            return "maximum", p
        if not 0 <= p < float("inf"):
            raise ValueError("p must be a number from 0 on")
    return method, p


def norm_of(v: Column, method: str, p: float) -> Column:
    """The aggregate that is a vector's norm; below p = 1 no root is taken, p = 0 counts nonzeros."""
    if method == "euclidean":
        return F.sqrt(F.sum(v * v))
    if method == "maximum":
        return F.max(F.abs(v))
    if method == "manhattan":
        return F.sum(F.abs(v))
    if p == 0:
        return F.sum((v != 0).cast("double"))
    total = F.sum(F.pow(F.abs(v), F.lit(float(p))))
    return F.pow(total, F.lit(1.0 / p)) if p > 1 else total


def norms(table: DataFrame, by: str = "target", method: str = "euclidean", p: float = 2.0, info: DataFrame | None = None) -> DataFrame:
    """(term, norm) of every target or feature; labels of ``info`` without a cell have norm 0."""
    method, p = checked(method, p)
    got = values(table).groupBy(F.col(by).alias("term")).agg(norm_of(F.col("value"), method, p).alias("norm"))
    if info is None:
        return got
    return info.select("term").join(got, "term", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0)))


def normalize(table: DataFrame, by: str = "target", method: str = "euclidean", p: float = 2.0, tol: float = 1e-6) -> DataFrame:
    """Vectors of length 1 (target, feature, value); those shorter than ``tol`` become 0."""
    method, p = checked(method, p)
    if method == "minkowski" and p < 0.05:
        raise ValueError("vectors cannot be normalised for p below 0.05")
    t = values(table)
    sizes = t.groupBy(by).agg(norm_of(F.col("value"), method, p).alias("_n"))
    n = F.col("_n")
    if method == "minkowski" and p < 1:
        n = F.pow(n, F.lit(1.0 / p))
    out = F.when(F.col("_n") < tol, F.lit(0.0)).otherwise(F.col("value") / n)
    return t.join(sizes, by).select("target", "feature", out.alias("value"))


def scale_margins(table: DataFrame, rows: DataFrame | float | None = None, cols: DataFrame | float | None = None) -> DataFrame:
    """value times a weight of its target and of its feature; weights are numbers or (term, weight)."""
    out = values(table)
    v = F.col("value")
    for key, weight in (("target", rows), ("feature", cols)):
        if weight is None:
            continue
        if isinstance(weight, DataFrame):
            named_weight = weight.select(F.col("term").alias(key), F.col("weight").cast("double").alias(f"_{key}"))
            out = out.join(named_weight, key, "left")
            v = v * F.col(f"_{key}")
        else:
            v = v * F.lit(float(weight))
    return out.select("target", "feature", v.alias("value"))
