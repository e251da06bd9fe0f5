"""Scoring: association measure, then transformation, scaling and normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.association import ALWAYS_SPARSE, MEASURES, TRANSFORMS, Table, named
from ..model import ModelError, TermModel, values, with_nonzero
from .norms import normalize

SCALES = ["none", "standardize", "center", "scale"]


def densify(table: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every (target, feature) with its value, 0 where no cell is stored: as large as the full matrix."""
    t = values(table)
    # The full matrix is what is asked for.
    every = rows.select(F.col("term").alias("target")).crossJoin(cols.select(F.col("term").alias("feature")))
    return every.join(t, ["target", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _inputs(model: TermModel, measure: str, custom: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Row table (target, _r1), column table (feature, _c1) and N for a measure; refuses what is missing."""
    if model.cells is None:
        raise ModelError("scores need the counts of a model")
    if model.locked and measure not in ("frequency", "tf.idf"):
        raise ModelError("marginal frequencies of this model are not valid; only frequency and tf.idf can be used")
    need = measure not in ("frequency", "tf.idf") or custom
    if need and ("f" not in model.rows.columns or "f" not in model.cols.columns):
        raise ModelError(f"{measure} needs marginal frequencies of targets and features")
    if need and measure != "Dice" and model.N is None:
        raise ModelError(f"{measure} needs the sample size N")
    one = F.lit(1.0)
    r1 = F.col("f").cast("double") if "f" in model.rows.columns else one
    if measure == "tf.idf":
        if "df" in model.cols.columns:
            c1, n = F.col("df").cast("double"), one
        else:
            if "nnzero" not in model.cols.columns:
                raise ModelError("tf.idf needs document frequencies df or nnzero of features")
            c1, n = F.col("nnzero").cast("double") + 1, F.lit(float(model.rows.count() + 1))
    else:
        c1 = F.col("f").cast("double") if "f" in model.cols.columns else one
        n = F.lit(float(model.N)) if model.N is not None else one
    rows = model.rows.select(F.col("term").alias("target"), r1.alias("_r1"))
    cols = model.cols.select(F.col("term").alias("feature"), c1.alias("_c1"))
    return rows, cols, n


def score(
    model: TermModel,
    measure: str | Callable[..., Column] = "frequency",
    sparse: bool = True,
    negative_ok: bool | str | None = None,
    transform: str = "none",
    scale: str = "none",
    normalize_rows: bool = False,
    method: str = "euclidean",
    p: float = 2.0,
    tol: float = 1e-6,
    update_nnzero: bool = False,
    matrix_only: bool = False,
):
    """The model with scores, or the scores alone (target, feature, score).

    ``measure`` is a name from :data:`MEASURES` (a unique beginning will do), ``reweight`` to
    start from the scores there are, or a function that takes a :class:`Table` and returns a
    column.  ``sparse`` scores are 0 unless a cell is more frequent than expected.  Signed
    scores (``sparse=False``) of all cells fill the matrix and need ``negative_ok``;
    ``negative_ok="nonzero"`` signs the stored cells only.  By default what the scaling makes
    of the cells decides.  Own measures are cut off at 0 if ``sparse``, before transformation.

    Marginals are joined by label; Catalyst broadcasts them when they are small and shuffles
    on the label, splitting skewed ones, when they are not.
    """
    transform = named(transform, list(TRANSFORMS), "transform")
    scale = named(scale, SCALES, "scale")
    own = callable(measure)
    name = "own measure" if own else named(measure, [*MEASURES, "reweight"], "measure")
    if name != "reweight" and scale in ("standardize", "center") and negative_ok is False:
        raise ValueError(f"{scale} makes negative scores: negative_ok must not be False")
    if not sparse and name not in ALWAYS_SPARSE and name != "reweight" and negative_ok not in (True, "nonzero"):
        if negative_ok is None:
            negative_ok = True
        else:
            raise ValueError("signed scores need negative_ok")
    if name == "reweight":
        if model.scores is None:
            raise ModelError("reweighting needs scores")
        scored = values(model.scores, "score")
    else:
        rows, cols, n = _inputs(model, name, own)
        full = not sparse and negative_ok is True and name not in ALWAYS_SPARSE
        cells = densify(model.cells, model.rows, model.cols) if full else values(model.cells)
        joined = cells.join(rows, "target").join(cols, "feature")
        t = Table(F.col("value"), F.col("_r1"), F.col("_c1"), n)
        if own:
            value = measure(t)
            value = F.greatest(F.lit(0.0), value) if sparse else value
        else:
            value = MEASURES[name](t, sparse)
        scored = joined.select("target", "feature", value.alias("score"))
    scored = scored.withColumn("score", TRANSFORMS[transform](F.col("score")))
    scored = scaled(scored, model, scale)
    if normalize_rows:
        scored = normalize(scored, "target", method, p, tol).withColumnRenamed("value", "score")
    if matrix_only:
        return scored
    out = model.replaced(scores=scored)
    if update_nnzero:
        out = out.replaced(rows=with_nonzero(out.rows, scored, "target"), cols=with_nonzero(out.cols, scored, "feature"))
    return out


def scaled(scored: DataFrame, model: TermModel, how: str) -> DataFrame:
    """Column scaling of (target, feature, score); zeros that are not stored count.

    standardize: mean 0 and sample variance 1 (a constant column is NaN); center: mean 0; both
    fill the matrix.  scale: root mean square of n-1 is 1, zeros stay.
    """
    if how == "none":
        return scored
    n = model.rows.count()
    v = F.col("score")
    sums = scored.groupBy("feature").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    if how == "scale":
        size = F.sqrt(F.col("_q") / (n - 1)) if n > 1 else F.lit(float("nan"))
        return scored.join(sums, "feature").select("target", "feature", (v / F.nullif(size, F.lit(0.0))).alias("score")).fillna(0.0, ["score"])
    full = densify(scored, model.rows, model.cols)
    mean = F.avg("value").alias("_m")
    sums = full.groupBy("feature").agg(mean, F.stddev_samp("value").alias("_d"))
    centred = F.col("value") - F.col("_m")
    value = centred if how == "center" else F.when(F.col("_d") == 0, F.lit(float("nan"))).otherwise(centred / F.col("_d"))
    return full.join(sums, "feature").select("target", "feature", value.alias("score"))
