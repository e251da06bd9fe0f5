"""The term model: sparse co-occurrence data with labelled margins.

Cells are a long table (target, feature, value).  ``cells`` holds raw counts, ``scores`` what
a scoring run made of them.  ``rows`` and ``cols`` describe the labels: term, f (marginal
frequency), nnzero, any other columns, and ``ord`` where the source has an order; without
``ord`` labels are in alphabetical order.  Models are immutable; operators return new ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


class ModelError(ValueError):
    """The data do not make a valid model."""


def listed(terms: list[str]) -> str:
    """Terms for an error message: all if there are few, else the first six."""
    return ", ".join(terms) if len(terms) < 10 else ", ".join(terms[:6]) + ", ..."


def values(df: DataFrame, name: str = "value") -> DataFrame:
    """(target, feature, value) from any long table of three columns."""
    t, f, v = df.columns[:3]
    return df.select(F.col(t).cast("string").alias("target"), F.col(f).cast("string").alias("feature"), F.col(v).cast("double").alias(name))


@dataclass(frozen=True)
class TermModel:
    rows: DataFrame
    cols: DataFrame
    cells: DataFrame | None = None
    scores: DataFrame | None = None
    globals: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def N(self) -> float | None:
        """The sample size; where it is the sum of the counts, it is summed when first asked for."""
        if self.globals.get("N") is None and (counts := self.globals.get("counts")) is not None:
            self.globals["N"] = counts.agg(F.sum("f")).first()[0]
        return self.globals.get("N")

    @property
    def locked(self) -> bool:
        """Marginals no longer fit the cells, so measures that need them are refused."""
        return bool(self.globals.get("locked"))

    @property
    def primary(self) -> DataFrame:
        """Scores if there are any, else counts: (target, feature, value)."""
        return self.matrix("auto")

    def matrix(self, what: str = "auto") -> DataFrame:
        if what not in ("auto", "M", "S"):
            raise ValueError("what must be auto, M or S")
        table = self.scores if what == "S" or (what == "auto" and self.scores is not None) else self.cells
        if table is None:
            raise ModelError(f"the model has no {'scores' if what == 'S' else 'counts'}")
        return values(table)

    def replaced(self, **parts) -> TermModel:
        return replace(self, **parts)

    # -- size and labels ----------------------------------------------------------------

    def dim(self) -> tuple[int, int]:
        return self.rows.count(), self.cols.count()

    def labels(self) -> tuple[DataFrame, DataFrame]:
        return in_order(self.rows).select("term"), in_order(self.cols).select("term")

    def settled(self) -> TermModel:
        """The same model in written tables, so that several actions do not compute it again."""
        parts = {k: written(getattr(self, k), k) for k in ("rows", "cols", "cells", "scores") if getattr(self, k) is not None}
        return self.replaced(**parts)

    def renamed(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> TermModel:
        """New labels from tables (old, new); every label needs one."""
        out = self
        for side, names in (("rows", rows), ("cols", cols)):
            if names is None:
                continue
            names = names.select(F.col("old").alias("term"), F.col("new").alias("_new"))
            missing(getattr(out, side).select("term"), names.select("term"), "no new label for")
            info = getattr(out, side).join(names, "term").withColumn("term", F.col("_new")).drop("_new")
            key = "target" if side == "rows" else "feature"
            parts = {side: info}
            for part in ("cells", "scores"):
                if (table := getattr(out, part)) is not None:
                    to = names.withColumnRenamed("term", key)
                    parts[part] = table.join(to, key).withColumn(key, F.col("_new")).drop("_new").select(*table.columns)
            out = out.replaced(**parts)
        return out

    def transposed(self) -> TermModel:
        turn = lambda t: None if t is None else t.select(F.col("feature").alias("target"), F.col("target").alias("feature"), t.columns[2])
        return self.replaced(rows=self.cols, cols=self.rows, cells=turn(self.cells), scores=turn(self.scores))

    def head(self, n: int = 6, k: int | None = None) -> DataFrame:
        """The cells of the first ``n`` targets and ``k`` features, scores if there are any."""
        few = in_order(self.rows).limit(n).select(F.col("term").alias("target"))
        some = in_order(self.cols).limit(n if k is None else k).select(F.col("term").alias("feature"))
        return self.primary.join(few, "target", "left_semi").join(some, "feature", "left_semi").select("target", "feature", "value")

    # -- facts --------------------------------------------------------------------------

    def sign_count(self, what: str = "auto") -> DataFrame:
        """One row: how many cells are positive, zero (those not stored too) and negative."""
        nr, nc = self.dim()
        v = F.col("value")
        got = self.matrix(what).agg(
            F.count("*").alias("stored"), F.coalesce(F.sum((v > 0).cast("long")), F.lit(0)).alias("pos"), F.coalesce(F.sum((v < 0).cast("long")), F.lit(0)).alias("neg")
        )
        return got.select("pos", (F.lit(nr * nc) - F.col("pos") - F.col("neg")).alias("zero"), "neg")

    def canonical(self, what: str = "auto") -> DataFrame:
        """One row of facts about a matrix: rows, cols, stored cells, nonzero ones, whether zeros or pairs twice are stored, and whether no value is negative."""
        nr, nc = self.dim()
        t = self.matrix(what)
        once = t.groupBy("target", "feature").agg(F.count("*").alias("n"), F.sum((F.col("value") != 0).cast("long")).alias("k"), F.min("value").alias("low"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
        got = once.agg(total("n").alias("stored"), total("k").alias("nonzero"), F.coalesce(F.max("n") > 1, F.lit(False)).alias("repeats"), F.coalesce(F.min("low") >= 0, F.lit(True)).alias("nonneg"))
        return got.select(F.lit(nr).cast("long").alias("rows"), F.lit(nc).cast("long").alias("cols"), "stored", "nonzero", (F.col("stored") > F.col("nonzero")).alias("zeros_stored"), "repeats", "nonneg")

    def canonical_cells(self, what: str = "auto") -> DataFrame:
        """The matrix with each pair once and no stored zeros: (target, feature, value)."""
        return self.matrix(what).groupBy("target", "feature").agg(F.sum("value").alias("value")).where("value != 0")

    def nonneg(self, what: str = "auto") -> bool:
        low = self.matrix(what).agg(F.min("value")).first()[0]
        return low is None or low >= 0

    def describe(self) -> dict:
        """Sizes and fill rate, for printing."""
        nr, nc = self.dim()
        out = {"rows": nr, "cols": nc, "cells": nr * nc, "N": self.N, "has_counts": self.cells is not None, "has_scores": self.scores is not None}
        out["nonzero"] = self.primary.where("value != 0").count()
        out["fill"] = out["nonzero"] / (nr * nc) if nr * nc else 0.0
        return out

    def __str__(self) -> str:
        d = self.describe()
        return f"term model: {shortened(d['rows'])} targets x {shortened(d['cols'])} features, {shortened(d['nonzero'])} nonzero cells ({d['fill']:.2%})"

    def check(self) -> TermModel:
        """Raise :class:`ModelError` unless labels are unique and cells, marginals and N fit."""
        for side in ("rows", "cols"):
            info = getattr(self, side)
            if "term" not in info.columns:
                raise ModelError(f"{side} need a column term")
            twice = [r["term"] for r in info.groupBy("term").count().where("count > 1").orderBy("term").limit(10).collect()]
            if twice:
                raise ModelError(f"{side} repeat the labels {listed(twice)}")
        if self.cells is None and self.scores is None:
            raise ModelError("the model has neither counts nor scores")
        for part in ("cells", "scores"):
            if (table := getattr(self, part)) is not None:
                missing(table.select(F.col("target").alias("term")), self.rows, f"{part} hold targets that rows lack:")
                missing(table.select(F.col("feature").alias("term")), self.cols, f"{part} hold features that cols lack:")
        if self.cells is not None:
            if self.N is None or self.N != self.N or abs(self.N) == float("inf"):
                raise ModelError("a model with counts needs a finite sample size N")
            if "f" not in self.rows.columns or "f" not in self.cols.columns:
                raise ModelError("a model with counts needs marginal frequencies f")
            if not self.nonneg("M"):
                raise ModelError("counts must not be negative")
        return self


def shortened(n: float) -> str:
    """1234567 as 1.2M."""
    for size, sign in ((1e9, "G"), (1e6, "M"), (1e3, "k")):
        if n >= 10 * size or (n >= size and sign != "k"):
            return f"{n / size:.1f}{sign}"
    return f"{n:g}"


def in_order(info: DataFrame) -> DataFrame:
    return info.orderBy("ord", "term") if "ord" in info.columns else info.orderBy("term")


def missing(needed: DataFrame, there: DataFrame, what: str) -> None:
    """Raise if a term of ``needed`` is not in ``there``; at most ten terms are fetched."""
    lacking = needed.select("term").distinct().join(there.select("term"), "term", "left_anti")
    terms = [str(r["term"]) for r in lacking.orderBy("term").limit(10).collect()]
    if terms:
        raise ModelError(f"{what} {listed(terms)}")


def nonzero(table: DataFrame, key: str) -> DataFrame:
    """(term, nnzero) by target or feature."""
    return table.groupBy(F.col(key).alias("term")).agg(F.sum((F.col(table.columns[2]) != 0).cast("long")).alias("nnzero"))


def with_nonzero(info: DataFrame, table: DataFrame, key: str) -> DataFrame:
    counts = nonzero(table, key)
    return info.drop("nnzero").join(counts, "term", "left").withColumn("nnzero", F.coalesce("nnzero", F.lit(0).cast("long")))


def from_triplets(
    triplets: DataFrame,
    target: str = "target",
    feature: str = "feature",
    score: str | Column | None = "f",
    raw: bool = True,
    rowinfo: DataFrame | None = None,
    colinfo: DataFrame | None = None,
    N: float | None = None,
    order: str | None = None,
    globals: dict | None = None,
) -> TermModel:
    """A model from (target, feature, score) rows; repeated pairs are summed.

    ``score`` None counts rows (token data).  ``order`` names a column whose smallest value
    orders the labels.  ``rowinfo``/``colinfo`` (term, and f, nnzero or others) replace what is
    computed; terms they hold beyond the data are dropped, terms they lack are an error.
    Rows with a null label are left out.
    """
    value = F.lit(1.0) if score is None else (F.col(score) if isinstance(score, str) else score)
    base = triplets.select(
        F.col(target).cast("string").alias("target"),
        F.col(feature).cast("string").alias("feature"),
        value.cast("double").alias("f"),
        *([F.col(order).alias("ord")] if order else []),
    ).where("target is not null and feature is not null")
    cells = base.groupBy("target", "feature").agg(F.sum("f").alias("f"), *([F.min("ord").alias("ord")] if order else []))
    infos = []
    for key, given in (("target", rowinfo), ("feature", colinfo)):
        aggs = [F.sum((F.col("f") != 0).cast("long")).alias("nnzero")]
        if raw:
            aggs.insert(0, F.sum("f").alias("f"))
        if order:
            aggs.append(F.min("ord").alias("ord"))
        info = cells.groupBy(F.col(key).alias("term")).agg(*aggs)
        if given is not None:
            if "term" not in given.columns:
                raise ModelError("info tables need a column term")
            missing(info, given, "no information on")
            own = [c for c in info.columns if c == "term" or c not in given.columns]
            info = info.select(*own).join(given, "term")
        infos.append(info)
    known = dict(globals or {})
    table = cells.select("target", "feature", "f")
    known.update(N=N if N is not None else known.get("N"), locked=known.get("locked", False))
    if known["N"] is None and raw:
        # Summed before cells are: N needs no shuffle.
        known["counts"] = base.select("f")
    if raw:
        return TermModel(infos[0], infos[1], table, None, known)
    return TermModel(infos[0], infos[1], None, table.withColumnRenamed("f", "score"), known)


def from_dense(table: DataFrame, features: list[str], term: str = "term", vector: str = "vec", raw: bool = True, **more) -> TermModel:
    """A model from rows of (term, array of numbers), one number for each feature; zeros are not
    stored, but labels without other values stay."""
    names = F.array(*[F.lit(f) for f in features])
    sized = table.where(F.size(vector) != len(features)).limit(1).count()
    if sized:
        raise ModelError(f"every vector must have {len(features)} numbers")
    long = table.select(F.col(term).alias("target"), F.posexplode(vector).alias("at", "f"))
    long = long.select("target", F.element_at(names, F.col("at") + 1).alias("feature"), "f")
    out = from_triplets(long, raw=raw, **more)
    part = "cells" if raw else "scores"
    kept = getattr(out, part)
    return out.replaced(**{part: kept.where(F.col(kept.columns[2]) != 0)})


def to_arrays(table: DataFrame, cols: DataFrame, most: int = 20_000) -> DataFrame:
    """(term, vec): each target's values as an array in the order of ``cols``.

    Every array is as long as ``cols``, so this is for models of at most ``most`` features.
    """
    names = [r["term"] for r in in_order(cols).select("term").limit(most + 1).collect()]
    if len(names) > most:
        raise ModelError(f"arrays of more than {most} features are too wide")
    t = values(table)
    held = t.groupBy(F.col("target").alias("term")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    at = F.array(*[F.lit(n) for n in names])
    return held.select("term", F.transform(at, lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("vec"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
