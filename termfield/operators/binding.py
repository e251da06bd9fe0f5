"""Putting models together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ModelError, TermModel, union_all, with_nonzero


def bind_rows(models: list[TermModel], suffixes: list[str] | None = None) -> TermModel:
    """The targets of several models with the same features, one under the other.

    Marginals of features are the largest of the models', N too; where they differ the result
    is locked, so that measures which need them are refused.  ``suffixes`` make labels unique
    and add orig_term and orig_part.
    """
    if len(models) < 2:
        raise ModelError("at least two models are needed")
    parts = [p for p in ("cells", "scores") if all(getattr(m, p) is not None for m in models)]
    if not parts:
        raise ModelError("the models share neither counts nor scores")
    first = models[0].cols.select("term")
    for m in models[1:]:
        other = m.cols.select("term")
        if first.exceptAll(other).limit(1).count() or other.exceptAll(first).limit(1).count():
            raise ModelError("the models have different features")
    if suffixes:
        if len(suffixes) != len(models):
            raise ValueError("one suffix for each model is needed")
        models = [_suffixed(m, s) for m, s in zip(models, suffixes, strict=True)]
    rows = union_all([m.rows for m in models])
    twice = [r["term"] for r in rows.groupBy("term").count().where("count > 1").orderBy("term").limit(10).collect()]
    if twice:
        raise ModelError(f"the models share the targets {', '.join(twice)}")
    tables = {p: union_all([getattr(m, p) for m in models]) for p in parts}
    cols, adjusted = same_marginals([m.cols for m in models])
    sizes = [m.N for m in models if m.N is not None]
    locked = adjusted or any(m.locked for m in models) or len(set(sizes)) > 1
    out = TermModel(rows, cols, tables.get("cells"), tables.get("scores"), {**models[0].globals, "counts": None, "N": max(sizes, default=None), "locked": locked})
    return out.replaced(cols=with_nonzero(cols, out.primary, "feature"))


def _suffixed(m: TermModel, suffix: str) -> TermModel:
    new = F.concat(F.col("term"), F.lit(suffix))
    rows = m.rows.withColumn("orig_term", F.col("term")).withColumn("orig_part", F.lit(suffix)).withColumn("term", new)
    turn = lambda t: None if t is None else t.withColumn("target", F.concat(F.col("target"), F.lit(suffix)))
    return m.replaced(rows=rows, cells=turn(m.cells), scores=turn(m.scores))


def same_marginals(tables: list[DataFrame]) -> tuple[DataFrame, bool]:
    """(info table of the terms found in all tables with their largest f, whether any f differs)."""
    if not all("f" in t.columns for t in tables):
        terms = reduce(lambda a, b: a.join(b, "term", "left_semi"), [t.select("term") for t in tables])
        return terms, False
    many = len(tables)
    got = union_all([t.select("term", F.col("f").cast("double").alias("f")) for t in tables]).groupBy("term")
    got = got.agg(F.max("f").alias("f"), F.min("f").alias("low"), F.count("*").alias("n")).where(F.col("n") == many)
    return got.select("term", "f"), got.where("low != f").limit(1).count() > 0


def bind_cols(models: list[TermModel]) -> TermModel:
    """The features of several models with the same targets, side by side."""
    return bind_rows([m.transposed() for m in models]).transposed()


def merge(models: list[TermModel], suffixes: list[str] | None = None) -> TermModel:
    """Like :func:`bind_rows` for models with different features: those common to all are kept."""
    common = reduce(lambda a, b: a.join(b, "term", "left_semi"), [m.cols.select("term") for m in models])
    if not common.limit(1).count():
        raise ModelError("the models have no feature in common")
    keep = common.withColumnRenamed("term", "feature")
    cut = []
    for m in models:
        part = lambda t: None if t is None else t.join(keep, "feature", "left_semi").select("target", "feature", t.columns[2])  # noqa: B023, E731
        out = m.replaced(cols=m.cols.join(common, "term", "left_semi"), cells=part(m.cells), scores=part(m.scores))
        cut.append(out.replaced(rows=with_nonzero(out.rows, out.primary, "target")))
    return bind_rows(cut, suffixes)


def add_counts(models: list[TermModel]) -> TermModel:
    """Counts of several models added up, over all their targets and features."""
    if any(m.cells is None for m in models):
        raise ModelError("only counts can be added")
    cells = union_all([m.cells for m in models]).groupBy("target", "feature").agg(F.sum("f").alias("f"))
    infos = []
    for side, key in (("rows", "target"), ("cols", "feature")):
        info = union_all([getattr(m, side).select("term", F.col("f").cast("double").alias("f")) for m in models]).groupBy("term").agg(F.sum("f").alias("f"))
        infos.append(with_nonzero(info, cells, key))
    return TermModel(infos[0], infos[1], cells, None, {"N": sum(m.N for m in models), "locked": any(m.locked for m in models)})


def vocabulary(tables: list[DataFrame], how: str = "union", pattern: str | None = None) -> DataFrame:
    """(term): the union or intersection of the terms of several tables, those that match a pattern."""
    terms = [t.select("term") for t in tables]
    out = reduce(lambda a, b: a.union(b), terms).distinct() if how == "union" else reduce(lambda a, b: a.intersect(b), terms)
    return out.where(F.col("term").rlike(pattern)) if pattern else out
