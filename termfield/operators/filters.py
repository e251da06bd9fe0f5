"""Subsets of models, matches inside groups, lemma formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.association import named
from ..model import ModelError, TermModel, missing, values, with_nonzero
from ..shared import spent, written


def _bound(info: DataFrame, condition: Column | str | None, model: TermModel) -> DataFrame:
    """Rows of an info table where the condition holds; globals are columns there; null drops."""
    if condition is None:
        return info
    if re.search(r"\bN\b", str(condition)):
        model.N  # noqa: B018  (summed now if it was not before)
    extra = {k: v for k, v in model.globals.items() if k not in info.columns and isinstance(v, (int, float, str, bool))}
    return info.withColumns({k: F.lit(v) for k, v in extra.items()}).where(condition).select(*info.columns)


def subset(
    model: TermModel,
    rows: Column | str | None = None,
    cols: Column | str | None = None,
    recursive: bool = False,
    drop_zeroes: bool = False,
    matrix_only: bool = False,
):
    """The part of a model whose targets and features meet the conditions.

    Conditions see the columns of the info table and the globals.  Marginals and N stay as
    they are; nnzero is counted anew.  ``recursive`` repeats until nothing is dropped;
    ``drop_zeroes`` drops empty rows and columns of the result, once per round.
    """
    if recursive and matrix_only:
        raise ValueError("recursive and matrix_only do not go together")
    out, size, last = model, None, None
    # Sizes only fall, so a round that drops nothing comes.
    while True:
        out = _once(out, rows, cols, drop_zeroes)
        if matrix_only:
            return out.primary
        if not recursive:
            return out
        out = out.replaced(**{k: written(getattr(out, k), k) for k in ("rows", "cols", "cells", "scores") if getattr(out, k) is not None})
        if last is not None:
            spent(last.rows, last.cols, last.cells, last.scores)
        last = out
        now = out.dim()
        if now == size:
            return out
        size = now


def _once(model: TermModel, rows: Column | str | None, cols: Column | str | None, drop_zeroes: bool) -> TermModel:
    r, c = _bound(model.rows, rows, model), _bound(model.cols, cols, model)

    def cut(table: DataFrame | None) -> DataFrame | None:
        if table is None:
            return None
        if rows is not None or drop_zeroes:
            table = table.join(r.select(F.col("term").alias("target")), "target", "left_semi")
        if cols is not None or drop_zeroes:
            table = table.join(c.select(F.col("term").alias("feature")), "feature", "left_semi")
        return table.select("target", "feature", table.columns[2] if table.columns[0] == "target" else table.columns[-1])

    cells, scores = cut(model.cells), cut(model.scores)
    main = scores if scores is not None else cells
    if drop_zeroes:
        held = main.where(F.col(main.columns[2]) != 0)
        r = r.join(held.select(F.col("target").alias("term")), "term", "left_semi")
        c = c.join(held.select(F.col("feature").alias("term")), "term", "left_semi")
    if rows is not None or drop_zeroes:
        c = with_nonzero(c, main, "feature")
    if cols is not None or drop_zeroes:
        r = with_nonzero(r, main, "target")
    return model.replaced(rows=r, cols=c, cells=cells, scores=scores)


def numbered(info: DataFrame, *by: str) -> DataFrame:
    """``info`` with k: places from 1 in the order of ``by``.

    Rows are sorted by range, and what stands before a partition is added from sums, so no task
    orders them all.
    """
    placed = written(info.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "numbered")
    # One row a partition.
    sums = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    out = placed.withColumn("inside", inside).join(F.broadcast(sums.select("part", before.alias("before"))), "part")
    return out.select(*info.columns, (F.col("before") + F.col("inside")).alias("k"))


def at_labels(table: DataFrame, labels: list[str], by_row: bool = True, skip_missing: bool = False, info: DataFrame | None = None) -> DataFrame:
    """(pos, target, feature, value): the rows (or columns) of the labels in the order asked for, as often as asked for.

    ``pos`` counts from 1.  ``info`` names labels that have no cells: they have a row (pos,
    label, null, null).  Unknown labels are an error, or left out.
    """
    t = values(table)
    key = "target" if by_row else "feature"
    asked = table.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(labels)], f"pos int, {key} string")
    known = (info.select(F.col("term").cast("string").alias(key)) if info is not None else t.select(key)).distinct()
    if not skip_missing:
        missing(asked.select(F.col(key).alias("term")), known.select(F.col(key).alias("term")), "unknown labels:")
    return asked.join(known, key, "left_semi").join(t, key, "left").select("pos", "target", "feature", "value")


def match_split(table: DataFrame, value: str, group: str, order: str, values: list | None = None, groups: list | None = None) -> DataFrame:
    """For each value, the position of its first row in each group: (value, one column a group).

    Without ``values`` those found in every group are taken; none is an error.
    """
    if groups is None:
        groups = [r[0] for r in table.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
    inside = table.where(F.col(group).isin(groups))
    if values is not None:
        inside = inside.where(F.col(value).isin(values))
    got = inside.groupBy(F.col(value).alias("value")).pivot(group, groups).agg(F.min(order))
    if values is None:
        got = got.dropna(subset=[f"{g}" for g in groups])
        if not got.limit(1).count():
            raise ModelError("no value is found in every group")
    return got


#: Part-of-speech letters and their long names.
LONG_TAGS = {"N": "SUBST", "Z": "SUBST", "V": "VERB", "J": "ADJ", "R": "ADV", "D": "ART", ".": "STOP", "I": "PREP", "T": "PREP"}


def convert_lemma(lemma: Column | str, form: str = "CWB", lower: bool = False, strict: bool = True) -> Column:
    """A lemma such as ``Walk_V`` in another form; ``lower`` puts the headword in lower case.

    CWB: Walk_V; BNC: walk_VERB, UNC for other letters; DM: Walk-v; HW: Walk; HWLC: walk.  A
    lemma that does not end in an underscore and a capital or point fails the query, or is
    null if not ``strict``.
    """
    x = F.col(lemma) if isinstance(lemma, str) else lemma
    form = named(form, ["CWB", "BNC", "DM", "HW", "HWLC"], "form")
    head, tag = F.substring(x, F.lit(1), F.length(x) - 2), F.substring(x, -1, 1)
    if lower or form in ("BNC", "HWLC"):
        head = F.lower(head)
    if form == "CWB":
        out = F.concat(head, F.lit("_"), tag)
    elif form == "BNC":
        names = F.create_map(*[F.lit(p) for kv in LONG_TAGS.items() for p in kv])
        out = F.concat(head, F.lit("_"), F.coalesce(F.try_element_at(names, tag), F.lit("UNC")))
    elif form == "DM":
        out = F.concat(head, F.lit("-"), F.lower(tag))
    else:
        out = head
    bad = F.raise_error(F.concat(F.lit("invalid lemma: "), x)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x.rlike("_[A-Z.]$"), out).otherwise(bad)


def prefix_search(terms: DataFrame, typed: str, most: int = 100) -> DataFrame:
    """The first ``most`` terms that begin with what was typed, sorted; trailing % are not part of it.

    Nothing typed finds nothing, and a whole term without % finds itself alone.
    """
    key = typed.rstrip("%")
    found = terms.select("term").where(F.startswith(F.col("term"), F.lit(key)) & F.lit(key != ""))
    if key == typed and found.where(F.col("term") == key).limit(1).count():
        found = found.where(F.col("term") == key)
    return found.distinct().orderBy("term").limit(most)
