"""All distances of one or two sets of vectors, not stored but computed where blocks meet, and reduced there.

A table of all pairs grows with the square of its terms.  Whoever wants a few rows of each term, or a few
numbers of all, gets them from a sweep: every block of vectors meets every other (:func:`.distances.met`),
and a task returns what it makes of them.  Each sweep computes every distance anew; disk holds the
vectors and results only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from . import distances as D
from .graphs import found_quantile


@dataclass(frozen=True)
class Swept:
    """Blocks of both sides (the same table if all meet all), and how they are compared."""

    left: DataFrame
    right: DataFrame
    width: int
    how: tuple  # method, p, normalized, convert
    same: bool

    def table(self, compact: bool = False) -> DataFrame:
        """(a, b, distance) of all pairs."""
        return D._compared(self.left, self.right, self.width, *self.how, self.same, compact)

    def terms(self, side: str = "left") -> DataFrame:
        return getattr(self, side).select(F.explode("names").alias("term"))


def swept(sides: D.Sides, p: float = 2.0, normalized: bool = False, convert: bool = True) -> Swept | None:
    """The sides' distances, or None if there are too many features for blocks."""
    if sides.features is None:
        return None
    left = D._blocks(sides.x, sides.names, sides.features)
    right = left if sides.y is sides.x else D._blocks(sides.y, sides.names2, sides.features)
    return Swept(left, right, len(sides.features), (sides.method, p, normalized, convert), sides.same)


def nearest(s: Swept, n: int, similarity: bool, own: bool, digits: int | None = None) -> DataFrame:
    """(target, neighbour, rank, distance): the ``n`` nearest of each target of the left side, ties by name.

    Of each target a task returns its ``n`` nearest among the blocks that it held.  Without ``own`` a
    target is not its own neighbour.  ``digits``: what agrees in so many digits is a tie.
    """
    how, same = s.how, s.same

    def run(batches):
        import pyarrow as pa

        now, a, kept, new, worst = None, None, None, [], None

        def settle():
            """The ``n`` nearest of what was kept and what is new: (row, key, name, distance) in order."""
            i, key, name, far = (np.concatenate(c) for c in zip(*([kept] if kept else []), *new, strict=True))
            order = np.lexsort((name, key, i))
            i, key, name, far = i[order], key[order], name[order], far[order]
            start = np.searchsorted(i, np.arange(len(a)))
            first = np.arange(len(i)) - start[i] < n
            full = np.bincount(i, minlength=len(a)) >= n
            worst = np.full(len(a), np.inf)
            worst[full] = key[start[full] + n - 1]
            return tuple(c[first] for c in (i, key, name, far)), worst

        def out():
            i, key, name, far = settle()[0] if new else kept
            return pa.RecordBatch.from_arrays([pa.array(a).take(pa.array(i)), pa.array(name.tolist(), pa.string()), pa.array(key), pa.array(far)], names=["a", "b", "key", "distance"])

        for at, names, u, _, b, v, _ in D.opened(batches):
            if at != now:
                if now is not None and (new or kept):
                    yield out()
                now, a, kept, new, worst = at, names, None, [], np.full(len(names), np.inf)
                pending = 0
            far = D.block_distances(names, u, b, v, *how, same)
            # A vector without direction comes last in both orders.
            key = np.where(np.isnan(far), np.inf, -far if similarity else far)
            if digits is not None:
                key = np.round(key, digits)
            least = worst
            if key.shape[1] > n:
                # Names are in order, but ties at the edge are all taken.  One more, since a target may meet itself.
                least = np.minimum(worst, np.partition(key, n, axis=1)[:, n])
            i, j = np.nonzero(key <= least[:, None])
            name = np.array(b)
            if not own:
                apart = np.array(names)[i] != name[j]
                i, j = i[apart], j[apart]
            if len(i):
                new.append((i, key[i, j], name[j], far[i, j]))
                pending += len(i)
            if pending > 8 * n * len(names):
                kept, worst = settle()
                new, pending = [], 0
        if now is not None and (new or kept):
            yield out()

    found = D.met(s.left, s.right, s.width, run, "a string, b string, key double, distance double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("key", "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("a").alias("target"), F.col("b").alias("neighbour"), "rank", "distance")


def _with(s: Swept, rows: DataFrame) -> DataFrame:
    """The blocks of the left side with ``rows`` (a, ...) of their targets, as an array."""
    at = s.left.select("block", F.explode("names").alias("a"))
    held = rows.join(at, "a").groupBy("block").agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return s.left.join(held, "block", "left")


def asked(s: Swept, pairs: DataFrame) -> DataFrame:
    """(a, b, distance) of the distinct ``pairs`` (a, b) whose names are known; a block that has none of them is not measured."""
    how, same = s.how, s.same

    def run(batches):
        import pyarrow as pa

        now, wanted = None, {}
        for at, a, u, _, b, v, more in D.opened(batches):
            if at != now:
                now, wanted, place = at, {}, {t: i for i, t in enumerate(a)}
                for r in more["rows"].as_py() or []:
                    wanted.setdefault(r["b"], []).append(place[r["a"]])
            hit = [(i, j) for j, t in enumerate(b) if t in wanted for i in wanted[t]]
            if hit:
                i, j = np.array(hit).T
                far = D.block_distances(a, u, b, v, *how, same)
                yield pa.RecordBatch.from_arrays([pa.array(a).take(pa.array(i)), pa.array(b).take(pa.array(j)), pa.array(far[i, j])], names=["a", "b", "distance"])

    return D.met(_with(s, pairs.select("a", "b").distinct()), s.right, s.width, run, "a string, b string, distance double")


def ranks(s: Swept, pairs: DataFrame, similarity: bool, own: bool) -> DataFrame:
    """(a, b, d, rank) of the known ``pairs`` (a, b): one more than the number of nearer targets; d falls with nearness.

    ``own``: the term itself stands first and is not counted.  Targets are counted where blocks
    meet, so none is ordered.
    """
    how, same = s.how, s.same
    # A vector without direction is as far as can be.
    d = F.when(F.isnan("distance"), F.lit(float("inf"))).otherwise(-F.col("distance") if similarity else F.col("distance"))
    found = written(asked(s, pairs).select("a", "b", d.alias("d")), "asked")

    def run(batches):
        import pyarrow as pa

        now, a, edges, nearer = None, None, {}, {}

        def out():
            at = [i for i, e in edges.items() for _ in e]
            return pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.string()), pa.array(np.concatenate(list(edges.values()))), pa.array(np.concatenate([nearer[i][:-1].cumsum() for i in edges]))], names=["a", "d", "n"])

        for at, names, u, _, b, v, more in D.opened(batches):
            if at != now:
                if edges:
                    yield out()
                now, a, place, limits = at, names, {t: i for i, t in enumerate(names)}, {}
                for r in more["rows"].as_py() or []:
                    limits.setdefault(place[r["a"]], []).append(r["d"])
                edges = {i: np.sort(np.array(t)) for i, t in limits.items()}
                nearer = {i: np.zeros(len(e) + 1, dtype=np.int64) for i, e in edges.items()}
            if not edges:
                continue
            rows = list(edges)
            far = D.block_distances([a[i] for i in rows], u[rows], b, v, *how, same) if len(rows) < len(a) and how[0] != "cosine" else D.block_distances(a, u, b, v, *how, same)[rows]
            far = np.where(np.isnan(far), np.inf, -far if similarity else far)
            # Of a term's distances looked for, those above a target's count it.
            for i, row in zip(rows, far, strict=True):
                if len(edges[i]) == 1:
                    nearer[i][0] += np.count_nonzero(row < edges[i][0])
                else:
                    nearer[i] += np.bincount(np.searchsorted(edges[i], row, side="right"), minlength=len(edges[i]) + 1)
        if edges:
            yield out()

    counts = D.met(_with(s, found.select("a", "d").distinct()), s.right, s.width, run, "a string, d double, n long")
    counts = counts.groupBy("a", "d").agg((F.sum("n") + (0 if own else 1)).cast("double").alias("rank"))
    return found.join(counts, ["a", "d"])


def faults(s: Swept) -> tuple[int, int]:
    """How many distances are negative, and how many of one set of vectors differ from those the other way round."""
    how, same = s.how, s.same

    def run(batches):
        import pyarrow as pa

        low = uneven = 0
        for k, a, u, l, b, v, _ in D.opened(batches):
            if k > l:
                continue
            far, back = D.block_distances(a, u, b, v, *how, same), D.block_distances(b, v, a, u, *how, same).T
            low += int((far < 0).sum() + (back < 0).sum())
            # NaN is as good as another, as it is where tables are joined.
            near = (np.abs(far - back) <= 1e-12 * (1 + np.abs(far))) | (np.isnan(far) & np.isnan(back))
            uneven += int(near.size - near.sum())
        yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([uneven])], names=["low", "uneven"])

    got = D.met(s.left, s.right, s.width, run, "low long, uneven long").agg(F.sum("low"), F.sum("uneven")).first()
    return got[0] or 0, got[1] or 0


def quantile(s: Swept, share: float, few: int = 10_000, ranges: int = 1 << 16) -> tuple[float | None, float | None, float | None]:
    """(quantile, least, greatest) of the distances of all pairs of one set of vectors, from counts by ranges; NaN is left out."""
    how, same = s.how, s.same

    def over(make, schema: str) -> DataFrame:
        """``make`` of the distances of each block's pairs; both orders of two blocks give one."""

        def run(batches):
            for k, a, u, l, b, v, _ in D.opened(batches):
                if k <= l:
                    far = D.block_distances(a, u, b, v, *how, same)
                    far = far[np.triu_indices(len(a), 1)] if k == l else far.ravel()
                    yield from make(far[~np.isnan(far)])

        return D.met(s.left, s.right, s.width, run, schema)

    def counted(lo: float, hi: float):
        def make(far):
            import pyarrow as pa

            far = np.sort(far[(far >= lo) & (far <= hi)])
            if len(far):
                width = (hi - lo) / ranges
                at = np.minimum(ranges - 1, np.floor((far - lo) / width)).astype(np.int64) if width > 0 else (far > lo).astype(np.int64)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                last = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(last - first), pa.array(far[first]), pa.array(far[last - 1])], names=["k", "n", "lo", "hi"])

        return over(make, "k long, n long, lo double, hi double").groupBy("k").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()

    def spanned(far):
        import pyarrow as pa

        if len(far):
            yield pa.RecordBatch.from_arrays([pa.array([len(far)]), pa.array([far.min()]), pa.array([far.max()])], names=["n", "lo", "hi"])

    def held(lo: float, hi: float) -> list[float]:
        def make(far):
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(far[(far >= lo) & (far <= hi)])], names=["v"])

        return [r["v"] for r in over(make, "v double").collect()]

    span = over(spanned, "n long, lo double, hi double").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if not span["n"]:
        return None, None, None
    return found_quantile(share, span["n"], span["lo"], span["hi"], counted, held, few), span["lo"], span["hi"]
