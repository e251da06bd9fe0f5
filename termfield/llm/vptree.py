"""Approximate nearest neighbours by a vantage-point tree for each shard.

Vectors go to the region of their nearest pivot (a bounded sample), regions of more than
``shard_rows`` rows are split by a hash, and every shard becomes one tree, written as a table of
index rows.  A query first searches one shard of its own region.  Other shards are searched only
if the triangle inequality, with the pivots' distances and the least and greatest distance in
the region, leaves room within the k-th distance so far.  Inside a tree a vantage point splits
its points at the median distance, and a side is left out by the same rule.  Bounds count
``factor`` times: factor one is exact search, a larger one prunes more.  Queries meet a shard in
blocks; a task holds one block and one shard.

Vectors that are null, empty, zero or hold null or non-finite components take no part; nor
do rows with a null id.  Rows that share a vec_id are candidates each on their own, also for a
query with that id; only the query's own row is left out.  Ties go to the smaller vec_id.
Vectors of different lengths are never compared.  Tables without usable vectors give empty
results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, written


@dataclass
class Tree:
    """A vantage-point tree in arrays; node i holds points order[start[i]:end[i]] if it is a leaf."""

    point: np.ndarray  # vantage point, -1 for a leaf
    near: np.ndarray  # distances of the inside: least and greatest
    far: np.ndarray  # distances of the outside
    inside: np.ndarray  # child nodes
    outside: np.ndarray
    start: np.ndarray
    end: np.ndarray
    order: np.ndarray


def build(x: np.ndarray, leaf: int = 64) -> Tree:
    """A tree over the rows of ``x``; vantage points are spread by a fixed rule."""
    order = np.arange(len(x))
    point, near, far, inside, outside, start, end = [], [], [], [], [], [], []

    def node(a: int, z: int) -> int:
        at = len(point)
        for column, value in ((point, -1), (near, (0.0, 0.0)), (far, (0.0, 0.0)), (inside, -1), (outside, -1), (start, a), (end, z)):
            column.append(value)
        return at

    todo = [node(0, len(x))]
    while todo:
        i = todo.pop()
        a, z = start[i], end[i]
        if z - a <= leaf:
            continue
        members = order[a:z]
        # The member furthest from the first one sees the others best.
        first = x[members[0]]
        v = int(np.argmax(((x[members] - first) ** 2).sum(1)))
        members[[0, v]] = members[[v, 0]]
        rest = members[1:]
        d = np.sqrt(((x[rest] - x[members[0]]) ** 2).sum(1))
        if d.max() == 0:
            continue  # equal vectors stay in one leaf
        half = len(rest) // 2
        by = np.argsort(d, kind="stable")
        order[a + 1 : z], d = rest[by], d[by]
        point[i] = int(order[a])
        near[i], far[i] = (d[0], d[half - 1]), (d[half], d[-1])
        inside[i], outside[i] = node(a + 1, a + 1 + half), node(a + 1 + half, z)
        todo += [inside[i], outside[i]]
    return Tree(*(np.array(c) for c in (point, near, far, inside, outside, start, end)), order)


class Best:
    """The ``k`` best candidates of every query so far, by distance, then id."""

    def __init__(self, queries: int, k: int):
        self.far = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        k = self.far.shape[1]
        far = np.concatenate([self.far[rows], far], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        by = np.lexsort((ids, far), axis=1)[:, :k]
        self.far[rows], self.ids[rows] = np.take_along_axis(far, by, 1), np.take_along_axis(ids, by, 1)

    def limit(self, rows: np.ndarray) -> np.ndarray:
        return self.far[rows, -1]


#: What rounding may add to a bound, as a share of the distances it is made from.
SLACK = 1e-9


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, rows_of: np.ndarray, q: np.ndarray, q_rows: np.ndarray, limits: np.ndarray, k: int, factor: float) -> Best:
    """The k nearest of each query; all queries walk the tree together, a node at a time.

    ``rows_of`` and ``q_rows`` tell a query's own row; nothing beyond ``limits`` is looked for.
    """
    best = Best(len(q), k)

    def offer(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        # Differences, not products: the distance is exact in double precision.
        far = np.empty((len(rows), len(members)))
        for a in range(0, len(rows), 256):
            far[a : a + 256] = np.sqrt(((q[rows[a : a + 256], None, :] - x[None, members, :]) ** 2).sum(2))
        own = q_rows[rows][:, None] == rows_of[members][None, :]
        best.add(rows, np.where(own, np.inf, far), ids[members])
        return far

    def walk(i: int, rows: np.ndarray, bound: np.ndarray) -> None:
        keep = bound * factor <= np.minimum(best.limit(rows), limits[rows])
        rows = rows[keep]
        if not len(rows):
            return
        if tree.point[i] < 0:
            members = tree.order[tree.start[i] : tree.end[i]]
            for a in range(0, len(members), 4096):
                offer(rows, members[a : a + 4096])
            return
        d = offer(rows, tree.order[tree.start[i] : tree.start[i] + 1])[:, 0]
        sides = []
        for child, (least, most) in ((tree.inside[i], tree.near[i]), (tree.outside[i], tree.far[i])):
            sides.append((child, np.maximum(0.0, np.maximum(least - d, d - most) - SLACK * (d + most)), np.abs(d - (least + most) / 2)))
        # Each query walks its likelier side first.
        in_first = sides[0][2] <= sides[1][2]
        for mask, turn in ((in_first, (0, 1)), (~in_first, (1, 0))):
            if mask.any():
                for s in turn:
                    walk(int(sides[s][0]), rows[mask], sides[s][1][mask])

    walk(0, np.arange(len(q)), np.zeros(len(q)))
    return best


PLACED = "row long, id long, asked boolean, dim int, v array<double>, region int, far double"
INDEX = "dim int, region int, sub int, ids binary, rows binary, vectors binary, tree binary"


def usable(vectors: DataFrame, queries: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, asked): rows that take part, and whether they are queries."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    asked = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(False)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), asked.alias("asked")).where(F.col("id").isNotNull() & fine)


def pivots_of(rows: DataFrame, shard_rows: int, regions: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors: one for each ``shard_rows`` rows, at most ``regions``, with the smallest hashes."""
    out, most = {}, 1 << 40
    for r in rows.groupBy(F.size("v").alias("dim")).count().collect():
        want = min(regions, -(-r["count"] // shard_rows))
        key = F.pmod(F.xxhash64("id", "v"), F.lit(most))
        # About four times as many rows as are wanted pass, since equal ones count once.
        near = rows.where((F.size("v") == r["dim"]) & (key < F.lit(min(most, most * (4 * want + 16) // r["count"])))).select(key.alias("h"), "v").distinct()
        found = [x["v"] for x in near.orderBy("h").limit(4 * want + 64).toLocalIterator()]
        found = list(dict.fromkeys(map(tuple, found)))[:want]
        if not found:
            found = [tuple(rows.where(F.size("v") == r["dim"]).first()["v"])]
        out[r["dim"]] = np.array(found)
    return out


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, some at a time, by differences."""
    out = np.empty((len(x), len(to)))
    step = max(1, 4_000_000 // max(1, to.size))
    for a in range(0, len(x), step):
        out[a : a + step] = np.sqrt(((x[a : a + step, None, :] - to[None, :, :]) ** 2).sum(2))
    return out


def matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Every row with its region: the pivot it is nearest to, and how far that is."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 1024):
            size = b.column(3).to_numpy()
            region, far = np.zeros(len(size), np.int32), np.zeros(len(size))
            for dim, p in shared.value.items():
                at = np.flatnonzero(size == dim)
                if len(at):
                    d = _distances(matrix(b.column(4).take(pa.array(at)), dim), p)
                    region[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region), pa.array(far)], names=[x.split()[0] for x in PLACED.split(", ")])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "asked", F.size("v").alias("dim"), "v")
    return numbered.mapInArrow(run, PLACED)


def trees(table: DataFrame, subs: DataFrame) -> DataFrame:
    """One row a shard: ids, rows, vectors and tree.  ``subs`` is (dim, region, subs)."""

    def make(key, part):
        import pickle

        import pyarrow as pa

        dim = key[0].as_py()
        ids, rows = part.column("id").to_numpy(), part.column("row").to_numpy()
        x = matrix(part.column("v").combine_chunks(), dim)
        by = np.lexsort((rows, ids))
        ids, rows, x = ids[by], rows[by], x[by]
        held = (ids.tobytes(), rows.tobytes(), x.tobytes(), pickle.dumps(list(vars(build(x)).values())))
        cols = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([b], pa.binary()) for b in held]
        return pa.Table.from_arrays(cols, names=[c.split()[0] for c in INDEX.split(", ")])

    dealt = table.join(F.broadcast(subs), ["dim", "region"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    # A shard is bounded, whatever the data: rows of a large region are spread by their hash.
    return dealt.select("dim", "region", "sub", "id", "row", "v").groupBy("dim", "region", "sub").applyInArrow(make, INDEX)


FOUND = "row long, query_id long, vec_id long, score double"


def visit(visits: DataFrame, index: DataFrame, blocks: int, k: int, factor: float) -> DataFrame:
    """The ``k`` nearest of each visit (row, id, dim, v, region, sub, most) in its shard, none beyond ``most``."""

    def pack(key, part):
        import pyarrow as pa

        x = part.column("v").combine_chunks().flatten().to_numpy()
        held = [part.column(c).to_numpy().tobytes() for c in ("row", "id", "most")] + [x.tobytes()]
        cols = [pa.array([c.as_py()], pa.int32()) for c in key] + [pa.array([b], pa.binary()) for b in held]
        return pa.Table.from_arrays(cols, names=["dim", "region", "sub", "block", "q_rows", "q_ids", "most", "q"])

    def run(batches):
        import pickle

        import pyarrow as pa

        for b in slices(batches, 1):
            for dim, q_rows, q_ids, most, q, ids, rows, x, tree in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                ids, rows, q_rows, q_ids = (np.frombuffer(z, np.int64) for z in (ids, rows, q_rows, q_ids))
                x, q = np.frombuffer(x).reshape(-1, dim), np.frombuffer(q).reshape(-1, dim)
                best = search(Tree(*pickle.loads(tree)), x, ids, rows, q, q_rows, np.frombuffer(most), k, factor)
                found = np.isfinite(best.far)
                cols = [np.repeat(q_rows, found.sum(1)), np.repeat(q_ids, found.sum(1)), best.ids[found], best.far[found]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "query_id", "vec_id", "score"])

    dealt = visits.withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int"))
    held = dealt.groupBy("dim", "region", "sub", "block").applyInArrow(pack, "dim int, region int, sub int, block int, q_rows binary, q_ids binary, most binary, q binary")
    # Tasks hold one block and one shard at a time.
    meet = held.join(index, ["dim", "region", "sub"]).select("dim", "q_rows", "q_ids", "most", "q", "ids", "rows", "vectors", "tree")
    return meet.mapInArrow(run, FOUND)


def elsewhere(asked: DataFrame, pivots: dict[int, np.ndarray], sizes: dict, radii: dict, shard_rows: int, factor: float) -> DataFrame:
    """Visits to all shards but the first that a query (with ``sub``, its first shard, and ``most``) has to make."""
    shared = asked.sparkSession.sparkContext.broadcast((pivots, sizes, radii))

    def run(batches):
        import pyarrow as pa

        pivots, sizes, radii = shared.value
        for b in slices(batches, 256):
            dims = b.column(2).to_numpy()
            for dim, p in pivots.items():
                at = np.flatnonzero(dims == dim)
                if not len(at):
                    continue
                part = b.take(pa.array(at))
                d = _distances(matrix(part.column(3), dim), p)
                least, greatest = (np.array([radii[dim, r][i] for r in range(len(p))]) for i in (0, 1))
                many = np.array([-(-sizes.get((dim, r), 0) // shard_rows) for r in range(len(p))])
                slack = SLACK * (d + greatest[None, :])
                bound = np.maximum(np.maximum(d - greatest[None, :], least[None, :] - d), (d - d.min(1, keepdims=True)) / 2) - slack
                # Points of a region are at least as near to its pivot as to the query's.
                go = (np.maximum(bound, 0) * factor <= part.column(6).to_numpy()[:, None]) & (many > 0)[None, :]
                i, r = np.nonzero(go)
                own, sub = np.repeat(i, many[r]), np.concatenate([np.arange(n) for n in many[r]]) if len(r) else np.zeros(0, int)
                region = np.repeat(r, many[r])
                first = (region == part.column(4).to_numpy()[own]) & (sub == part.column(5).to_numpy()[own])
                own, region, sub = own[~first], region[~first], sub[~first]
                rows = part.take(pa.array(own))
                cols = [rows.column(0), rows.column(1), rows.column(2), rows.column(3), pa.array(region.astype(np.int32)), pa.array(sub.astype(np.int32)), rows.column(6)]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "dim", "v", "region", "sub", "most"])

    return asked.select("row", "id", "dim", "v", "region", "sub", "most").mapInArrow(run, "row long, id long, dim int, v array<double>, region int, sub int, most double")


def neighbours(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 4.0, shard_rows: int = 4096, block_rows: int = 2048, regions: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) where ``queries`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, queries)
    pivots = pivots_of(rows, shard_rows, regions)
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = written(placed(rows, pivots), "placed")
    # At most ``regions`` rows for each length of vectors.
    stats = table.groupBy("dim", "region").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.sum(F.col("asked").cast("long")).alias("q")).collect()
    sizes = {(r["dim"], r["region"]): r["n"] for r in stats}
    radii = {(dim, r): (np.inf, 0.0) for dim, p in pivots.items() for r in range(len(p))} | {(r["dim"], r["region"]): (r["lo"], r["hi"]) for r in stats}
    blocks = max(1, -(-sum(r["q"] for r in stats) // block_rows))
    subs = spark.createDataFrame([(d, r, -(-n // shard_rows)) for (d, r), n in sizes.items()], "dim int, region int, subs long")
    index = written(trees(table, subs), "trees")
    first = table.where("asked").join(F.broadcast(subs), ["dim", "region"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    first = first.select("row", "id", "dim", "v", "region", "sub", F.lit(float("inf")).alias("most"))
    near = written(visit(first, index, blocks, k, factor), "near")
    limits = near.groupBy("row").agg(F.count("*").alias("n"), F.max("score").alias("far"))
    most = F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf"))
    known = first.drop("most").join(limits, "row", "left").withColumn("most", F.coalesce(most, F.lit(float("inf"))))
    far = visit(elsewhere(known, pivots, sizes, radii, shard_rows, factor), index, blocks, k, factor)
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return near.union(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
