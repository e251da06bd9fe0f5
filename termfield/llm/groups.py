"""From shared buckets to groups of linked items, without all pairs of a bucket.

Items share buckets (bands of a signature, cells of a Hamming table).  Every item is first
tested against one of the leaders of its buckets; in buckets that those links leave apart,
against the bucket's leader and then against two more.  What links join is one component.  In buckets that still hold several, members outside
the largest one are tested against all members of the others: as pairs in small buckets, block
against block inside tasks in crowded ones, so that rows grow with members and links.  A pair
that is never tested lies in one component already, so groups are those that testing all
pairs would give.

An item without a link is a group of its own.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, slices, written


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id of its component.

    Large-star and small-star steps alternate until the links no longer change; every step
    is written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # Every link is now (member, root).
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def rooted(items: DataFrame, roots: DataFrame, on: str = "id") -> DataFrame:
    """``items`` with root: their own id where they have no link."""
    return items.join(roots.withColumnRenamed("id", on), on, "left").withColumn("root", F.coalesce("root", on))


def linked(members: DataFrame, payload: DataFrame, tester: Callable, compare: Callable, slack: float | None = None, ratio: float = 0.0, crowd: int = 32) -> DataFrame:
    """Links (a, b) that join the items of ``members`` (bucket, id, n) as all tested pairs would.

    ``tester`` takes the ``payload`` (id and other columns) of the items in question and returns
    a test: from pairs (a, b) to (a, b, far, link).  ``n`` is an item's size: pairs whose
    smaller size is under ``ratio`` of the larger are no links.  With ``slack`` far must be a
    metric under which links are at most ``slack`` apart: pairs that the triangle inequality,
    with both distances to the bucket's leader, puts further apart are not tested.
    ``compare`` takes the payload columns (id aside) of two blocks, as lists, and returns the
    places (u, v) of links; it must agree with the test.
    """
    # Most buckets have one member; only their counts travel.
    many = members.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = written(members.join(many, "bucket"), "shared")
    items = written(shared.select("id").distinct(), "items")
    # What an item holds is moved once; every test joins it where it lies.
    buckets = max(8, min(10_000, items.count() // 10_000))
    held = bucketed(payload.join(items, "id", "left_semi").repartition(buckets, "id"), "id", buckets, "held")
    test = tester(held)
    # The leader is the same item in as many buckets as can be.
    lead = shared.groupBy("bucket").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(1))).alias("lead"))
    seats = written(shared.join(lead, "bucket").select("bucket", "id", "n", F.col("lead.id").alias("y"), F.col("lead.n").alias("m")), "buckets")
    # First each item meets one of its leaders, the one that leads most: one edge an item.
    one = seats.withColumnRenamed("id", "x").groupBy("x", "n").agg(F.min_by(F.struct("y", "m"), F.xxhash64("y", F.lit(1))).alias("l"))
    tested = written(test(_pairs(one.select("x", "n", F.col("l.y").alias("y"), F.col("l.m").alias("m")), ratio)), "tested")
    links = tested.where("link").select("a", "b")
    # Then the leaders of its other buckets, where these lie in other components.
    placed = _apart(seats, links)
    other = _pairs(placed.where("root != first").withColumnRenamed("id", "x"), ratio).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = tested.unionByName(written(test(other), "tested"))
    links = written(tested.where("link").select("a", "b"), "found")
    apart = _apart(placed.select("bucket", "id", "n", "y", "m"), links)
    seats = apart
    if slack is not None:
        ends = tested.select("a", "b", "far")
        seats = seats.withColumn("a", F.least("id", "y")).withColumn("b", F.greatest("id", "y")).join(ends, ["a", "b"], "left").drop("a", "b")
        seats = seats.withColumn("far", F.when(F.col("id") == F.col("y"), 0.0).otherwise(F.col("far")))
    else:
        seats = seats.withColumn("far", F.lit(None).cast("double"))
    apart = written(seats.select("bucket", "id", "n", "y", "far", "root", "most"), "seats")
    # Then leaders of the bucket's own, from its largest component.
    own = lambda k: F.min_by(F.struct("id", "n"), F.xxhash64("id", "bucket", F.lit(k)))
    leads = apart.where("root = most").groupBy("bucket").agg(F.array(own(2), own(3)).alias("leads"))
    to = apart.where("root != most").join(leads, "bucket").select(F.col("id").alias("x"), "n", F.explode("leads").alias("l"))
    more = _pairs(to.select("x", "n", F.col("l.id").alias("y"), F.col("l.n").alias("m")), ratio).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = written(test(more), "tested")
    tested = tested.unionByName(more)
    links = written(links.union(more.where("link").select("a", "b")), "found")
    apart = _apart(apart.select("bucket", "id", "n", "y", "far"), links)
    crowded = apart.groupBy("bucket").count().where(F.col("count") > crowd).select("bucket")
    x, y = apart.where("root != most").join(crowded, "bucket", "left_anti").alias("x"), apart.alias("y")
    near = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root"))
    near &= F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(ratio)
    # A pair of two small components is met from both sides; one is enough.
    near &= (F.col("y.root") == F.col("y.most")) | (F.col("x.id") < F.col("y.id"))
    if slack is not None:
        near &= F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= F.lit(slack + 1e-9), F.lit(True))
    rest = x.join(y, near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    rest = rest.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    # One kind of Python work at a time.
    found = written(links.union(test(rest).where("link").select("a", "b")), "found")
    return found.union(written(_crowds(apart.join(crowded, "bucket"), held, compare), "crowded"))


def _crowds(seats: DataFrame, payload: DataFrame, compare: Callable, items: int = 96, size: int = 48_000) -> DataFrame:
    """Links between components in crowded buckets.

    Buckets that share items are one crowd.  Its items are packed into blocks of about
    ``items`` items or ``size`` units of size; blocks of items outside the crowd's largest
    component meet all blocks, and a task that holds two blocks returns the links alone.
    """
    lead = seats.groupBy("bucket").agg(F.min("id").alias("b"))
    crowd = written(components(seats.join(lead, "bucket").select(F.col("id").alias("a"), "b")), "crowds")
    members = crowd.select("id", F.col("root").alias("crowd")).join(seats.select("id", "root", "n").distinct(), "id")
    sizes = members.groupBy("crowd", "root").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    most = sizes.groupBy("crowd").agg(F.max_by("root", F.struct("many", "root")).alias("most"), F.greatest(F.sum("many") / items, F.sum("n") / size).alias("blocks"))
    dealt = members.join(most, "crowd").withColumn("minor", F.col("root") != F.col("most"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil("blocks"))).drop("most", "blocks", "n")
    dealt = written(dealt, "dealt").join(payload, "id")
    names = payload.drop("id").columns

    def pack(key, table):
        import pickle

        import pyarrow as pa

        held = pickle.dumps([table.column(c).to_pylist() for c in ("id", "root", *names)])
        return pa.table({"crowd": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "held": pa.array([held], pa.binary())})

    blocks = lambda df: df.groupBy("crowd", "block").applyInArrow(pack, "crowd long, block long, held binary")
    asking, asked = written(blocks(dealt.where("minor")), "asking"), written(blocks(dealt), "asked")
    meet = asking.select("crowd", F.col("held").alias("x")).join(asked.select("crowd", F.col("held").alias("y"), "block"), "crowd")

    def run(batches):
        import pickle

        import pyarrow as pa

        for b in slices(batches, 1):
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                (i, r, *px), (j, t, *py) = pickle.loads(x), pickle.loads(y)
                pairs = [(min(i[u], j[v]), max(i[u], j[v])) for u, v in compare(px, py) if r[u] != t[v]]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # Blocks of one crowd spread over the tasks.
    return meet.repartition("crowd", "block", F.xxhash64("x")).select("x", "y").mapInArrow(run, "a long, b long")


def _pairs(to: DataFrame, ratio: float) -> DataFrame:
    """Distinct pairs (a, b) of (x, n, y, m) whose sizes allow a link."""
    fair = (F.col("x") != F.col("y")) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(ratio))
    return to.where(fair).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(seats: DataFrame, links: DataFrame) -> DataFrame:
    """Seats of buckets that hold several components: root, that of the leader (first) and the largest root there (most)."""
    placed = rooted(seats, written(components(links), "roots"))
    leads = F.max(F.when(F.col("id") == F.col("y"), F.col("root"))).alias("first")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("count"), leads)
    most = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots"), F.max("first").alias("first"))
    return written(placed.join(most.where("roots > 1").drop("roots"), "bucket"), "seats")
