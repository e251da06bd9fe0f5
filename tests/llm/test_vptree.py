import numpy as np
from pyspark.sql import functions as F

from termfield.llm import vptree
from termfield.llm.queries import op7_vptree


def brute(ids, x, k=10):
    far = np.sqrt(((x[ids % 100 == 0][:, None] - x[None]) ** 2).sum(2))
    out = {}
    for i, row in zip(ids[ids % 100 == 0], far, strict=True):
        order = sorted((d, j) for d, j in zip(row, ids, strict=True) if j != i)[:k]
        out[int(i)] = [(int(j), float(d)) for d, j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)


def test_factor_one_is_exact(spark):
    ids, x = table(spark, "sf0.01")
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = found(vptree.neighbours(vectors, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=128, block_rows=3).collect())
    assert got == brute(ids, x)
    # Few regions, each of several shards.
    got = found(vptree.neighbours(vectors, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=64, regions=3).collect())
    assert got == brute(ids, x)


def test_shards_are_left_out(spark):
    """In well separated groups a query visits few shards, and the result is exact all the same."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 8)) + 100 * rng.normal(size=8) for _ in range(8)])
    ids = np.arange(len(x))
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = found(vptree.neighbours(vectors, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=50).collect())
    assert got == brute(ids, x)
    rows = vptree.usable(vectors, F.col("vec_id") % 100 == 0)
    pivots = vptree.pivots_of(rows, 50, 4096)
    table = vptree.placed(rows, pivots)
    stats = {(r.dim, r.region): r for r in table.groupBy("dim", "region").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()}
    asked = table.where("asked").select("row", "id", "dim", "v", "region", F.lit(0).alias("sub"), F.lit(5.0).alias("most"))
    radii = {(8, r): (np.inf, 0.0) for r in range(len(pivots[8]))} | {k: (r.lo, r.hi) for k, r in stats.items()}
    visits = vptree.elsewhere(asked, pivots, {k: r.n for k, r in stats.items()}, radii, 50, 1.0).count()
    assert visits < 0.5 * asked.count() * len(stats)


def test_recall_of_the_query(spark):
    ids, x = table(spark, "sf0.1")
    got, want = found(op7_vptree(spark, "/root/testdata/sf0.1").collect()), brute(ids, x)
    assert got.keys() == want.keys()
    exact = {(q, j): d for q, v in want.items() for j, d in v}
    hit = sum((q, j) in exact for q, v in got.items() for j, _ in v)
    assert hit / len(exact) >= 0.95
    assert all(exact[q, j] == d for q, v in got.items() for j, d in v if (q, j) in exact)


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 3), (3, [0.0, 0.0], 4), (4, None, 5), (5, [], 6),
        (6, [1.0, None], 7), (7, [float("nan"), 1.0], 8), (8, [float("inf"), 1.0], 9), (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (100, [2.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.neighbours(vectors, F.col("vec_id") % 100 == 0).collect())
    # Both rows with id 0 are queries, and each finds the other.
    zero = [(0, k + 1, i, d) for k, (i, d) in enumerate([(0, 0.0), (1, 0.0), (2, 0.0), (100, 1.0)]) for _ in range(2)]
    assert got == zero + [(100, k + 1, i, 1.0) for k, i in enumerate([0, 0, 1, 2])]
    assert vptree.neighbours(vectors.where("vec_id = 4"), F.lit(True)).collect() == []
    assert vptree.neighbours(vectors.limit(0), F.lit(True)).collect() == []


def test_equal_vectors_fill_a_leaf():
    x, ids = np.ones((500, 3)), np.arange(500)
    best = vptree.search(vptree.build(x), x, ids, ids, x[:2], ids[:2], np.full(2, np.inf), 3, 1.0)
    assert best.ids.tolist() == [[1, 2, 3], [0, 2, 3]]
