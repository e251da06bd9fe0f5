import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termfield.llm import whitening
from termfield.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>"


def check(got, table):
    """Every row against exact integers and numpy; the sign of a component is free, but one for all rows."""
    kept = [(i, v) for i, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    total = [sum(c) for c in zip(*x, strict=True)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for (i, _), row in zip(kept, x, strict=True)}
    centred = np.array([[float(n * a - s) for a, s in zip(row, total, strict=True)] for row in x]) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    many = min(32, int((e > 1e-12 * e[0]).sum()), d)
    want = centred @ u / np.sqrt(np.where(e > 0, e, 1))
    assert len(got) == n * many
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(many):
        mine = np.array([by[i, k + 1].whitened for i, _ in kept])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-6
        assert abs((mine**2).mean() - 1) < 1e-9
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-4
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-8)


def test_the_query_equals_numpy(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(op12_whitening(spark, "/root/testdata/sf0.01").collect(), table)


def test_blocks_of_dimensions_equal_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 7)) @ rng.normal(size=(7, 7))
    rows = spark.createDataFrame([(x_.tolist(),) for x_ in x], "x array<double>")
    for block in (2, 3, 7, 64):
        assert np.allclose(whitening.centred_products(rows, [f"x[{i}] - {i}D" for i in range(7)], block), (x - np.arange(7)).T @ (x - np.arange(7)))


def test_edges(spark):
    rng = np.random.default_rng(2)
    table = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(30, 4)))]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [1.0, float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0, 1.0]), (104, [])]
    vectors = spark.createDataFrame([(i, v, 1.0, 2) for i, v in table + odd], SCHEMA + ", whitened double, n int")
    check(whitening.whitened(vectors).collect(), [(i, np.float32(v).tolist()) for i, v in table])
    # Repeated rows count each; a dimension without variance gives no component; a null id stays.
    flat = [(1, [1.0, 5.0]), (1, [1.0, 5.0]), (None, [2.0, 5.0])]
    got = whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.n) for r in got) == [(-1, 1, 3), (1, 1, 3), (1, 1, 3)]
    # Lengths are whitened apart.
    mixed = spark.createDataFrame([(i, v) for i, v in table] + [(50 + i, v[:2]) for i, v in table], SCHEMA)
    assert {(r["n"], r.m) for r in whitening.whitened(mixed).groupBy("vec_id", "n").agg(F.count("*").alias("m")).collect()} == {(30, 4), (30, 2)}
    for none in (vectors.where("vec_id = 1"), vectors.where("vec_id >= 100"), vectors.limit(0)):
        assert whitening.whitened(none).collect() == []
    # Large sums are exact, deviations beyond a long null.
    large = [(i, [2.0**22 * (i + 1), float(i * i)]) for i in range(3)]
    got = whitening.whitened(spark.createDataFrame(large, SCHEMA)).collect()
    check(got, large)
    many = [(i, [2.0**30 if i == 0 else -(2.0**30), 1.0]) for i in range(200)]
    assert {r.deviation for r in whitening.whitened(spark.createDataFrame(many, SCHEMA)).where("vec_id = 0").collect()} == {None}
