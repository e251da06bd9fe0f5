import math

import pytest

import termfield.operators.distances as distances_module
from goldens import CONTEXT, HIERO, TERM, model
from pyspark.sql import functions as F

from termfield.model import ModelError
from termfield.operators.contexts import composed, context_vectors
from termfield.operators.distances import distances
from termfield.operators.neighbours import averaged, nearest_neighbours, neighbourhood, neighbours_in_matrix, neighbours_of_vectors, pair_distances, pair_ranks, pairs_in_matrix
from termfield.operators.scoring import score

DOG = {
    "euclidean": [128.428969, 82.969874, 0, 89.794209, 89.325248, 131.491445, 140.424357],
    "manhattan": [290, 168, 0, 201, 179, 250, 267],
    "maximum": [74, 63, 0, 56, 69, 103, 104],
    "canberra": [4.61776, 2.710819, 0, 3.902521, 3.89142, 3.717277, 4.739122],
    ("minkowski", 3): [100.774519, 69.875425, 0, 71.053388, 75.779543, 113.428918, 120.25854],
    ("minkowski", 0.5): [40.620651, 29.74731, 0, 33.754198, 30.534245, 35.304494, 36.503296],
    "jaccard": [0.224599, 0.456311, 1, 0.357827, 0.403333, 0.193548, 0.11],
    "overlap": [0.28, 0.47, 1, 0.373333, 0.403333, 0.2, 0.11],
}


@pytest.mark.parametrize("how", DOG, ids=str)
def test_known_distances(spark, how):
    method, p = how if isinstance(how, tuple) else (how, 2)
    found = distances(model(spark, HIERO).cells, method=method, p=p, terms=["dog"], terms2="all", convert=False)
    got = {r.b: r.distance for r in found.collect()}
    assert [got[t] for t in HIERO["rows"]] == pytest.approx(DOG[how], abs=2e-6)


def small(spark, rows):
    return spark.createDataFrame([(n, str(j), float(v)) for n, vs in rows.items() for j, v in enumerate(vs) if v], "target string, feature string, value double")


def test_similarities_of_small_vectors(spark):
    t = small(spark, {"a": [0, 2, 1, 0, 1], "b": [4, 1, 3, 0, 0]})
    get = lambda **how: {(r.a, r.b): r.distance for r in distances(t, convert=False, **how).collect()}
    assert get(method="jaccard")["a", "b"] == 0.2
    over = get(method="overlap")
    assert (over["a", "b"], over["b", "a"]) == (0.5, 0.25)
    assert get(method="overlap", normalized=True) == {("a", "a"): 4, ("a", "b"): 2, ("b", "a"): 2, ("b", "b"): 8}
    assert get(method="minkowski", p=0)["a", "b"] == 4


def test_zero_vectors(spark):
    t = small(spark, {"x": [1, 1, 0]})
    info = spark.createDataFrame([("0",), ("00",), ("x",)], "term string")
    get = lambda m: {(r.a, r.b): r.distance for r in distances(t, method=m, convert=False, info=info).collect()}
    j, o, c = get("jaccard"), get("overlap"), get("cosine")
    assert (j["0", "00"], j["0", "x"], o["0", "x"], o["x", "0"]) == (1, 0, 1, 0)
    assert math.isnan(c["0", "x"]) and c["x", "x"] == 1


def test_angles_and_missing(spark):
    logs = score(model(spark, HIERO), "frequency", transform="log").scores
    got = {r.neighbour: r.distance for r in nearest_neighbours(logs, ["dog"]).collect()}
    assert got == pytest.approx(dict(cat=16.034578, pig=20.08826, cup=31.777839, boat=34.096081, banana=38.273613, knife=39.672773))
    assert distances(logs, terms=["dog"]).first().distance == 0
    with pytest.raises(ModelError, match="yyz"):
        distances(logs, terms=["dog", "yyz"])
    assert distances(logs, terms=["dog", "yyz"], skip_missing=True).count() == 1
    assert distances(logs, method="euclidean", compact=True).count() == 21
    assert distances(logs, method="manhattan", by_row=False).count() == 36


def test_neighbours(spark):
    logs = score(model(spark, HIERO), "frequency", transform="log").scores
    sims = nearest_neighbours(logs, ["dog"], 3, convert=False).orderBy("rank").collect()
    assert [(r.neighbour, round(r.distance, 6)) for r in sims] == [("cat", 0.961095), ("pig", 0.939165), ("cup", 0.850096)]
    tt = model(spark, TERM).cells
    got = neighbours_in_matrix(tt, ["time"], 3, similarity=True, symmetric=False).orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in got] == [("kill", 134), ("likely", 100), ("important", 94)]
    column = neighbours_in_matrix(tt, ["feed"], 3, similarity=True, symmetric=False, by_row=False).orderBy("rank").collect()
    assert [r.neighbour for r in column] == ["animal", "dog", "time"]
    sparse = neighbours_in_matrix(model(spark, CONTEXT).cells, ["animal"], 5, True, False, sparse=True).orderBy("rank").collect()
    assert [(r.neighbour, r.distance) for r in sparse] == [("Pet", 15), ("Feral", 10), ("Felidae", 2)]
    vec = logs.where("target = 'dog'").select(F.lit("VEC1").alias("target"), "feature", F.col("score").alias("value"))
    assert neighbours_of_vectors(vec, logs, 1).first().neighbour == "dog"
    near = neighbourhood(logs, "dog", 2)
    assert near.count() == 9 and near.where("selected").count() == 3


def test_pairs_and_ranks(spark):
    c = model(spark, CONTEXT).cells
    words = [("cat", "dog"), ("cat", "pig"), ("dog", "cat"), ("rule", "cat"), ("dog", "cause"), ("rule", "pig")]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(words)], "i int, w1 string, w2 string")
    inf = math.inf
    get = lambda df, c: [r[c] for r in df.orderBy("i").collect()]
    assert get(pair_distances(pairs, c, "manhattan"), "distance") == [24, inf, 24, inf, 32, inf]
    assert get(pair_ranks(pairs, c, "fwd", method="manhattan"), "rank") == [2, inf, 1, inf, 6, inf]
    assert get(pair_ranks(pairs, c, "bwd", method="manhattan"), "rank") == [1, inf, 2, inf, 4, inf]
    assert get(pair_ranks(pairs, c, "avg", "geometric", method="manhattan"), "rank") == pytest.approx([math.sqrt(2), inf, math.sqrt(2), inf, math.sqrt(24), inf])
    assert get(pair_distances(pairs, c, convert=False), "distance")[1] == -inf
    looked = spark.createDataFrame([(0, "cat", "Feral"), (1, "cat", "Rush"), (2, "time", "Boat"), (3, "time", "Back_Pain"), (4, "yyz", "Kant")], "i int, w1 string, w2 string")
    assert get(pairs_in_matrix(looked, c, True), "distance") == [7, -inf, 2, 0, -inf]
    means = spark.range(1).select(*[averaged(F.lit(inf), F.lit(3.0), h).alias(h) for h in ("arithmetic", "geometric", "harmonic")]).first()
    assert tuple(means) == (inf, inf, 6.0)


def test_contexts(spark):
    t = model(spark, TERM).cells
    ctx = spark.createDataFrame([(1, "cat cat dog cause cause"), (2, "nothing known"), (3, "xyz cat")], "ctx_id int, context string")
    got = context_vectors(t, ctx)
    first = {r.feature: r.value for r in got.where("ctx_id = 1").collect()}
    assert [first[f] for f in TERM["features"]] == pytest.approx([149.4, 10, 9.6, 29, 22.2, 15.2, 20.8])
    assert {r.ctx_id for r in got.collect()} == {1, 3}
    assert got.where("ctx_id = 3 and feature = 'breed'").first().value == 84
    kept = context_vectors(t, ctx, drop_missing=False)
    assert [tuple(r) for r in kept.where("ctx_id = 2").collect()] == [(2, None, 0.0)]
    bags = spark.createDataFrame([(1, {"cat": 4.0, "dog": 2.0, "cause": 4.0, "unknown": 9.0})], "ctx_id int, context map<string,double>")
    same = {r.feature: r.value for r in context_vectors(t, bags).collect()}
    assert same == pytest.approx(first)
    lists = ctx.select("ctx_id", F.split("context", " ").alias("context")).where("ctx_id = 1")
    assert {r.feature: r.value for r in context_vectors(t, lists).collect()} == pytest.approx(first)
    two = spark.createDataFrame([("x", "cat", "dog")], "name string, w1 string, w2 string")
    assert {r.feature: r.value for r in composed(t, two).collect()}["breed"] == 663
    assert {r.feature: r.value for r in composed(t, two, "multiply").collect()}["tail"] == 17 * 14


@pytest.mark.parametrize("method", distances_module.METRICS)
def test_blocks_and_joins_agree(spark, monkeypatch, method):
    """Few features are compared as arrays, many by joins: the same distances, zero vectors and unequal tables too."""
    rows = [(f"t{i}", f"f{j}", float((i * 7 + j * 3) % 5)) for i in range(9) for j in range(6) if (i + j) % 3] + [("zero", "f1", 0.0)]
    table = spark.createDataFrame(rows, "target string, feature string, value double")
    other = table.where("target < 't5'")
    get = lambda: [
        {(r.a, r.b): r.distance for r in distances(table, y, method=method, p=2.5, convert=n, normalized=n).collect()} for y, n in ((None, False), (other, True))
    ]
    dense = get()
    monkeypatch.setattr(distances_module, "DENSE", -1)
    for a, b in zip(dense, get(), strict=True):
        assert a.keys() == b.keys() and len(a) in (100, 50)
        for k, v in a.items():
            assert v == pytest.approx(b[k], abs=1e-9, nan_ok=True), k
