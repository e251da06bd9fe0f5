import math

import pytest
from goldens import CONTEXT, HIERO, TERM, model, row
from pyspark.sql import functions as F

from termfield.model import ModelError, from_triplets
from termfield.operators.norms import normalize, norms, scale_margins
from termfield.operators.scoring import score

SIGNED = {
    "t-score": [-0.906647, 1.086643, -9.461218, 3.823459, 1.896161, -1.165211],
    "simple-ll": [-0.78502, 1.300134, -34.354702, 26.187144, 4.817341, -1.208274],
    "log-likelihood": [-1.914824, 2.575289, -49.580302, 52.55026, 8.227435, -1.827845],
    "chi-squared": [-1.715674, 2.358674, -38.936463, 55.062032, 7.981075, -1.41414],
}
SPARSE = {
    "MI": [0, 0.18441, 0, 1.310986, 0.588668, 0],
    "t-score": [0, 1.093169, 0, 3.868709, 1.924677, 0],
    "z-score": [0, 1.165317, 0, 6.093814, 2.360267, 0],
    "Dice": [0.329513, 0.311445, 0.046296, 0.237288, 0.178378, 0.091892],
    "tf.idf": [0, 0, 0, 12.082647, 4.406536, 11.783502],
}


@pytest.mark.parametrize("measure", SPARSE)
def test_sparse(spark, measure):
    got = score(model(spark, HIERO), measure).scores
    assert row(got, "dog", HIERO["features"]) == pytest.approx(SPARSE[measure], abs=2e-6)


@pytest.mark.parametrize("measure", SIGNED)
def test_signed(spark, measure):
    h = model(spark, HIERO)
    signed = row(score(h, measure, sparse=False, negative_ok=True).scores, "dog", HIERO["features"])
    assert signed == pytest.approx(SIGNED[measure], abs=2e-6)
    if measure != "t-score":
        assert row(score(h, measure).scores, "dog", HIERO["features"]) == pytest.approx([max(0, x) for x in signed], abs=2e-6)


def test_external_marginals(spark):
    got = row(score(model(spark, TERM), "MI", sparse=False).scores, "cat", TERM["features"])
    assert got == pytest.approx([6.206949, 4.567843, 3.128932, 2.80084, -math.inf, 0.018232, -math.inf], abs=1e-5)
    assert row(score(model(spark, TERM), "MI").scores, "reason", TERM["features"]) == pytest.approx([0, 0, 0, 0, 1.472, 4.0368, 2.886], abs=1e-3)


def test_own_measure_and_names(spark):
    h = model(spark, HIERO)
    own = score(h, lambda t: F.log2(t.O / t.E)).scores
    assert row(own, "dog", HIERO["features"]) == pytest.approx(SPARSE["MI"], abs=2e-6)
    assert row(score(h, "log-l").scores, "dog", HIERO["features"])[3] == pytest.approx(52.55026)
    with pytest.raises(ValueError, match="measure"):
        score(h, "z")
        score(h, "s-core")
    four = score(h, lambda t: t.O11 + t.O12 + t.O21 + t.O22 - t.E11 - t.E12 - t.E21 - t.E22 + 1).scores
    assert {round(r.score, 6) for r in four.collect()} == {1.0}


def test_refusals(spark):
    h = model(spark, HIERO)
    locked = h.replaced(globals={**h.globals, "locked": True})
    with pytest.raises(ModelError):
        score(locked, "MI")
    score(locked, "frequency")
    with pytest.raises(ModelError):
        score(h, "reweight")
    with pytest.raises(ValueError, match="transform"):
        score(h, transform="square")
    with pytest.raises(ModelError):
        score(from_triplets(h.cells, raw=False), "MI")


def test_scaling(spark):
    h = model(spark, HIERO)
    for how in ("standardize", "center", "scale"):
        table = score(h, "frequency", scale=how).scores
        stats = table.groupBy("feature").agg(F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("q"), F.count("*").alias("n")).collect()
        for r in stats:
            if how != "scale":
                assert r.n == 7 and abs(r.s) < 1e-9
            if how != "center":
                assert r.q == pytest.approx(6)


def test_norms(spark):
    h = model(spark, HIERO)
    got = {r.term: r.norm for r in norms(h.cells).collect()}
    want = dict(zip(HIERO["rows"], [100.329457, 82.534841, 152.826699, 74.478185, 99.201814, 35.44009, 21.283797], strict=True))
    assert got == pytest.approx(want)
    logs = score(model(spark, TERM), "frequency", transform="log").scores
    got = {r.term: round(r.norm, 2) for r in norms(logs).collect()}
    assert [got[t] for t in TERM["rows"]] == [6.90, 8.96, 8.82, 10.29, 8.13, 6.86, 6.52]
    assert {r.term: r.norm for r in norms(h.cells, method="minkowski", p=0).collect()}["knife"] == 4
    assert norms(h.cells, "feature", "minkowski", math.inf).where("term = 'get'").first().norm == 115
    with pytest.raises(ValueError, match="p must"):
        norms(h.cells, method="minkowski", p=-1)


def test_normalize_and_margins(spark):
    h = model(spark, HIERO)
    for p in (0.5, 1, 3):
        unit = normalize(h.cells, "target", "minkowski", p)
        assert {round(r.norm, 6) for r in norms(unit, method="minkowski", p=p).collect()} == {1.0}
    small = spark.createDataFrame([("a", "x", 1e-9), ("b", "x", 2.0)], "target string, feature string, value double")
    assert {r.target: r.value for r in normalize(small).collect()} == {"a": 0.0, "b": 1.0}
    weights = spark.createDataFrame([(t, 2.0) for t in HIERO["rows"]], "term string, weight double")
    twice = scale_margins(h.cells, weights, 0.5)
    assert {(r.target, r.feature): r.value for r in twice.collect()} == {(r.target, r.feature): r.f for r in h.cells.collect()}


def test_context_model(spark):
    c = model(spark, CONTEXT)
    assert {r.term: r.nnzero for r in c.rows.collect()} == dict(zip(CONTEXT["rows"], [3, 3, 3, 4, 4, 4, 2], strict=True))
    assert {r.term: r.nnzero for r in c.cols.collect()} == dict(zip(CONTEXT["features"], [3, 4, 3, 4, 3, 4, 2], strict=True))
