import math

import numpy as np
import pytest
from goldens import HIERO, TERM, model

from termfield.operators import evaluation as ev
from termfield.operators.distances import distances
from termfield.operators.projection import fold_in, project
from termfield.operators.scoring import score

CHOICES = [
    ("dog", "cat", "reason", "time"), ("cat", "time", "dog", "animal"), ("cat", "animal", "cause", "reason"), ("dog", "reason", "animal", "cause"), ("cause", "effect", "dog", "cat"),
]


def test_multiple_choice(spark):
    logs = score(model(spark, TERM), "frequency", transform="log").scores
    task = spark.createDataFrame([*CHOICES, ("x", "y", "z", "cat")], "target string, correct string, distract1 string, distract2 string")
    got = ev.multiple_choice_details(task, logs).orderBy("item").collect()
    assert [r.correct for r in got] == [True, False, True, False, True, None]
    total = ev.multiple_choice(task, logs).first()
    assert (total.tp, total.fp, total.missing, round(total.accuracy, 4)) == (3, 3, 1, 50.0)
    tie = spark.createDataFrame([("dog", "cat", "cat")], "target string, correct string, distract1 string")
    assert ev.multiple_choice_details(tie, logs).first().correct is False


def test_correlation(spark):
    rows = [(1.0, 10.0, False), (2.0, 7.0, False), (3.0, 8.0, False), (4.0, 3.0, False), (5.0, 1.0, True), (5.0, 2.0, False)]
    got = ev.correlation(spark.createDataFrame(rows, "score double, distance double, missing boolean"))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert got.r == pytest.approx(abs(np.corrcoef(x, y)[0, 1]))
    ranks = np.array([1, 2, 3, 4, 5.5, 5.5])
    assert got.rho == pytest.approx(abs(np.corrcoef(ranks, np.argsort(np.argsort(y)) + 1)[0, 1]))
    assert got.missing == 1 and got.r_lower < got.r < got.r_upper
    # Student's distribution with one degree of freedom is Cauchy's, with two it is algebraic.
    for t in (0.1, 1.0, 7.0):
        assert ev.student_tail(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi)
        assert ev.student_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t))


def test_unknown_words_lie_beyond_the_range(spark):
    logs = score(model(spark, TERM), "frequency", transform="log").scores
    task = spark.createDataFrame([("cat", "dog", 5.0), ("cat", "time", 1.0), ("cat", "zzz", 0.0)], "word1 string, word2 string, score double")
    got = {r.word2: r for r in ev.rated_distances(task, logs).collect()}
    span = got["time"].distance - got["dog"].distance
    assert got["zzz"].missing and got["zzz"].distance == pytest.approx(got["time"].distance + span * 0.1)
    sims = {r.word2: r.distance for r in ev.rated_distances(task, logs, convert=False).collect()}
    assert sims["zzz"] < sims["time"] < sims["dog"]


def test_clustering(spark):
    t = spark.createDataFrame([(w, f, v) for w, f, v in [("a", "x", 1.0), ("b", "x", 1.1), ("c", "y", 1.0), ("d", "y", 2.0), ("e", "y", 1.0), ("e", "x", 0.1)]], "target string, feature string, value double")
    task = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "q"), ("e", "p"), ("zz", "q")], "word string, class string")
    got = {r.word: r for r in ev.clustering_details(task, t).collect()}
    assert got["a"].cluster == got["b"].cluster != got["c"].cluster == got["d"].cluster == got["e"].cluster
    assert got["zz"].cluster == "n/a" and got["zz"].missing and got["zz"].correct and not got["e"].correct
    one = ev.clustering(task, t).first()
    assert one.purity == pytest.approx(100 * 5 / 6) and one.missing == 1
    assert one.entropy == pytest.approx(0.5 * -(1 / 3 * math.log2(1 / 3) + 2 / 3 * math.log2(2 / 3)))
    scaled = ev.clustering(task, t, scale_entropy=True).first()
    assert scaled.entropy == pytest.approx(one.entropy)


def test_pam_finds_the_best_medoids():
    rng = np.random.default_rng(0)
    from itertools import combinations

    for k in (1, 2, 3):
        x = rng.normal(size=(9, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        own = ev.pam(d, k)
        cost = sum(min(d[np.ix_(own == c, own == c)].sum(0)) for c in range(k))
        best = min(d[:, list(m)].min(1).sum() for m in combinations(range(9), k))
        assert cost <= best * 1.1


def test_linkage_and_maps(spark):
    d = np.array([[0, 1, 5.0], [1, 0, 4], [5, 4, 0]])
    assert ev.linkage(d) == [(0, 1, 1.0), (2, 3, 5.0)]
    assert ev.linkage(d, "single")[1][2] == 4
    found = distances(model(spark, HIERO).cells, method="euclidean")
    xy = {r.term: (r.x, r.y) for r in ev.scaled_map(found).collect()}
    assert len(xy) == 7 and abs(sum(x for x, _ in xy.values())) < 1e-6
    edges = ev.map_edges(found).collect()
    assert 0 < len(edges) < 21 and all(0 <= e.strength <= 1 for e in edges)


SIGMA = [215.771063, 79.979858, 52.961178, 30.32527, 22.853692, 11.413637]


def matrix(p):
    return {r.term: np.array(r.vec) for r in p.vectors.collect()}


@pytest.mark.parametrize("method", ["svd", "rsvd"])
def test_singular_values(spark, method):
    h = model(spark, HIERO)
    p = project(h, 6, method, with_basis=True)
    assert p.sigma == pytest.approx(SIGMA, rel=1e-5)
    assert p.r2.sum() == pytest.approx(1)
    vec = matrix(p)
    for a, b in (("dog", "cat"), ("knife", "cup")):
        x, y = np.array(HIERO["rows"][a], float), np.array(HIERO["rows"][b], float)
        assert np.linalg.norm(vec[a] - vec[b]) == pytest.approx(np.linalg.norm(x - y))
    again = {r.term: np.array(r.vec) for r in fold_in(h.cells, p.basis).collect()}
    assert np.abs(again["dog"] - vec["dog"]).max() < 1e-6


def test_power_and_rank(spark):
    h = model(spark, HIERO)
    white = np.array(list(matrix(project(h, 3, power=0)).values()))
    assert np.abs(white.T @ white - np.eye(3)).max() < 1e-6
    z = score(h, "z-score", sparse=False, negative_ok=True, scale="center")
    p = project(z, 6)
    assert p.sigma[:5] == pytest.approx([17.65893, 12.196833, 11.334865, 7.36394, 4.213618], rel=1e-4) and len(p.sigma) == 5
    assert p.r2[:3] == pytest.approx([0.471723, 0.225036, 0.194353], abs=1e-4)
    with pytest.raises(ValueError, match="dimensions"):
        project(h, 7)


def test_subspace_iteration_without_the_whole_cross_product(spark, monkeypatch):
    import termfield.operators.projection as pr

    monkeypatch.setattr(pr, "EXACT", 0)
    assert project(model(spark, HIERO), 3).sigma == pytest.approx(SIGMA[:3], rel=1e-5)


def test_random_indexing(spark):
    rng = np.random.default_rng(1)
    rows = {f"t{i}": rng.random(200) * (rng.random(200) < 0.3) for i in range(12)}
    t = spark.createDataFrame([(n, f"f{j}", float(v)) for n, vs in rows.items() for j, v in enumerate(vs) if v], "target string, feature string, f double")
    from termfield.model import from_triplets

    m = from_triplets(t)
    vec = matrix(project(m, 80, "ri", rate=0.1))
    far = [(np.linalg.norm(vec[a] - vec[b]), np.linalg.norm(rows[a] - rows[b])) for a in vec for b in vec if a < b]
    # Dimensions have unit length, so distances shrink with the share of dimensions.
    ratio = np.array([x / y for x, y in far]) / np.sqrt(80 / 200)
    assert abs(ratio.mean() - 1) < 0.15 and ratio.std() < 0.2
    assert project(m, 5, "ri+svd", rate=0.1).vectors.count() == 12
    with pytest.raises(ValueError, match="no sense"):
        project(m, 150, "ri")
    assert project(m, 4, "asvd").vectors.count() == 12
