import numpy as np
import pytest

from termfield.model import ModelError
from termfield.operators import maps, trees
from termfield.operators.evaluation import linkage


def random_distances(seed, n, dims=3, groups=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 8 * rng.integers(groups, size=(n, 1))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def table(spark, d, half=True):
    n = len(d)
    return spark.createDataFrame([(f"t{i:03d}", f"t{j:03d}", float(d[i, j])) for i in range(n) for j in range(n) if not half or i < j], "a string, b string, distance double")


def members(merges, n):
    """Sets of terms of every merge, from (a, b, height)."""
    at = {f"t{i:03d}": {f"t{i:03d}"} for i in range(n)}
    out = []
    for a, b, h in sorted(merges, key=lambda m: m[2]):
        one, two = (next(s for s in at.values() if x in s) for x in (a, b))
        new = one | two
        for t in new:
            at[t] = new
        out.append((frozenset(new), round(h, 9)))
    return set(out)


def wanted(d, how):
    live, out = {i: {i} for i in range(len(d))}, set()
    for k, (a, b, h) in enumerate(linkage(d, how)):
        live[len(d) + k] = live.pop(a) | live.pop(b)
        out.add((frozenset(f"t{i:03d}" for i in live[len(d) + k]), round(h, 9)))
    return out


@pytest.mark.parametrize("how", ["single", "complete", "average"])
def test_trees_equal_merging_one_pair_at_a_time(spark, how):
    d = random_distances(4, 40, groups=3)
    merges = trees.tree(table(spark, d), how).collect()
    assert len(merges) == 39 and members([(m.a, m.b, m.height) for m in merges], 40) == wanted(d, how)
    if how != "single":
        assert max(m["size"] for m in merges) == 40 and sum(m["size"] == 2 for m in merges) > 5


@pytest.mark.parametrize("how", ["single", "complete"])
def test_cut(spark, how):
    d = random_distances(6, 30, groups=3)
    merges = trees.tree(table(spark, d, half=False), how)
    terms = spark.createDataFrame([(f"t{i:03d}",) for i in range(30)] + [("zzz",)], "term string")
    for k in (1, 4):
        got = {}
        for r in trees.cut(merges, terms, k).collect():
            got.setdefault(r.cluster, set()).add(r.term)
        live = {i: {i} for i in range(30)}
        for step, (a, b, _) in enumerate(linkage(d, how)[: 30 - k]):
            live[30 + step] = live.pop(a) | live.pop(b)
        assert {frozenset(s) for s in got.values()} == {frozenset(f"t{i:03d}" for i in s) for s in live.values()} | {frozenset(["zzz"])}
        assert all(min(s) == c for c, s in got.items())


def test_ties_chains_and_small_tables(spark):
    # A chain, where rounds are many, and all distances equal.
    n = 12
    at = 1.37 ** np.arange(n)
    line = np.abs(at[:, None] - at[None])
    for how in trees.LINKAGES:
        assert sorted(round(r.height, 9) for r in trees.tree(table(spark, line), how).collect()) == sorted(round(h, 9) for *_, h in linkage(line, how))
        equal = trees.tree(table(spark, np.ones((7, 7)) - np.eye(7)), how).collect()
        assert [r.height for r in equal] == [1.0] * 6
        assert trees.tree(table(spark, np.zeros((1, 1))), how).collect() == []
    with pytest.raises(ModelError):
        trees.tree(table(spark, line).where("a != 't003' or b != 't005'"), "complete")


def plain_stress(d, xy, weights):
    far = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    return np.sqrt((weights * (d - far) ** 2).sum() / (weights * d * d).sum())


def majorised(d, xy, rounds):
    """Plain stress majorisation on one machine."""
    for _ in range(rounds):
        far = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        b = -np.divide(d, far, out=np.zeros_like(d), where=far > 0)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        xy = b @ xy / len(d)
    return xy


def points(m, n):
    at = {r.term: (r.x, r.y) for r in m.points.collect()}
    return np.array([at[f"t{i:03d}"] for i in range(n)])


def test_metric_map_equals_plain_majorisation(spark):
    d = random_distances(2, 25, 4)
    m = maps.stress_map(table(spark, d), rounds=4, tol=0.0)
    start, _ = maps.classical(d)
    xy = points(m, 25)
    assert np.allclose(xy - xy.mean(0), majorised(d, start, 4), atol=1e-9)
    assert m.stress[0] == pytest.approx(plain_stress(d, start, 1.0)) and m.stress[-1] == pytest.approx(plain_stress(d, xy, 1.0))
    assert all(b <= a + 1e-12 for a, b in zip(m.stress, m.stress[1:])) and m.stress[-1] < m.stress[0]


@pytest.mark.parametrize("method", maps.METHODS)
def test_stress_never_rises_from_landmarks(spark, method):
    d = random_distances(7, 40, 5, groups=2)
    m = maps.stress_map(table(spark, d, half=False), method, rounds=6, tol=0.0, landmarks=12)
    assert len(m.stress) == 7 and all(b <= a + 1e-9 for a, b in zip(m.stress, m.stress[1:]))
    xy = points(m, 40)
    assert np.isfinite(xy).all()
    if method == "sammon":
        w = np.divide(1, d, out=np.zeros_like(d), where=d > 0)
        assert m.stress[-1] == pytest.approx(plain_stress(d, xy, w))
    if method == "metric":
        longer = maps.stress_map(table(spark, d), rounds=25, landmarks=12)
        assert longer.stress[-1] <= plain_stress(d, maps.classical(d)[0], 1.0)


def test_pooling():
    assert maps.pooled(np.array([1, 1, 1, 1.0]), np.array([1, 3, 2, 4.0])).tolist() == [1, 2.5, 2.5, 4]
    assert maps.pooled(np.array([0, 2, 0, 1.0]), np.array([0, 6, 0, 1.0])).tolist() == pytest.approx([7 / 3] * 4)
    rng = np.random.default_rng(1)
    c, s = rng.integers(1, 5, 50).astype(float), rng.normal(size=50).cumsum()
    got = maps.pooled(c, s)
    assert (np.diff(got) >= -1e-12).all() and (got * c).sum() == pytest.approx(s.sum())
    # No other rising values are nearer: moving along any rising direction does not help.
    for i in range(1, 50):
        assert ((s / c - got)[i:] * c[i:]).sum() <= 1e-9


def test_small_maps(spark):
    assert maps.stress_map(table(spark, np.zeros((1, 1)))).stress == []
    two = maps.stress_map(table(spark, np.array([[0, 3.0], [3, 0]])))
    assert two.stress[-1] < 1e-9
    flat = maps.stress_map(table(spark, np.zeros((4, 4))), "sammon")
    assert flat.stress[-1] == 0.0
