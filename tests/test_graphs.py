import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termfield.model import ModelError, from_triplets
from termfield.operators import graphs, nonnegative
from termfield.operators.projection import fold_in


def plain(edges, rounds, seed):
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a], near[b]
        if a != b and w > 0:
            near[a][b] += w
            near[b][a] += w
    label = {t: t for t in near}
    crc = lambda *x: zlib.crc32(" ".join(map(str, x)).encode())
    for k in range(rounds):
        to = {}
        for t, ns in near.items():
            said = defaultdict(float)
            for b, w in ns.items():
                said[label[b]] += w
            to[t] = max(said, key=lambda x: (round(said[x], 9), -crc(seed, x), x)) if said else label[t]
        restless = any(to[t] != label[t] for t in near)
        label = {t: to[t] if crc(seed, k, t) % 2 == 0 else label[t] for t in near}
        if not restless:
            break
    first = {}
    for t in sorted(label):
        first.setdefault(label[t], t)
    return {t: first[x] for t, x in label.items()}


def test_planted_groups_are_found_as_by_a_plain_run(spark):
    rng = np.random.default_rng(3)
    edges = [(f"t{i:02d}", f"t{j:02d}", round(float(rng.random()), 3)) for i in range(60) for j in range(i) if rng.random() < (0.6 if i % 3 == j % 3 else 0.02)]
    edges += [("hub", f"t{i:02d}", 0.01) for i in range(60)] + [("alone", "alone", 1.0), ("weak", "t00", 0.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    got = {r.term: r.cluster for r in graphs.whispers(df, 30, 7).collect()}
    assert got == plain(edges, 30, 7)
    assert len({got[f"t{i:02d}"] for i in range(60)}) == 3 and all(got[f"t{i:02d}"] == got[f"t{i % 3:02d}"] for i in range(60))
    assert got["alone"] == "alone" and got["weak"] == "weak"
    assert graphs.whispers(df.limit(0)).collect() == []


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=700) ** 3, np.repeat([1.0, 2.0, 2.0, 9.0], 50), np.array([5.0]), np.r_[np.zeros(300), 1e-300, 1e300], rng.integers(0, 9, 400).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        want = df.where("not isnan(x)").agg(*[F.percentile("x", F.lit(q)) for q in (0.0, 0.25, 2 / 3, 1.0)]).first()
        got = [graphs.exact_quantile(df, "x", q, few=20, ranges=16) for q in (0.0, 0.25, 2 / 3, 1.0)]
        assert got == pytest.approx(list(want), rel=1e-12, abs=1e-300)
    assert graphs.exact_quantile(df.limit(0), "x", 0.5) is None


def test_non_negative_reduction(spark):
    rng = np.random.default_rng(2)
    m = rng.gamma(1.0, size=(40, 3)) @ rng.gamma(0.5, size=(3, 25)) * (rng.random((40, 25)) < 0.9)
    rows = [(f"t{i:02d}", f"f{j:02d}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    model = from_triplets(spark.createDataFrame(rows, "target string, feature string, f double"))
    got = nonnegative.reduce(model, 3, rounds=6, tol=0.0, block=16)
    assert len(got.errors) == 7 and all(b <= a * (1 + 1e-12) for a, b in zip(got.errors, got.errors[1:]))
    w, h = {r.term: r.vec for r in got.vectors.collect()}, {r.feature: r.vec for r in got.basis.collect()}
    w, h = np.array([w[f"t{i:02d}"] for i in range(40)]), np.array([h[f"f{j:02d}"] for j in range(25)])
    assert (w >= 0).all() and (h >= 0).all()
    assert ((m - w @ h.T) ** 2).sum() == pytest.approx(got.errors[-1], rel=1e-8)
    u, s, vt = np.linalg.svd(m)
    assert got.errors[-1] < 3 * (s[3:] ** 2).sum() + 0.05 * (m**2).sum()
    # One round by hand from where the last but one ended gives the last.
    one = nonnegative.reduce(model, 3, rounds=1, tol=0.0, block=16)
    none = nonnegative.reduce(model, 3, rounds=0, block=16)
    w0, h0 = (np.array([r.vec for r in t.orderBy(t.columns[0]).collect()]) for t in (none.vectors, none.basis))
    w1 = w0 * (m @ h0) / (w0 @ (h0.T @ h0))
    h1 = h0 * (m.T @ w1) / (h0 @ (w1.T @ w1))
    assert np.allclose([r.vec for r in one.vectors.orderBy("term").collect()], w1) and np.allclose([r.vec for r in one.basis.orderBy("feature").collect()], h1)
    assert fold_in(model.cells.limit(50), got.basis).count() > 0
    with pytest.raises(ModelError):
        nonnegative.reduce(from_triplets(spark.createDataFrame([("a", "b", -1.0), ("a", "c", 1.0)], "target string, feature string, f double"), raw=False), 1)


def test_the_query_equals_a_plain_run(spark):
    import duckdb

    from termfield.queries_space import graph_whispers

    sf = "/root/testdata/sf0.001"
    t = duckdb.sql(f"SELECT 's' || l_suppkey AS t, strftime(l_shipdate, '%Y-%m') AS m, sum(l_quantity) AS f FROM '{sf}/lineitem.parquet' GROUP BY 1, 2").df().pivot(index="t", columns="m", values="f").fillna(0.0)
    x = t.to_numpy()
    cos = x @ x.T / np.outer(*[np.sqrt((x * x).sum(1))] * 2)
    edges = [(t.index[i], t.index[j], cos[i, j]) for i in range(len(t)) for j in sorted(set(range(len(t))) - {i}, key=lambda j: (-cos[i, j], t.index[j]))[:5]]
    assert {r.term: r.cluster for r in graph_whispers(spark, sf).collect()} == plain(edges, 30, 42)
