"""Tables of all distances that are reduced where blocks meet, against the same results from stored tables and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import termfield.operators.distances as distances_module
from termfield.operators.distances import distances


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks of a few targets, so that small tables have many."""
    monkeypatch.setattr(distances_module, "BLOCK", 16)


def counts(spark, n=90, features=7, seed=5, copies=3):
    """Whole numbers, with targets that equal others and so tie."""
    x = np.random.default_rng(seed).integers(0, 9, (n // copies, features)).repeat(copies, 0)
    x[:, 0] += 1
    table = spark.createDataFrame([(f"t{i:03d}", f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "target string, feature string, value double")
    return table, x.astype(float), [f"t{i:03d}" for i in range(len(x))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("compact", [False, True])
def test_pairs_of_blocks_are_not_shuffled(spark, compact):
    table, x, names = counts(spark)
    found = distances(table, method="manhattan", compact=compact)
    above, product, _ = plan_of(found).partition("CartesianProduct")
    assert product and "Exchange" not in above
    far = np.abs(x[:, None] - x[None]).sum(2)
    want = {(names[i], names[j]): far[i, j] for i in range(len(x)) for j in range(len(x)) if i < j or not compact}
    got = found.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want


@pytest.mark.parametrize("method,convert", [("cosine", False), ("cosine", True), ("manhattan", True)])
def test_nearest_leave_the_tasks_alone(spark, method, convert):
    """Each task returns a few rows a term, and ties, of which there are many, go by name."""
    from termfield.operators.neighbours import nearest_neighbours
    from termfield.operators.swept import nearest, swept

    table, x, names = counts(spark)
    far = distances_module._array_distances(x, x, method, 2.0, False, convert)
    similarity = method == "cosine" and not convert
    digits = 9 if similarity else None
    want = set()
    for i, row in enumerate(far):
        order = sorted((round(-d if similarity else d, 9), names[j]) for j, d in enumerate(row) if j != i)[:4]
        want |= {(names[i], t, k + 1) for k, (_, t) in enumerate(order)}
    asked = table.select(F.col("target").alias("term")).distinct()
    got = nearest_neighbours(table, asked, 4, method=method, convert=convert, digits=digits).collect()
    assert {(r.target, r.neighbour, r["rank"]) for r in got} == want and len(got) == len(want)
    sides = distances_module.sides_of(table, None, method, 2.0, terms2="all")
    blocks = swept(sides, convert=convert)
    found = nearest(blocks, 4, similarity, False, digits)
    assert "CartesianProduct" in plan_of(found)
    held = distances_module.met(blocks.left, blocks.right, 7, lambda batches: iter(batches), "i long, a array<string>, x binary, k long, b array<string>, y binary, more string")
    assert held.select("i").distinct().count() == blocks.left.count() > 3


@pytest.mark.parametrize("name", ["pair_ranks_arithmetic", "distance_table_flags", "map_edges", "neighbours_in_matrix", "pair_ranks_in_matrix", "pairs_in_matrix", "pair_ranks_forward", "nearest_by_similarity"])
def test_queries_of_all_distances_do_not_store_them(spark, name):
    """Over many blocks they give what SQL gives, and no table of pairs is written."""
    from pathlib import Path

    import duckdb

    import termfield.queries_more  # noqa: F401
    from termfield.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    plain = lambda r: tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    want = sorted(map(plain, found.fetchall()))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://").removeprefix("//"))
    stored = lambda: set(shared.glob("distances-*"))
    before = stored()
    assert sorted(map(plain, QUERIES[name](spark, sf).select(*cols).collect())) == want and want
    assert stored() == before


@pytest.mark.parametrize("method,convert", [("cosine", False), ("manhattan", True), ("jaccard", False)])
def test_ranks_are_counted_where_blocks_meet(spark, method, convert):
    """Many ranks of one term, one rank of many, and ties; as from a stored table."""
    from termfield.operators.neighbours import as_distances, distance_table, pair_ranks_in_matrix

    table, _, names = counts(spark)
    words = [(names[0], t) for t in names] + [(t, names[(7 * i) % len(names)]) for i, t in enumerate(names)] + [("nobody", names[3])]
    pairs = spark.createDataFrame(words, "w1 string, w2 string").distinct()
    held = distance_table(table, method, convert=convert)
    stored = as_distances(distances(table, method=method, convert=convert).withColumn("distance", F.round("distance", 12)), held.similarity)
    assert held.symmetric and stored.symmetric
    for direction in ("fwd", "avg"):
        got, want = ({(r.w1, r.w2): r["rank"] for r in pair_ranks_in_matrix(pairs, m, direction).collect()} for m in (held, stored))
        assert got == want


@pytest.mark.parametrize("share", [0.0, 0.4, 2 / 3, 1.0])
def test_quantiles_from_sweeps(spark, share):
    from termfield.operators.swept import quantile, swept

    table, x, _ = counts(spark)
    far = np.abs(x[:, None] - x[None]).sum(2)[np.triu_indices(len(x), 1)]
    blocks = swept(distances_module.sides_of(table, None, "manhattan", 2.0))
    for few, ranges in ((10_000, 1 << 16), (5, 7)):
        assert quantile(blocks, share, few, ranges) == pytest.approx((np.quantile(far, share), far.min(), far.max()))


@pytest.mark.parametrize("how", ["single", "complete", "average"])
def test_trees_compare_equal_vectors_once(spark, monkeypatch, how):
    """Heights are those of merging one pair at a time, and pairs written grow with distinct vectors."""
    from termfield.operators import trees
    from termfield.operators.evaluation import linkage

    table, x, names = counts(spark, 60, copies=4)
    made = []
    real = trees.distances
    monkeypatch.setattr(trees, "distances", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    got = trees.vector_tree(table, how).collect()
    far = distances_module._array_distances(x, x, "cosine", 2.0, False, True)
    assert sorted(round(r.height, 6) for r in got) == pytest.approx(sorted(round(h, 6) for *_, h in linkage(far, how)), abs=2e-6)
    plain = trees.tree(distances(table, compact=True), how).collect()
    assert sorted((r.a, r.b, round(r.height, 6), r["size"] or 0) for r in got) == sorted((r.a, r.b, round(r.height, 6), r["size"] or 0) for r in plain)
    groups = len({tuple(v) for v in x})
    assert made[0].count() == groups * (groups - 1) // 2 < len(x) * (len(x) - 1) // 30


@pytest.mark.parametrize("method", ["metric", "ordinal", "sammon"])
def test_maps_compare_equal_vectors_once(spark, method):
    """One place for equal vectors, and the places and the stress of the map of all pairs."""
    from termfield.operators import maps

    table, x, names = counts(spark, 30, copies=3)
    whole = maps.stress_map(distances(table, compact=True), method, 4, 0.0, landmarks=12)
    few = maps.vector_map(table, method, 4, 0.0, landmarks=12)
    a, b = ({r.term: (r.x, r.y) for r in m.points.collect()} for m in (whole, few))
    assert a.keys() == b.keys() == set(names) and few.stress == pytest.approx(whole.stress, abs=1e-7)
    assert np.allclose([a[t] for t in names], [b[t] for t in names], atol=1e-5)


@pytest.mark.parametrize("how", ["complete", "average"])
@pytest.mark.parametrize("few", [0, 9, 1024])
def test_the_last_clusters_are_merged_on_the_driver(spark, monkeypatch, how, few):
    """The same merges whether all rounds, some or none are jobs; none is one job for the pairs, whatever the rounds."""
    from termfield.operators import trees

    x = np.random.default_rng(3).normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    table = spark.createDataFrame([(f"t{i:03d}", f"t{j:03d}", float(d[i, j])) for i in range(40) for j in range(i + 1, 40)], "a string, b string, distance double")
    monkeypatch.setattr(trees, "FEW", 0)
    want = sorted((r.a, r.b, round(r.height, 9), r["size"]) for r in trees.tree(table, how).collect())
    calls = []
    real = trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: calls.append(name) or real(df, name))
    monkeypatch.setattr(trees, "FEW", few)
    assert sorted((r.a, r.b, round(r.height, 9), r["size"]) for r in trees.tree(table, how).collect()) == want and len(want) == 39
    assert few < 1024 or calls.count("pairs") == 1
