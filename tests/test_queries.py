"""Registered queries against the same results in SQL, on the smallest tables."""

import hashlib

import duckdb
import numpy as np
import pytest

import termfield.queries_more  # noqa: F401  (adds its queries)
import termfield.queries_space  # noqa: F401
from termfield.operators import scoring
from termfield.queries import ORACLE_SQL, QUERIES, months

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(map(number, r))) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in ORACLE_SQL:
        # Clustering is tested in test_whole_tables, the others here below or beside their operators.
        elsewhere = {"tree_complete", "tree_average", "map_stress", "medoids_sampled", "word_senses", "graph_whispers", "project_nonnegative"}
        assert got and name in elsewhere | {"clustering", "project_svd", "project_random_indexing"}
        return
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert plain(got) == plain(want)


def test_svd_is_that_of_the_matrix(spark):
    scores = scoring.score(months(spark, SF), "MI", normalize_rows=True).scores.toPandas()
    m = scores.pivot(index="target", columns="feature", values="score").fillna(0.0)
    u, s, _ = np.linalg.svd(m.to_numpy(), full_matrices=False)
    got = QUERIES["project_svd"](spark, SF).toPandas().pivot(index="target", columns="feature", values="value").loc[m.index]
    assert np.allclose(np.abs(u[:, :5] * s[:5]), got[[f"svd{k + 1}" for k in range(5)]].to_numpy(), atol=1e-5)


def test_random_indexing_is_a_sum_of_drawn_dimensions(spark):
    scores = [tuple(r) for r in scoring.score(months(spark, SF), "MI").scores.collect()]
    unit = np.sqrt(20 / (len({f for _, f, _ in scores}) * 2))
    want: dict[str, np.ndarray] = {}
    for target, feature, value in scores:
        v = want.setdefault(target, np.zeros(20))
        for d in (0, 1):
            h = hashlib.md5(f"42 {d} {feature}".encode()).hexdigest()
            v[d * 10 + int(h[:12], 16) % 10] += (value if h[12] < "8" else -value) * unit
    got = {r.term: r.vec for r in QUERIES["project_random_indexing"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in want)


def test_trees_equal_linkage_of_all_pairs(spark):
    from termfield.operators.evaluation import linkage

    d = months(spark, SF).cells.toPandas().pivot(index="target", columns="feature", values="f").fillna(0.0).to_numpy(float)
    size = np.sqrt((d * d).sum(1))
    angles = np.degrees(np.arccos(np.clip(d @ d.T / np.outer(size, size), -1, 1)))
    for how in ("complete", "average"):
        got = [r.height for r in QUERIES[f"tree_{how}"](spark, SF).collect()]
        assert sorted(got) == pytest.approx(sorted(h for *_, h in linkage(angles, how)), abs=1e-5)


def test_sampled_medoids_are_near_the_best(spark):
    """All parts: with a sample that holds them all, the query's clusters cost what exact partitioning costs."""
    from termfield.operators.distances import _array_distances
    from termfield.operators.evaluation import pam

    con = duckdb.connect()
    t = con.sql(f"SELECT 'p' || l_partkey AS target, strftime(l_shipdate, '%Y-%m') AS feature, sum(l_quantity) AS f FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").df()
    m = t.pivot(index="target", columns="feature", values="f").fillna(0.0)
    d = _array_distances(m.to_numpy(), m.to_numpy(), "cosine", 2.0, False, True)
    np.fill_diagonal(d, 0.0)
    labels = pam(d, 20)
    best = sum(d[np.ix_(o, o)].sum(1).min() for o in (np.flatnonzero(labels == c) for c in set(labels)))
    rows = QUERIES["medoids_sampled"](spark, SF).collect()
    assert len(rows) == len(m) and sum(r.distance for r in rows) <= 1.02 * best


def test_the_rest_works_without_the_subpackage(tmp_path):
    """Without the llm folder and the pipeline, the entry point still imports and has the library's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "termfield", tmp_path / "termfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
