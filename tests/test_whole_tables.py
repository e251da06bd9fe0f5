"""Queries that take every supplier, on a table with more of them than any id list names."""

import duckdb
import numpy as np
import pytest

from termfield.operators import evaluation as ev
from termfield.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_clustering_takes_all_suppliers(spark):
    got = QUERIES["clustering"](spark, SF).collect()
    want = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert len(got) == len({r.word for r in got}) == want > 60
    assert len({r.cluster for r in got if not r.missing}) == 8


@pytest.mark.parametrize("k", [1, 3, 5])
def test_medoids_in_spark_are_those_of_the_matrix(spark, k):
    x = np.random.default_rng(k).normal(size=(25, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    table = spark.createDataFrame([(f"w{i:02}", f"w{j:02}", float(d[i, j])) for i in range(25) for j in range(25)], "a string, b string, distance double")
    got = {r.w: r.cluster for r in ev.medoid_clusters(table, k).collect()}
    assert [got[f"w{i:02}"] for i in range(25)] == [str(c + 1) for c in ev.pam(d, k)]


@pytest.mark.parametrize("name", ["distance_manhattan", "nearest_neighbours", "pair_ranks_forward", "pair_ranks_harmonic"])
def test_every_supplier_is_compared(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    found = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    plain = lambda r: tuple(float(v) if isinstance(v, (int, float)) else v for v in r)
    want = sorted(map(plain, found.fetchall()))
    assert sorted(map(plain, QUERIES[name](spark, SF).select(*cols).collect())) == want and want
