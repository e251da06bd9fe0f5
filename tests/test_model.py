import pytest
from goldens import CONTEXT, HIERO, model, triplets
from pyspark.sql import functions as F

from termfield.model import ModelError, from_dense, from_triplets, to_arrays
from termfield.operators.binding import add_counts, bind_cols, bind_rows, merge, vocabulary
from termfield.operators.filters import convert_lemma, match_split, prefix_search, subset


def dense(df, value="f"):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_marginals_and_duplicates(spark):
    h = model(spark, HIERO)
    assert h.N == 957
    assert {r.term: r.f for r in h.rows.collect()} == dict(knife=158, cat=150, dog=300, boat=125, cup=121, pig=70, banana=33)
    twice = from_triplets(triplets(spark, HIERO).union(triplets(spark, HIERO)))
    assert twice.N == 2 * 957 and twice.cells.count() == h.cells.count()
    assert h.dim() == (7, 6) and h.check() is h
    assert [r.term for r in h.labels()[0].collect()] == list(HIERO["rows"])


def test_from_dense_and_back(spark):
    table = spark.createDataFrame(list(HIERO["rows"].items()), "term string, vec array<int>")
    m = from_dense(table, HIERO["features"])
    assert dense(m.cells) == dense(model(spark, HIERO).cells)
    cols = model(spark, HIERO).cols
    order = [HIERO["features"].index(r.term) for r in cols.orderBy("ord").collect()]
    back = {r.term: r.vec for r in to_arrays(m.cells, cols).collect()}
    assert back == {t: [float(v[k]) for k in order] for t, v in HIERO["rows"].items()}
    with pytest.raises(ModelError):
        from_dense(table, ["one"])


def test_info_tables(spark):
    few = spark.createDataFrame([("cat", 5.0)], "term string, f double")
    with pytest.raises(ModelError, match="dog"):
        from_triplets(triplets(spark, HIERO), rowinfo=few)
    more = spark.createDataFrame([(t, 1.0, "x") for t in [*HIERO["rows"], "unused"]], "term string, f double, kind string")
    m = from_triplets(triplets(spark, HIERO), rowinfo=more)
    assert m.dim()[0] == 7 and "kind" in m.rows.columns and "nnzero" in m.rows.columns


def test_check_finds_faults(spark):
    h = model(spark, HIERO)
    with pytest.raises(ModelError, match="lack"):
        h.replaced(rows=h.rows.where("term != 'dog'")).check()
    with pytest.raises(ModelError, match="repeat"):
        h.replaced(rows=h.rows.union(h.rows)).check()
    with pytest.raises(ModelError, match="sample size"):
        h.replaced(globals={}).check()
    with pytest.raises(ModelError, match="negative"):
        h.replaced(cells=h.cells.withColumn("f", -F.col("f"))).check()


def test_views(spark):
    h = model(spark, HIERO)
    assert dense(h.head(2, 3)) == {("knife", "get"): 51, ("knife", "see"): 20, ("knife", "use"): 84, ("cat", "get"): 52, ("cat", "see"): 58, ("cat", "use"): 4}
    assert h.transposed().dim() == (6, 7)
    got = h.sign_count().first()
    assert (got.pos, got.zero, got.neg) == (35, 7, 0) and h.nonneg()
    new = h.rows.select(F.col("term").alias("old"), F.upper("term").alias("new"))
    assert "DOG" in {r.target for r in h.renamed(rows=new).cells.collect()}
    assert "7 targets x 6 features" in str(h)


def test_subset(spark):
    c = model(spark, CONTEXT)
    part = subset(c, "length(term) <= 4 and nnzero <= 3", "nnzero >= 0")
    assert {r.term for r in part.rows.collect()} == {"cat", "dog"}
    one = subset(c, "length(term) <= 4", "nnzero >= 2")
    assert one.dim() == (3, 7)
    assert subset(c, "length(term) <= 4", "nnzero >= 2", recursive=True).dim() == (3, 4)
    assert subset(c, "nnzero <= 3", "nnzero <= 3", drop_zeroes=True).dim() == (3, 2)
    assert {r.term: r.f for r in one.rows.collect()} == {r.term: r.f for r in c.rows.collect() if r.term in ("cat", "dog", "time")}
    assert subset(c, "f > N / 4").rows.count() == len([r for r in c.rows.collect() if r.f > c.N / 4])
    with pytest.raises(ValueError, match="together"):
        subset(c, "true", recursive=True, matrix_only=True)


def test_matches_lemmas_prefixes(spark):
    t = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("a", "x", 5)], "v string, g string, at int")
    assert [tuple(r) for r in match_split(t, "v", "g", "at").collect()] == [("a", 3, 1)]
    lemmas = spark.createDataFrame([("Walk_V",), ("Foo_X",)], "l string")
    got = {f: [r[0] for r in lemmas.select(convert_lemma("l", f)).collect()] for f in ("CWB", "BNC", "DM", "HW", "HWLC")}
    assert got == {"CWB": ["Walk_V", "Foo_X"], "BNC": ["walk_VERB", "foo_UNC"], "DM": ["Walk-v", "Foo-x"], "HW": ["Walk", "Foo"], "HWLC": ["walk", "foo"]}
    bad = spark.createDataFrame([("walk",)], "l string").select(convert_lemma("l", "HW", strict=False))
    assert bad.first()[0] is None
    terms = spark.createDataFrame([("cat",), ("cats",), ("dog",)], "term string")
    found = {k: [r.term for r in prefix_search(terms, k).collect()] for k in ("cat%", "cat", "ca", "")}
    assert found == {"cat%": ["cat", "cats"], "cat": ["cat"], "ca": ["cat", "cats"], "": []}


def test_binding(spark):
    h = model(spark, HIERO)
    a, b = subset(h, "term in ('cat', 'dog')"), subset(h, "term in ('pig')")
    both = bind_rows([a, b])
    assert both.dim() == (3, 6) and not both.locked
    with pytest.raises(ModelError, match="share"):
        bind_rows([a, a])
    named = bind_rows([a, a], [".1", ".2"])
    assert {r.term for r in named.rows.collect()} == {"cat.1", "dog.1", "cat.2", "dog.2"} and "orig_term" in named.rows.columns
    other = from_triplets(b.cells.withColumn("target", F.lit("x")))
    assert bind_rows([a, other.replaced(cols=h.cols.withColumn("f", F.col("f") + 1))]).locked
    with pytest.raises(ModelError, match="different features"):
        bind_rows([a, subset(b, None, "term = 'get'")])
    merged = merge([a, subset(b, None, "term in ('get', 'see')")])
    assert merged.dim() == (3, 2)
    cols = bind_cols([subset(h, None, "term = 'get'"), subset(h, None, "term = 'see'")])
    assert cols.dim() == (7, 2)
    assert add_counts([h, h]).N == 2 * h.N
    assert vocabulary([a.rows, b.rows], pattern="^c").count() == 1
