"""Registered queries of sources, sinks and the operators that :mod:`termfield.queries` leaves out, with their SQL.

Files are written to the shared folder first, in the format at hand, and read back by the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.association import MEASURES
from .model import TermModel, from_dense, from_triplets, to_arrays
from .operators import binding, contexts, distances, evaluation, filters, neighbours, norms, projection, scoring
from .plans import cooccurrence
from .queries import FULL_SQL, MONTHS_SQL, NEXT_SQL, PARTS_SQL, months, neighbouring, parts, query, rounded, table, triplets
from .shared import shared_folder
from .sources import matrices
from .sources import triplets as files

# -- sources ------------------------------------------------------------------------------


def lines(df: DataFrame, name: str, *order: str, head: list[str] = (), **options) -> str:
    """A text file (a folder of one part) with the first lines ``head``, then the column ``value`` in order; its path."""
    path = shared_folder(df.sparkSession, name)
    body = df.select(F.struct(*order).alias("at"), "value") if order else df.select(F.struct(F.col("value").alias("x")).alias("at"), "value")
    every = body.select(F.lit(len(head)).alias("k"), "at", "value")
    if head:
        top = df.sparkSession.createDataFrame(list(enumerate(head)), "k int, value string")
        every = every.unionByName(top, allowMissingColumns=True)
    every.orderBy("k", "at").select("value").coalesce(1).write.options(**options).text(path)
    return path


def tabbed(*cols) -> F.Column:
    return F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c) for c in cols]).alias("value")


@query(f"WITH {PARTS_SQL} SELECT target, feature, f FROM M")
def read_triplet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from a gzipped triplet file."""
    path = lines(triplets(spark, sf_dir).select(tabbed("target", "feature", "f")), "triplets", compression="gzip")
    return files.read_triplets(spark, path, freq=True).cells


@query(f"WITH {PARTS_SQL} SELECT target, feature, f AS score FROM M")
def read_triplet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, value first, from a bzip2 file with semicolons."""
    path = lines(triplets(spark, sf_dir).select(F.concat_ws(";", "f", "target", "feature").alias("value")), "triplets", compression="bzip2")
    return files.read_triplets(spark, path, value_first=True, sep=";").scores


@query("SELECT 's' || l_suppkey AS target, l_returnflag AS feature, count(*)::DOUBLE AS f FROM lineitem GROUP BY 1, 2")
def read_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lines(table(spark, sf_dir, "lineitem").select(tabbed(F.concat(F.lit("s"), "l_suppkey"), "l_returnflag")), "tokens")
    return files.read_triplets(spark, path, tokens=True).cells


@query(f"WITH {MONTHS_SQL} SELECT target AS term, r1 * 3.0 * 2 AS f, nr AS nnzero FROM (SELECT target, r1, (SELECT count(*) FROM M m WHERE m.target = R.target AND f <> 0) AS nr FROM R)")
def read_external_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose marginals come from a table of their own (twice the sums) and a span size of 3."""
    m = months(spark, sf_dir)
    path = lines(m.cells.select(tabbed("target", "feature", "f")), "triplets")
    info = [lines(getattr(m, x).select(tabbed("term", (F.col("f") * 2).cast("string"))), x, head=["term\tf"]) for x in ("rows", "cols")]
    return files.read_triplets(spark, path, freq=True, rowinfo=info[0], colinfo=info[1], N=2 * m.N, span_size=3).rows.select("term", "f", "nnzero")


@query("SELECT p_name AS term, p_retailprice AS f, p_size::DOUBLE AS size FROM part")
def read_info_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    path = lines(t.select(tabbed("p_name", F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"))), "info", head=["term\tf\tsize"])
    return files.read_info(spark, path)


@query("SELECT 'Ä' || s_name || 'é' AS term, s_suppkey::DOUBLE AS f FROM supplier")
def read_latin_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in an encoding of one byte a character."""
    t = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Ä"), "s_name", F.lit("é")).alias("term"), F.col("s_suppkey").alias("f"))
    path = shared_folder(spark, "latin")
    t.write.option("sep", "\t").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return files.read_info(spark, path, encoding="ISO-8859-15")


@query(f"WITH {MONTHS_SQL} SELECT target, feature, f FROM M")
def read_term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = months(spark, sf_dir).cells.select(F.col("feature").alias("doc"), F.col("target").alias("term"), F.col("f").alias("n"))
    return files.from_term_documents(t).cells


_DENSE = f"WITH {FULL_SQL}, N AS (SELECT feature, row_number() OVER (ORDER BY feature) AS k FROM C)"


@query(f"{_DENSE} SELECT target AS term, list(f ORDER BY k) AS vec FROM D JOIN N USING (feature) GROUP BY 1")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written as word vectors and read again."""
    path = shared_folder(spark, "vectors")
    matrices.write_word_vectors(months(spark, sf_dir), path)
    return matrices.read_word_vectors(spark, path).select("term", "vec")


@query(f"{_DENSE} SELECT target, 'V' || k AS feature, f AS score FROM D JOIN N USING (feature)")
def word_vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "vectors")
    matrices.write_word_vectors(months(spark, sf_dir), path)
    return matrices.word_vector_model(spark, path).scores


@query(f"{_DENSE} SELECT 's' || row_number() OVER (ORDER BY target) AS term, list(round(f / 7, 2) ORDER BY k) AS vec FROM D JOIN N USING (feature) GROUP BY target")
def word_vectors_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays under new labels, written with two digits."""
    m = months(spark, sf_dir)
    order = m.rows.select("term").toDF("old").orderBy("old")
    number = filters.numbered(order, "old").select(F.col("old").alias("term"), F.concat(F.lit("s"), "k").alias("new"))
    arrays = to_arrays(m.cells, m.cols).join(number, "term").select(F.col("new").alias("term"), F.transform("vec", lambda x: x / 7).alias("vec"))
    path = shared_folder(spark, "vectors")
    matrices.write_word_vectors(arrays, path, digits=2)
    return matrices.read_word_vectors(spark, path).select("term", "vec")


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("x"))
    return t.select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j"), "x", F.concat_ws(" ", "l_suppkey", "l_linenumber", "x").alias("value"))


_COORDINATES = "SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


@query(_COORDINATES)
def read_matrix_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _coordinates(spark, sf_dir)
    size = t.agg(F.max("i"), F.max("j"), F.count("*")).first()
    path = lines(t, "market", "i", "j", head=["%%MatrixMarket matrix coordinate real general", "% a comment", " ".join(map(str, size))])
    return matrices.read_matrix_market(spark, path)[0]


@query("WITH T AS (SELECT DISTINCT n_nationkey + 1 AS i, n_regionkey + 1 AS j FROM nation WHERE n_nationkey > n_regionkey) SELECT i, j, 1.0::DOUBLE AS value FROM T UNION ALL SELECT j, i, 1.0::DOUBLE FROM T WHERE i <> j")
def read_matrix_market_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symmetric pattern file, filled up."""
    t = table(spark, sf_dir, "nation").where("n_nationkey > n_regionkey").select((F.col("n_nationkey") + 1).alias("i"), (F.col("n_regionkey") + 1).alias("j")).distinct()
    t = t.withColumn("value", F.concat_ws(" ", "i", "j"))
    path = lines(t, "market", "i", "j", head=["%%MatrixMarket matrix coordinate pattern symmetric", f"25 25 {t.count()}"])
    return matrices.read_matrix_market(spark, path)[0].select(F.col("i").cast("long"), F.col("j").cast("long"), "value")


def _directory(spark: SparkSession, sf_dir: str, sparse: bool) -> TermModel:
    m = months(spark, sf_dir)
    home = shared_folder(spark, "model")
    place = {x: filters.numbered(getattr(m, x).select("term", "f"), "term") for x in ("rows", "cols")}
    for name, df, order, head in (
        ("globals.tbl", spark.range(1).select(F.lit(str(m.N)).alias("value")), (), ["N"]),
        ("rows.tbl", place["rows"].select("k", tabbed("term", F.col("f").cast("string"))), ("k",), ["term\tf"]),
        ("cols.tbl", place["cols"].select("k", tabbed("term", F.col("f").cast("string"))), ("k",), ["term\tf"]),
    ):
        _moved(lines(df, "part", *order, head=head), f"{home}/{name}", spark)
    if sparse:
        at = m.cells.join(place["rows"].select(F.col("term").alias("target"), F.col("k").alias("i")), "target").join(place["cols"].select(F.col("term").alias("feature"), F.col("k").alias("j")), "feature")
        size = [place["rows"].count(), place["cols"].count(), at.count()]
        _moved(lines(at.select("i", "j", F.concat_ws(" ", "i", "j", "f").alias("value")), "part", "i", "j", head=["%%MatrixMarket matrix coordinate real general", " ".join(map(str, size))]), f"{home}/M.mtx", spark)
    else:
        dense = to_arrays(m.cells, m.cols).join(place["rows"], "term")
        _moved(lines(dense.select("k", F.concat_ws("\t", F.transform("vec", lambda x: x.cast("string"))).alias("value")), "part", "k"), f"{home}/M", spark)
    return matrices.read_model_directory(spark, home)


def _moved(path: str, to: str, spark: SparkSession) -> None:
    """A text folder copied line by line in its order."""
    matrices.numbered_lines(spark, path).orderBy("line").select("text").coalesce(1).write.text(to)


@query(f"WITH {MONTHS_SQL} SELECT target, feature, f FROM M")
def read_model_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir, True).cells


@query(f"WITH {MONTHS_SQL} SELECT target AS term, r1 AS f, (SELECT count(*) FROM M m WHERE m.target = R.target) AS nnzero FROM R")
def read_model_directory_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir, False).rows.select("term", "f", "nnzero")


@query(f"WITH {MONTHS_SQL} SELECT target, feature, f AS value FROM M")
def write_model_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = shared_folder(spark, "model")
    matrices.write_model_directory(months(spark, sf_dir), home)
    return spark.read.parquet(f"{home}/cells.parquet")


@query("WITH T AS (SELECT l_linenumber - 1 AS i, l_suppkey AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2) SELECT i::BIGINT AS i, j, value FROM T")
def read_svd_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse text for SVD tools: a line for each column (a supplier) with its number of cells, then its cells."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("x"))
    size = t.agg(F.max("i") + 1, F.max("j") + 1, F.count("*")).first()
    heads = spark.range(size[1]).select(F.col("id").alias("j")).join(t.groupBy("j").count(), "j", "left")
    heads = heads.select("j", F.lit(-1).alias("i"), F.coalesce("count", F.lit(0)).cast("string").alias("value"))
    every = heads.unionByName(t.select("j", "i", F.concat_ws(" ", "i", "x").alias("value")))
    return matrices.read_svd_text(spark, lines(every, "svd", "j", "i", head=[" ".join(map(str, size))]), "sparse")[0]


@query(f"{_DENSE}, A AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS i FROM R) SELECT i, k - 1 AS j, f AS value FROM D JOIN N USING (feature) JOIN A USING (target) WHERE f <> 0")
def read_svd_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = months(spark, sf_dir)
    dense = to_arrays(m.cells, m.cols)
    path = lines(dense.select("term", F.concat_ws(" ", F.transform("vec", lambda x: x.cast("string"))).alias("value")), "svd", "term", head=[" ".join(map(str, m.dim()))])
    return matrices.read_svd_text(spark, path, "dense")[0]


# -- model --------------------------------------------------------------------------------


@query(f"WITH {PARTS_SQL} SELECT (SELECT count(*) FROM R) AS rows, (SELECT count(*) FROM C) AS cols, count(*) AS stored, count(*) FILTER (f <> 0) AS nonzero, count(*) FILTER (f = 0) > 0 AS zeros_stored, false AS repeats, min(f) >= 0 AS nonneg FROM M")
def model_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).canonical()


@query("WITH U AS (SELECT 's' || l_suppkey AS target, l_returnflag AS feature, l_quantity - 25 AS f FROM lineitem) SELECT target, feature, sum(f) AS value FROM U GROUP BY 1, 2 HAVING sum(f) <> 0")
def model_canonical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a pair, as scores of a model put together by hand."""
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("feature"), (F.col("l_quantity") - 25).alias("score"))
    rows, cols = t.select(F.col("target").alias("term")).distinct(), t.select(F.col("feature").alias("term")).distinct()
    return TermModel(rows, cols, None, t).canonical_cells()


@query(f"WITH {PARTS_SQL} SELECT (SELECT count(*) FROM R) AS rows, (SELECT count(*) FROM C) AS cols, n AS N, count(*) FILTER (f <> 0) AS nonzero, round(count(*) FILTER (f <> 0)::DOUBLE / ((SELECT count(*) FROM R) * (SELECT count(*) FROM C)), 6) AS fill FROM M, G GROUP BY n".replace("AS N,", 'AS n,'))
def model_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parts(spark, sf_dir).describe()
    return rounded(spark.createDataFrame([(d["rows"], d["cols"], d["N"], d["nonzero"], d["fill"])], "rows long, cols long, n double, nonzero long, fill double"), "fill")


@query(f"{_DENSE} SELECT target, feature, f FROM D WHERE f <> 0")
def model_from_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to arrays and back."""
    m = months(spark, sf_dir)
    names = [r["term"] for r in m.cols.select("term").orderBy("term").collect()]  # 84 months
    return from_dense(to_arrays(m.cells, m.cols), names).cells


@query(f"WITH {MONTHS_SQL}, A AS (SELECT * FROM (VALUES (1, 's3'), (2, 's1'), (3, 's3'), (4, 's9')) v(pos, target)) SELECT pos, target, feature, f AS value FROM A JOIN M USING (target)")
def indexed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by label, in the order asked for and with repeats."""
    return filters.at_labels(months(spark, sf_dir).cells, ["s3", "s1", "s3", "s9"])


@query(f"WITH {PARTS_SQL}, K AS (SELECT target FROM R WHERE nr >= 4), L AS (SELECT feature FROM C WHERE nc >= (SELECT avg(nc) FROM C)) SELECT target, feature, f AS value FROM M SEMI JOIN K USING (target) SEMI JOIN L USING (feature)")
def subset_matrix_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = parts(spark, sf_dir)
    mean = m.cols.agg(F.avg("nnzero")).first()[0]
    return filters.subset(m, "nnzero >= 4", F.col("nnzero") >= mean, matrix_only=True)


@query(f"WITH {PARTS_SQL}, S AS (SELECT * FROM M WHERE feature IN ('s1', 's2')) SELECT target AS term, count(*) FILTER (f <> 0) AS nnzero FROM S GROUP BY 1 HAVING count(*) FILTER (f <> 0) > 0")
def subset_drop_zeroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.subset(parts(spark, sf_dir), None, F.col("term").isin("s1", "s2"), drop_zeroes=True).rows.select("term", "nnzero")


@query(f"WITH {PARTS_SQL}, S AS (SELECT target, f, f > r1 * c1 / n AS on_ FROM M JOIN R USING (target) JOIN C USING (feature) CROSS JOIN G) SELECT target AS term, count(*) FILTER (on_) AS nnzero FROM S GROUP BY 1")
def score_updated_nnzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nonzero scores (not counts) of each target."""
    return scoring.score(parts(spark, sf_dir), "MI", update_nnzero=True).rows.select("term", "nnzero")


@query(f"""WITH {PARTS_SQL}, X AS (SELECT sum(f) AS f FROM M), Y AS (SELECT sum(f * ln((1.0 + (SELECT count(*) FROM R)) / (nc + 1))) AS f FROM M JOIN C USING (feature))
SELECT measure, measure NOT IN ('frequency', 'tf.idf') AS refused, CASE measure WHEN 'frequency' THEN round(X.f, 4) WHEN 'tf.idf' THEN round(Y.f, 4) END AS total
FROM (SELECT unnest(['Dice', 'MI', 'chi-squared', 'frequency', 'log-likelihood', 'simple-ll', 't-score', 'tf.idf', 'z-score']) AS measure), X, Y""")
def score_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which measures a model with inconsistent marginals refuses, and the sum of the scores that it does get."""
    m = parts(spark, sf_dir)
    m = m.replaced(globals={**m.globals, "locked": True})
    out = []
    for measure in MEASURES:
        try:
            total = scoring.score(m, measure).scores.agg(F.round(F.sum("score"), 4).alias("total"))
            out.append(total.select(F.lit(measure).alias("measure"), F.lit(False).alias("refused"), "total"))
        except ValueError:
            out.append(spark.createDataFrame([(measure, True, None)], "measure string, refused boolean, total double"))
    found = out[0]
    for t in out[1:]:
        found = found.union(t)
    return found


# -- norms and distances ------------------------------------------------------------------


@query(f"WITH {PARTS_SQL} SELECT target AS term, (count(*) FILTER (f <> 0))::DOUBLE AS norm FROM M GROUP BY 1")
def norms_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(norms.norms(parts(spark, sf_dir).cells, "target", "minkowski", 0.0), "norm")


@query(f"WITH {PARTS_SQL} SELECT target AS term, round(sum(pow(abs(f), 0.5)), 6) + 0.0 AS norm FROM M GROUP BY 1")
def norms_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(norms.norms(parts(spark, sf_dir).cells, "target", "minkowski", 0.5), "norm")


_ALL = f"{FULL_SQL}, P AS (SELECT A.target AS a, B.target AS b, A.f AS x, B.f AS y FROM D A JOIN D B USING (feature))"
_COS = "sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))"


@query(f"WITH {_ALL} SELECT a, b, round({_COS}, 6) + 0.0 AS distance FROM P GROUP BY 1, 2")
def similarity_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.distances(months(spark, sf_dir).cells, method="cosine", convert=False), "distance")


@query(f"WITH {_ALL} SELECT a, b, round(sum(least(x, y)) / sum(greatest(x, y)), 6) + 0.0 AS distance FROM P GROUP BY 1, 2")
def similarity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.distances(months(spark, sf_dir).cells, method="jaccard", convert=False), "distance")


@query(f"WITH {_ALL} SELECT a, b, round(sum(least(x, y)), 6) + 0.0 AS distance FROM P GROUP BY 1, 2")
def similarity_overlap_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.distances(months(spark, sf_dir).cells, method="overlap", convert=False, normalized=True), "distance")


@query(f"WITH {_ALL} SELECT a, b, (count(*) FILTER (x <> y))::DOUBLE AS distance FROM P GROUP BY 1, 2")
def distance_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.distances(months(spark, sf_dir).cells, method="minkowski", p=0.0), "distance")


@query(f"""WITH A AS (SELECT 's' || l_suppkey AS t, strftime(l_shipdate, '%Y-%m') AS m, sum(l_quantity) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
B AS (SELECT 's' || l_suppkey AS t, strftime(l_shipdate, '%Y-%m') AS m, sum(l_quantity) AS f FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
L AS (SELECT DISTINCT m FROM A UNION SELECT DISTINCT m FROM B), X AS (SELECT t, m, coalesce(f, 0) AS x FROM (SELECT DISTINCT t FROM A) CROSS JOIN L LEFT JOIN A USING (t, m)),
Y AS (SELECT t, m, coalesce(f, 0) AS y FROM (SELECT DISTINCT t FROM B) CROSS JOIN L LEFT JOIN B USING (t, m))
SELECT X.t AS a, Y.t AS b, round(sum(abs(x - y)), 6) + 0.0 AS distance FROM X JOIN Y USING (m) GROUP BY 1, 2""")
def distance_between_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one matrix against those of another."""
    x, y = (months(spark, sf_dir, f"l_returnflag {f} 'A'").cells for f in ("=", "<>"))
    return rounded(distances.distances(x, y, method="manhattan"), "distance")


# -- neighbours and pairs -----------------------------------------------------------------

_MAN = f"{_ALL}, S AS (SELECT a, b, sum(abs(x - y)) AS d FROM P GROUP BY 1, 2)"


def _table(spark: SparkSession, sf_dir: str) -> neighbours.DistanceTable:
    """All distances of the suppliers, as a checked table that is computed where it is read."""
    return neighbours.distance_table(months(spark, sf_dir).cells, "manhattan")


@query(f"WITH {_MAN}, K AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM S WHERE a <> b) SELECT a AS target, b AS neighbour, rank, d AS distance FROM K WHERE rank <= 5")
def neighbours_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir)
    return neighbours.neighbours_in_matrix(found, found.terms(), 5)


@query(f"WITH {MONTHS_SQL}, K AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f DESC, feature) AS rank FROM M WHERE f > 0) SELECT target, feature AS neighbour, rank, f AS distance FROM K WHERE rank <= 7")
def neighbours_in_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count table as a sparse similarity."""
    m = months(spark, sf_dir)
    return neighbours.neighbours_in_matrix(neighbours.as_distances(m.cells, similarity=True), m.rows.select("term"), 7, sparse=True)


@query(f"WITH {_MAN} SELECT 'distances' AS name, false AS similarity, count(*) FILTER (X.d <> Y.d OR Y.d IS NULL) = 0 AS symmetric FROM S X LEFT JOIN S Y ON X.a = Y.b AND X.b = Y.a UNION ALL SELECT 'counts', true, count(*) = 0 FROM M LEFT JOIN R ON R.target = M.feature WHERE R.target IS NULL")
def distance_table_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of distances and one of counts are found to be; in SQL, by comparing all pairs both ways."""
    found = [("distances", _table(spark, sf_dir)), ("counts", neighbours.as_distances(months(spark, sf_dir).cells, similarity=True))]
    return spark.createDataFrame([(n, t.similarity, t.symmetric) for n, t in found], "name string, similarity boolean, symmetric boolean")


@query(f"WITH {_MAN}, K AS (SELECT b FROM (SELECT b, row_number() OVER (ORDER BY d, b) AS r FROM S WHERE a = 's1' AND b <> 's1') WHERE r <= 6 UNION ALL SELECT 's1') SELECT S.a, S.b, round(d, 6) + 0.0 AS distance, S.a = 's1' AS selected FROM S SEMI JOIN K ON K.b = S.a SEMI JOIN (SELECT b AS c FROM K) L ON L.c = S.b")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.neighbourhood(months(spark, sf_dir).cells, "s1", 6, method="manhattan"), "distance")


@query(f"WITH {_ALL}, S AS (SELECT a, b, {_COS} AS d FROM P WHERE a <> b GROUP BY 1, 2), K AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9) DESC, b) AS rank FROM S) SELECT a AS target, b AS neighbour, rank, round(d, 6) + 0.0 AS distance FROM K WHERE rank <= 3")
def nearest_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar suppliers of every supplier, by the cosine itself."""
    m = months(spark, sf_dir)
    return rounded(neighbours.nearest_neighbours(m.cells, m.rows, 3, method="cosine", convert=False, digits=9), "distance")


_ASKED = "W AS (SELECT DISTINCT 's' || s_suppkey AS w1, CASE WHEN s_suppkey % 10 = 0 THEN 'unknown' ELSE 's' || (s_suppkey % 7 + 1) END AS w2 FROM supplier)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("w1"), F.when(k % 10 == 0, "unknown").otherwise(F.concat(F.lit("s"), k % 7 + 1)).alias("w2")).distinct()


@query(f"WITH {_MAN}, {_ASKED} SELECT w1, w2, coalesce(d, 'inf'::DOUBLE) AS distance FROM W LEFT JOIN S ON a = w1 AND b = w2")
def pairs_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs_in_matrix(_asked(spark, sf_dir), _table(spark, sf_dir))


@query(f"WITH {_MAN}, {_ASKED} SELECT w1, w2, coalesce(round(1 / (1 + d), 6), 0.0) AS distance FROM W LEFT JOIN S ON a = w1 AND b = w2")
def pair_distances_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.pair_distances(_asked(spark, sf_dir), months(spark, sf_dir).cells, "manhattan", transform=lambda d: 1 / (1 + d)), "distance")


_RANKED = f"WITH {_MAN}, {_ASKED}, F AS (SELECT a, b, rank() OVER (PARTITION BY a ORDER BY d) - 1.0 AS r FROM S)"


@query(f"{_RANKED} SELECT w1, w2, coalesce(r, 'inf'::DOUBLE) AS rank FROM W LEFT JOIN F ON a = w1 AND b = w2")
def pair_ranks_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from a table, unknown words at Infinity."""
    return neighbours.pair_ranks_in_matrix(_asked(spark, sf_dir), _table(spark, sf_dir))


@query(f"{_RANKED} SELECT w1, w2, coalesce((X.r + Y.r) / 2, 'inf'::DOUBLE) AS rank FROM W LEFT JOIN F X ON X.a = w1 AND X.b = w2 LEFT JOIN F Y ON Y.a = w2 AND Y.b = w1")
def pair_ranks_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pair_ranks_in_matrix(_asked(spark, sf_dir), _table(spark, sf_dir), "avg", "arithmetic")


@query(f"{_RANKED} SELECT w1, w2, coalesce(round(sqrt(X.r * Y.r), 6), 'inf'::DOUBLE) AS rank FROM W LEFT JOIN F X ON X.a = w1 AND X.b = w2 LEFT JOIN F Y ON Y.a = w2 AND Y.b = w1")
def pair_ranks_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.pair_ranks_in_matrix(_asked(spark, sf_dir), _table(spark, sf_dir), "avg", "geometric"), "rank")


# -- projection ---------------------------------------------------------------------------


def _dots(vectors: DataFrame) -> DataFrame:
    """(target, dot): inner products with the vector of s1."""
    one = vectors.where("term = 's1'").select(F.col("vec").alias("w"))
    dot = F.aggregate(F.zip_with("vec", "w", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return rounded(vectors.crossJoin(F.broadcast(one)).select(F.col("term").alias("target"), (dot / 1000).alias("dot")), "dot")


_DOTS = f"WITH {FULL_SQL} SELECT A.target, round(sum(A.f * B.f) / 1000, 6) + 0.0 AS dot FROM D A JOIN D B USING (feature) WHERE B.target = 's1' GROUP BY 1"


@query(_DOTS)
def project_svd_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all dimensions SVD keeps inner products."""
    return _dots(projection.project(months(spark, sf_dir), None, "svd").vectors)


@query(_DOTS)
def project_rsvd_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dots(projection.project(months(spark, sf_dir), None, "rsvd", q=6).vectors)


@query(_DOTS)
def fold_in_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows put into the space of a basis with all dimensions."""
    m = months(spark, sf_dir)
    got = projection.project(m, None, "svd", with_basis=True)
    return _dots(projection.fold_in(m.cells, got.basis))


@query(f"WITH {FULL_SQL} SELECT round(sum(f * f) / 1e6, 6) AS energy, 1.0::DOUBLE AS r2 FROM D")
def project_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of all singular values add up to those of all cells, and explain all."""
    got = projection.project(months(spark, sf_dir), None, "svd")
    return rounded(spark.createDataFrame([(float((got.sigma**2).sum()) / 1e6, float(got.r2.sum()))], "energy double, r2 double"), "energy", "r2")


_RI = """X AS (SELECT M.target, d, f, md5('42 ' || d || ' ' || feature) AS h FROM M, (VALUES (0), (1)) v(d)),
Y AS (SELECT target, d * 10 + ('0x' || substr(h, 1, 12))::BIGINT % 10 AS k, CASE WHEN substr(h, 13, 1) < '8' THEN f ELSE -f END AS f FROM X),
U AS (SELECT sqrt(20.0 / (count(DISTINCT feature) * 2)) AS u FROM M)"""


@query(f"WITH {MONTHS_SQL}, {_RI}, Z AS (SELECT target, k, sum(f) AS v FROM Y GROUP BY 1, 2) SELECT R.target AS term, j AS k, round(coalesce(v, 0) * u, 6) + 0.0 AS value FROM R CROSS JOIN range(20) g(j) CROSS JOIN U LEFT JOIN Z ON Z.target = R.target AND Z.k = j")
def random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = projection.project(months(spark, sf_dir), 20, "ri", rate=0.1).vectors
    return rounded(got.select("term", F.posexplode("vec").alias("k", "value")).withColumn("k", F.col("k").cast("long")), "value")


# -- contexts, evaluation, binding --------------------------------------------------------


@query(f"WITH {MONTHS_SQL}, {NEXT_SQL} SELECT name, A.feature, round(A.f * B.f, 6) + 0.0 AS value FROM W JOIN M A ON A.target = w1 JOIN M B ON B.target = w2 AND B.feature = A.feature")
def composed_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contexts.composed(months(spark, sf_dir).cells, neighbouring(spark, sf_dir), "multiply"), "value")


@query(f"WITH {MONTHS_SQL}, B AS (SELECT l_orderkey % 50 AS ctx_id, 's' || l_suppkey AS target, count(*) AS w FROM lineitem GROUP BY 1, 2), T AS (SELECT ctx_id, sum(w) AS t FROM B GROUP BY 1) SELECT ctx_id, feature, round(sum(w * f) / any_value(t), 6) + 0.0 AS value FROM B JOIN M USING (target) JOIN T USING (ctx_id) GROUP BY 1, 2")
def context_vectors_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts as texts, split at white space, with words that are not known."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("ctx_id")).agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("s"), "l_suppkey")), F.lit("nobody")).alias("context"))
    return rounded(contexts.context_vectors(months(spark, sf_dir).cells, t), "value")


@query(f"WITH {_MAN}, Q AS (SELECT * FROM S WHERE a < b), T AS (SELECT quantile_cont(d, 2.0 / 3) AS cut, min(d) AS lo, max(d) AS hi FROM Q) SELECT a, b, d AS distance, round((hi - d) / (hi - lo), 6) + 0.0 AS strength FROM Q, T WHERE d <= cut")
def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.map_edges(_table(spark, sf_dir).blocks), "strength")


@query("SELECT 's' || s_suppkey AS term, s_suppkey::DOUBLE AS x, round(s_acctbal, 6) AS y, round(sqrt(pow(s_suppkey - 5.2, 2) + pow(s_acctbal - 1000, 2)), 6) AS distance FROM supplier ORDER BY distance, term LIMIT 1")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("term"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return rounded(evaluation.nearest_point(points, 5.2, 1000), "y", "distance")


@query(f"WITH {_MAN}, T AS (SELECT a AS m, sum(d) AS t FROM S GROUP BY 1), B AS (SELECT min_by(m, (t, m)) AS m FROM T) SELECT 's' || s_suppkey AS word, '1' AS cluster, false AS missing FROM supplier SEMI JOIN R ON target = 's' || s_suppkey".replace("min_by(m, (t, m))", "arg_min(m, t)"))
def clustering_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cluster: every known word, around one medoid."""
    task = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("word"), F.col("s_nationkey").alias("class"))
    return evaluation.clustering_details(task, months(spark, sf_dir).cells, clusters=1, method="manhattan").where("cluster <> 'n/a'").select("word", "cluster", "missing")


@query("WITH A AS (SELECT c_nationkey AS cluster, c_mktsegment AS gold, count(*) AS n FROM customer GROUP BY 1, 2), B AS (SELECT cluster, sum(n) AS s, sum(n * log2(n)) AS h FROM A GROUP BY 1), G AS (SELECT gold, sum(n) AS n FROM A GROUP BY 1) SELECT round((SELECT sum(s * log2(s) - h) / sum(s) FROM B) / (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM G), 6) AS entropy")
def cluster_entropy_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_mktsegment").alias("gold"))
    return rounded(evaluation.entropy(t, scale=True), "entropy")


_PART = "SELECT l_returnflag || ':' || l_suppkey AS target, l_linenumber::VARCHAR AS feature, sum(l_quantity) AS f FROM lineitem GROUP BY l_returnflag, l_suppkey, l_linenumber"


def _flags(spark: SparkSession, sf_dir: str) -> list[TermModel]:
    """A model for each return flag: suppliers by line numbers."""
    t = table(spark, sf_dir, "lineitem").withColumn("t", F.concat_ws(":", "l_returnflag", "l_suppkey"))
    return [from_triplets(t.where(F.col("l_returnflag") == x), "t", "l_linenumber", "l_quantity") for x in ("A", "N", "R")]


@query(f"WITH M AS ({_PART}) SELECT target, feature, f FROM M")
def bind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.bind_rows(_flags(spark, sf_dir)).cells


@query(f"WITH M AS ({_PART}), S AS (SELECT feature, substr(target, 1, 1) AS g, sum(f) AS f FROM M GROUP BY 1, 2) SELECT feature AS term, max(f) AS f FROM S GROUP BY 1")
def bind_rows_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginals of common features: the largest of the models'."""
    return binding.bind_rows(_flags(spark, sf_dir)).cols.select("term", "f")


@query(f"WITH M AS ({_PART}) SELECT feature AS target, target AS feature, f FROM M")
def bind_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.bind_cols([m.transposed() for m in _flags(spark, sf_dir)]).cells


# -- co-occurrence and streams ------------------------------------------------------------


@query("SELECT 's' || l_suppkey AS target, 'o' || l_orderkey AS feature, count(*)::DOUBLE AS f FROM lineitem GROUP BY 1, 2")
def cooccurrence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("term"), F.concat(F.lit("o"), "l_orderkey").alias("doc"))
    return cooccurrence.term_documents(t).cells


@query("SELECT l_returnflag || ':' || l_linestatus || ':' || l_suppkey AS feature, count(*) AS n FROM lineitem GROUP BY 1")
def structured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(cooccurrence.structured("l_returnflag", "l_linestatus", "l_suppkey").alias("feature"))
    return t.groupBy("feature").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS \"end\", user_id::VARCHAR AS target, event_type AS feature, count(*)::DOUBLE AS f FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3, 4")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of a day, as batch and stream share the definition."""
    from .streaming import counts

    return counts.windowed_counts(table(spark, sf_dir, "events").where("user_id is not null and event_type is not null and ts is not null"), "user_id", "event_type", "ts", "1 day")
