"""Registered queries of neighbours by an index, blocked decompositions, clusters, trees and maps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, graphs, maps, medoids, neighbours, nonnegative, scoring, tiles, trees
from .plans import cooccurrence
from .queries import FULL_SQL, PARTS_SQL, months, parts, query, rounded, table

# -- neighbours by an inverted index ------------------------------------------------------

_ASKED = "substr(target, 2)::BIGINT % 100 = 0"


def _hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose id is divisible by 100."""
    return parts(spark, sf_dir).rows.where("cast(substr(term, 2) as bigint) % 100 = 0").select("term")


@query(f"""WITH {PARTS_SQL}, L AS (SELECT target, sqrt(sum(f * f)) AS l FROM M GROUP BY 1),
S AS (SELECT A.target AS a, B.target AS b, sum(A.f * B.f) AS dot FROM (SELECT * FROM M WHERE {_ASKED}) A JOIN M B USING (feature) WHERE A.target <> B.target GROUP BY 1, 2),
K AS (SELECT a, b, dot / (X.l * Y.l) AS cos FROM S JOIN L X ON X.target = a JOIN L Y ON Y.target = b),
N AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS rank FROM K)
SELECT a AS target, b AS neighbour, rank, round(cos, 6) AS distance FROM N WHERE rank <= 10""")
def nearest_sparse_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part whose id is divisible by 100, searched among all parts by suppliers."""
    return rounded(neighbours.sparse_neighbours(parts(spark, sf_dir).cells, _hundredths(spark, sf_dir), 10, "cosine", convert=False), "distance")


@query(f"""WITH {PARTS_SQL}, S AS (SELECT A.target AS a, B.target AS b, sum(least(A.f, B.f)) AS low FROM (SELECT * FROM M WHERE {_ASKED}) A JOIN M B USING (feature) WHERE A.target <> B.target GROUP BY 1, 2),
K AS (SELECT a, b, low / (X.r1 + Y.r1 - low) AS sim FROM S JOIN R X ON X.target = a JOIN R Y ON Y.target = b),
N AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY 1 - sim, b) AS rank FROM K)
SELECT a AS target, b AS neighbour, rank, round(1 - sim, 6) AS distance FROM N WHERE rank <= 10""")
def nearest_sparse_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.sparse_neighbours(parts(spark, sf_dir).cells, _hundredths(spark, sf_dir), 10, "jaccard"), "distance")


# -- decompositions -----------------------------------------------------------------------


def _power_sql(rounds: int) -> str:
    """The leading eigenvector of the features' cross products by unrolled power iteration."""
    steps = ["A AS MATERIALIZED (SELECT X.feature AS i, Y.feature AS j, sum(X.f * Y.f) AS a FROM M X JOIN M Y USING (target) GROUP BY 1, 2)", "V0 AS MATERIALIZED (SELECT DISTINCT feature AS i, 1.0::DOUBLE AS v FROM M)"]
    for k in range(rounds):
        steps.append(f"W{k + 1} AS MATERIALIZED (SELECT A.i, sum(a * v) AS v FROM A JOIN V{k} ON V{k}.i = A.j GROUP BY 1), V{k + 1} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM W{k + 1}) AS v FROM W{k + 1})")
    return ", ".join(steps)


@query(f"WITH {PARTS_SQL}, {_power_sql(30)}, Y AS (SELECT target, sum(f * v) AS y FROM M JOIN V30 ON i = feature GROUP BY 1) SELECT target, round(y, 2) AS value, round((SELECT sqrt(sum(y * y)) FROM Y), 3) AS sigma FROM Y")
def project_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on the leading singular vector, from tiles of the matrix; the sign is that of the sum."""
    m = parts(spark, sf_dir)
    got = tiles.svd(m.cells, m.rows, m.cols, 1, 11.0, 10, 0.0)
    return got.vectors.select(F.col("term").alias("target"), F.round(F.abs(F.col("vec")[0]), 2).alias("value"), F.lit(round(float(got.sigma[0]), 3)).alias("sigma"))


# -- clusters, trees and maps -------------------------------------------------------------

#: Cosines of all pairs of suppliers by months, in degrees.
_ANGLES = f"""{FULL_SQL}, L AS (SELECT target, sqrt(sum(f * f)) AS l FROM D GROUP BY 1),
S AS (SELECT A.target AS a, B.target AS b, sum(A.f * B.f) AS dot FROM D A JOIN D B USING (feature) WHERE A.target < B.target GROUP BY 1, 2),
E0 AS MATERIALIZED (SELECT a, b, degrees(acos(least(1.0, dot / (X.l * Y.l)))) AS d FROM S JOIN L X ON X.target = a JOIN L Y ON Y.target = b)"""


def _minimax_sql(rounds: int) -> str:
    """Of each pair the path whose longest step is shortest, by squaring: paths of 2^rounds steps."""
    steps = ["P0 AS MATERIALIZED (SELECT a, b, d FROM E0 UNION ALL SELECT b, a, d FROM E0)"]
    for k in range(rounds):
        steps.append(f"P{k + 1} AS MATERIALIZED (SELECT a, b, min(d) AS d FROM (SELECT * FROM P{k} UNION ALL SELECT X.a, Y.b, greatest(X.d, Y.d) FROM P{k} X JOIN P{k} Y ON X.b = Y.a WHERE X.a <> Y.b) GROUP BY 1, 2)")
    return ", ".join(steps)


@query(f"WITH {_ANGLES}, {_minimax_sql(8)} SELECT E0.a, E0.b, round(E0.d, 6) AS height FROM E0 JOIN P8 USING (a, b) WHERE E0.d = P8.d")
def tree_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage of all suppliers: the steps that no way around avoids."""
    return rounded(trees.vector_tree(months(spark, sf_dir).cells, "single").select("a", "b", "height"), "height")


@query()
def tree_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trees.vector_tree(months(spark, sf_dir).cells, "complete"), "height")


@query()
def tree_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trees.vector_tree(months(spark, sf_dir).cells, "average"), "height")


@query(f"""WITH {_ANGLES}, {_minimax_sql(8)}, T AS (SELECT E0.a, E0.b, E0.d FROM E0 JOIN P8 USING (a, b) WHERE E0.d = P8.d ORDER BY E0.d DESC LIMIT 4), H AS (SELECT min(d) AS h FROM T),
Z AS (SELECT R.target AS term, least(R.target, coalesce(min(P8.b) FILTER (P8.d < h), R.target)) AS cluster FROM R CROSS JOIN H LEFT JOIN P8 ON P8.a = R.target GROUP BY R.target, h) SELECT term, cluster FROM Z""")
def tree_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clusters of suppliers by single linkage."""
    m = months(spark, sf_dir)
    return trees.cut(trees.vector_tree(m.cells, "single"), m.rows, 5)


@query()
def map_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers on a map that keeps the order of their angles."""
    return maps.vector_map(months(spark, sf_dir).cells, "ordinal", rounds=20, tol=1e-3).points


@query(f"""WITH {FULL_SQL}, W AS MATERIALIZED (SELECT A.target AS a, B.target AS b, sqrt(sum((A.f - B.f) * (A.f - B.f))) AS d FROM D A JOIN D B USING (feature) GROUP BY 1, 2),
B AS (SELECT X.b AS m1, Y.b AS m2 FROM W X JOIN W Y USING (a) WHERE X.b < Y.b GROUP BY 1, 2 ORDER BY sum(least(X.d, Y.d)) LIMIT 1),
K AS (SELECT a AS word, CASE WHEN a = m1 OR (a <> m2 AND X.d <= Y.d) THEN 1 ELSE 2 END AS m FROM B JOIN W X ON X.b = m1 JOIN W Y USING (a) WHERE Y.b = m2),
N AS (SELECT m, row_number() OVER (ORDER BY min(word)) AS cluster FROM K GROUP BY 1) SELECT word, cluster::VARCHAR AS cluster FROM K JOIN N USING (m)""")
def clustering_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of all suppliers around medoids; in SQL, around the best of all pairs."""
    task = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("word"), F.col("s_nationkey").alias("class"))
    return evaluation.clustering_details(task, months(spark, sf_dir).cells, clusters=2, method="euclidean").where("cluster <> 'n/a'").select("word", "cluster")


@query()
def medoids_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in 20 clusters by their suppliers' months of shipping, medoids from samples."""
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("target"), F.date_format("l_shipdate", "yyyy-MM").alias("feature"), F.col("l_quantity").alias("f"))
    cells = t.groupBy("target", "feature").agg(F.sum("f").alias("value"))
    return medoids.sampled_medoids(cells, 20, "cosine").assigned


@query()
def word_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts of their suppliers: centroids over months, in four senses."""
    m = scoring.score(months(spark, sf_dir), "MI")
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ctx_id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), "l_suppkey"))).alias("context"))
    return medoids.word_senses(m.scores, orders, 4)


# -- spans over one long text -------------------------------------------------------------


@query("""WITH T AS (SELECT l_returnflag || l_suppkey AS term, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_returnflag || l_suppkey) AS i FROM lineitem)
SELECT A.term AS target, B.term AS feature, count(*)::DOUBLE AS f FROM T A JOIN T B ON B.i - A.i IN (-2, -1, 1, 2, 3) GROUP BY 1, 2""")
def cooccurrence_span_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as one text of flags and suppliers, two before and three after, in ranges of 1,024."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("term"))
    return cooccurrence.in_span(t, left=2, right=3, block=1024).cells


# -- graphs, quantiles, non-negative dimensions -------------------------------------------


@query("SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS low, round(quantile_cont(l_extendedprice, 2.0 / 3), 6) AS high FROM lineitem")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quantiles of all prices, by counts of ranges that grow finer."""
    t = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    found = [graphs.exact_quantile(t, "l_extendedprice", q, few=100) for q in (0.1, 2 / 3)]
    return rounded(spark.createDataFrame([tuple(found)], "low double, high double"), "low", "high")


@query()
def graph_whispers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers in groups: their nearest suppliers by months say whom they belong to."""
    m = months(spark, sf_dir)
    near = neighbours.nearest_neighbours(m.cells, m.rows.select("term"), 5, convert=False)
    return graphs.whispers(near.select(F.col("target").alias("a"), F.col("neighbour").alias("b"), F.col("distance").alias("weight")))


@query()
def project_nonnegative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers by months in three non-negative dimensions."""
    got = nonnegative.reduce(months(spark, sf_dir), 3, rounds=5)
    return got.vectors.select("term", F.posexplode("vec").alias("k", "value"))
