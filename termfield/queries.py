"""Registered queries of the library, each with the same result as SQL where SQL can say it.

The tables are read as co-occurrence data: parts with suppliers (weighted by quantity) and
suppliers with months.  Floating-point results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.association import MEASURES
from .model import TermModel, from_triplets
from .operators import binding, contexts, distances, evaluation, filters, neighbours, norms, projection, scoring
from .plans import cooccurrence
from .shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("feature"), F.col("l_quantity").alias("f"))


def parts(spark: SparkSession, sf_dir: str) -> TermModel:
    """Parts by suppliers, counts are quantities."""
    return from_triplets(triplets(spark, sf_dir))


def months(spark: SparkSession, sf_dir: str, where: str = "true") -> TermModel:
    """Suppliers by months of shipping."""
    t = table(spark, sf_dir, "lineitem").where(where)
    return from_triplets(t.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"), F.date_format("l_shipdate", "yyyy-MM").alias("feature"), F.col("l_quantity").alias("f")))


PARTS_SQL = """M AS (SELECT 'p' || l_partkey AS target, 's' || l_suppkey AS feature, sum(l_quantity) AS f FROM lineitem GROUP BY 1, 2),
R AS (SELECT target, sum(f) AS r1, count(*) FILTER (f <> 0) AS nr FROM M GROUP BY 1),
C AS (SELECT feature, sum(f) AS c1, count(*) FILTER (f <> 0) AS nc FROM M GROUP BY 1),
G AS (SELECT sum(f) AS n FROM M)"""
MONTHS_SQL = """M AS (SELECT 's' || l_suppkey AS target, strftime(l_shipdate, '%Y-%m') AS feature, sum(l_quantity) AS f FROM lineitem GROUP BY 1, 2),
R AS (SELECT target, sum(f) AS r1 FROM M GROUP BY 1),
C AS (SELECT feature, sum(f) AS c1 FROM M GROUP BY 1),
G AS (SELECT sum(f) AS n FROM M)"""
#: Suppliers by months with the zeros.
FULL_SQL = MONTHS_SQL + """,
D AS (SELECT R.target, C.feature, coalesce(M.f, 0.0) AS f FROM R CROSS JOIN C LEFT JOIN M USING (target, feature))"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    # Adding 0 turns -0 into 0.
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


# -- model --------------------------------------------------------------------------------


@query(f"WITH {PARTS_SQL} SELECT target, feature, f FROM M")
def model_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).cells


@query(f"WITH {PARTS_SQL} SELECT target AS term, r1 AS f, nr AS nnzero FROM R")
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).rows


@query(f"WITH {PARTS_SQL} SELECT feature AS term, c1 AS f, nc AS nnzero FROM C")
def model_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).cols


@query(f"WITH {PARTS_SQL} SELECT count(*) FILTER (f > 0) AS pos, (SELECT count(*) FROM R) * (SELECT count(*) FROM C) - count(*) FILTER (f <> 0) AS zero, count(*) FILTER (f < 0) AS neg FROM M")
def model_sign_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).sign_count()


@query(f"WITH {PARTS_SQL} SELECT feature AS target, target AS feature, f FROM M")
def model_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).transposed().cells


@query(f"WITH {PARTS_SQL} SELECT target, feature, f AS value FROM M WHERE target IN (SELECT target FROM R ORDER BY 1 LIMIT 20) AND feature IN (SELECT feature FROM C ORDER BY 1 LIMIT 30)")
def model_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).head(20, 30)


@query(f"WITH {PARTS_SQL} SELECT upper(target) AS target, feature, f FROM M")
def model_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = parts(spark, sf_dir)
    return m.renamed(rows=m.rows.select(F.col("term").alias("old"), F.upper("term").alias("new"))).cells


_KEPT = """K AS (SELECT target FROM R, G WHERE r1 >= n / 2500 AND length(target) <= 5), L AS (SELECT feature FROM C WHERE length(feature) <= 3)"""


@query(f"WITH {PARTS_SQL}, {_KEPT} SELECT target, feature, f FROM M SEMI JOIN K USING (target) SEMI JOIN L USING (feature)")
def subset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.subset(parts(spark, sf_dir), F.expr("f >= N / 2500 and length(term) <= 5"), "length(term) <= 3").cells


@query(
    f"""WITH {PARTS_SQL}, {_KEPT}, S AS (SELECT * FROM M SEMI JOIN K USING (target) SEMI JOIN L USING (feature))
SELECT target AS term, r1 AS f, count(S.f) AS nnzero FROM K JOIN R USING (target) LEFT JOIN S USING (target) GROUP BY 1, 2"""
)
def subset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.subset(parts(spark, sf_dir), F.expr("f >= N / 2500 and length(term) <= 5"), "length(term) <= 3").rows.select("term", "f", "nnzero")


def _fixed_point_sql(rounds: int = 40) -> str:
    """Enough unrolled rounds for the fixed point; later ones change nothing."""
    parts = ["S0 AS MATERIALIZED (SELECT 'o' || l_orderkey AS target, 'p' || l_partkey AS feature, sum(l_quantity) AS f FROM lineitem GROUP BY 1, 2)"]
    for k in range(rounds):
        parts.append(
            f"""S{k + 1} AS MATERIALIZED (SELECT S.* FROM S{k} S SEMI JOIN (SELECT target FROM S{k} GROUP BY 1 HAVING count(*) FILTER (f <> 0) >= 3) A USING (target)
SEMI JOIN (SELECT feature FROM S{k} GROUP BY 1 HAVING count(*) FILTER (f <> 0) >= 20) B USING (feature))"""
        )
    return "WITH " + ", ".join(parts) + f" SELECT target, feature, f FROM S{rounds}"


@query(_fixed_point_sql())
def subset_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three parts and more, and parts in 20 orders and more, counted among each other: several rounds to the fixed point."""
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("target"), F.concat(F.lit("p"), "l_partkey").alias("feature"), F.col("l_quantity").alias("f"))
    return filters.subset(from_triplets(t), "nnzero >= 3", "nnzero >= 20", recursive=True).cells


@query(
    """WITH t AS (SELECT l_suppkey AS v, l_returnflag AS g, min(l_orderkey) AS p FROM lineitem GROUP BY 1, 2)
SELECT v AS value, max(p) FILTER (g = 'A') AS "A", max(p) FILTER (g = 'N') AS "N", max(p) FILTER (g = 'R') AS "R" FROM t GROUP BY 1 HAVING count(*) FILTER (g IN ('A', 'N', 'R')) = 3"""
)
def match_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.match_split(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_orderkey", groups=["A", "N", "R"])


_TAG = "(CASE p_size % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'V' WHEN 2 THEN 'J' ELSE 'X' END)"


@query(
    f"""SELECT p_partkey, p_brand || '_' || {_TAG} AS cwb, lower(p_brand) || '_' || (CASE p_size % 4 WHEN 0 THEN 'SUBST' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' ELSE 'UNC' END) AS bnc,
p_brand || '-' || lower({_TAG}) AS dm, p_brand AS hw, lower(p_brand) AS hwlc FROM part"""
)
def convert_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemma = F.concat("p_brand", F.lit("_"), F.expr("case p_size % 4 when 0 then 'N' when 1 then 'V' when 2 then 'J' else 'X' end"))
    forms = {f.lower(): filters.convert_lemma(lemma, f) for f in ("CWB", "BNC", "DM", "HW", "HWLC")}
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in forms.items()])


@query(f"WITH {PARTS_SQL} SELECT target AS term FROM R WHERE starts_with(target, 'p1') ORDER BY 1 LIMIT 100")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.prefix_search(parts(spark, sf_dir).rows, "p1%")


# -- scores -------------------------------------------------------------------------------

_E = "(r1 * c1 / n)"
_O12, _O21, _O22 = "(r1 - f)", "(c1 - f)", "(n - c1 - r1 + f)"
_CELLS = [("f", _E), (_O12, "(r1 * (n - c1) / n)"), (_O21, "((n - r1) * c1 / n)"), (_O22, "((n - r1) * (n - c1) / n)")]
_LL = "2 * (" + " + ".join(f"CASE WHEN {o} > 0 THEN {o} * ln({o} / {e}) ELSE 0 END" for o, e in _CELLS) + ")"
_SLL = f"2 * (f * ln(f / {_E}) - (f - {_E}))"
_CHI = f"n * pow(abs(f * {_O22} - {_O12} * {_O21}) - n / 2, 2) / (r1 * (n - r1) * c1 * (n - c1))"
#: Sparse and signed values of each measure in SQL.
_SQL = {
    "frequency": ("f", None),
    "simple-ll": (_SLL, f"CASE WHEN f >= {_E} THEN {_SLL} ELSE -({_SLL}) END"),
    "t-score": (f"(f - {_E}) / sqrt(f)", f"(f - {_E}) / sqrt(f + 1)"),
    "z-score": (f"(f - {_E}) / sqrt({_E})", f"(f - {_E}) / sqrt({_E})"),
    "Dice": ("2 * f / (r1 + c1)", None),
    "MI": (f"log2(f / {_E})", f"log2(f / {_E})"),
    "log-likelihood": (_LL, f"CASE WHEN f >= {_E} THEN {_LL} ELSE -({_LL}) END"),
    "chi-squared": (_CHI, f"CASE WHEN f >= {_E} THEN {_CHI} ELSE -({_CHI}) END"),
}
_JOINED = "FROM M JOIN R USING (target) JOIN C USING (feature) CROSS JOIN G"


def _score_queries() -> None:
    for measure, (sparse, signed) in _SQL.items():
        name = "score_" + measure.lower().replace("-", "_")
        cut = sparse if signed is None else f"CASE WHEN f > {_E} THEN {sparse} ELSE 0 END"
        query(f"WITH {PARTS_SQL} SELECT target, feature, round({cut}, 6) + 0.0 AS score {_JOINED}", name)(
            lambda spark, sf_dir, m=measure: rounded(scoring.score(parts(spark, sf_dir), m).scores, "score")
        )
        if signed is not None:
            query(f"WITH {PARTS_SQL} SELECT target, feature, round({signed}, 6) + 0.0 AS score {_JOINED}", f"{name}_signed")(
                lambda spark, sf_dir, m=measure: rounded(scoring.score(parts(spark, sf_dir), m, sparse=False, negative_ok="nonzero").scores, "score")
            )


_score_queries()
assert set(_SQL) | {"tf.idf"} == set(MEASURES)


@query(f"WITH {PARTS_SQL} SELECT target, feature, round(f * ln((1.0 + (SELECT count(*) FROM R)) / (nc + 1)), 6) + 0.0 AS score {_JOINED}")
def score_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(parts(spark, sf_dir), "tf.idf").scores, "score")


@query(f"WITH {PARTS_SQL} SELECT target, feature, round(greatest(0, 14 + log2(2 * f / (r1 + c1))), 6) + 0.0 AS score {_JOINED}")
def score_own_log_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(parts(spark, sf_dir), lambda t: 14 + F.log2(2 * t.O / (t.R1 + t.C1))).scores, "score")


_T = f"T AS (SELECT target, feature, CASE WHEN f > {_E} THEN (f - {_E}) / sqrt(f) ELSE 0 END AS s {_JOINED})"


@query(f"WITH {PARTS_SQL}, {_T}, L AS (SELECT target, sqrt(sum(s)) AS len FROM T GROUP BY 1) SELECT target, feature, round(CASE WHEN len < 1e-6 THEN 0 ELSE sqrt(s) / len END, 6) + 0.0 AS score FROM T JOIN L USING (target)")
def score_root_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(parts(spark, sf_dir), "t-score", transform="root", normalize_rows=True).scores, "score")


@query(f"WITH {PARTS_SQL}, {_T} SELECT target, feature, round(tanh(s), 6) + 0.0 AS score FROM T")
def score_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(parts(spark, sf_dir), "t-score", transform="sigmoid").scores, "score")


@query(f"WITH {PARTS_SQL}, Q AS (SELECT feature, sqrt(sum(pow(ln(f + 1), 2)) / ((SELECT count(*) FROM R) - 1)) AS q FROM M GROUP BY 1) SELECT target, feature, round(ln(f + 1) / q, 6) + 0.0 AS score FROM M JOIN Q USING (feature)")
def score_log_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(parts(spark, sf_dir), "frequency", transform="log", scale="scale").scores, "score")


@query(f"WITH {FULL_SQL}, Z AS (SELECT feature, avg(ln(f + 1)) AS m, stddev_samp(ln(f + 1)) AS s FROM D GROUP BY 1) SELECT target, feature, round((ln(f + 1) - m) / s, 6) + 0.0 AS score FROM D JOIN Z USING (feature)")
def score_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(months(spark, sf_dir), "frequency", transform="log", scale="standardize").scores, "score")


@query(f"WITH {FULL_SQL}, Z AS (SELECT feature, avg(f) AS m FROM D GROUP BY 1) SELECT target, feature, round(f - m, 6) + 0.0 AS score FROM D JOIN Z USING (feature)")
def score_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(months(spark, sf_dir), "frequency", scale="center").scores, "score")


@query(f"WITH {FULL_SQL} SELECT D.target, D.feature, round((D.f - {_E}) / sqrt(D.f + 1), 6) + 0.0 AS score FROM D JOIN R USING (target) JOIN C USING (feature) CROSS JOIN G")
def score_full_t_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(months(spark, sf_dir), "t-score", sparse=False, negative_ok=True).scores, "score")


@query(f"WITH {PARTS_SQL}, {_T} SELECT target, feature, round(ln(s + 1), 6) + 0.0 AS score FROM T")
def score_reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.score(scoring.score(parts(spark, sf_dir), "t-score"), "reweight", transform="log").scores, "score")


# -- norms --------------------------------------------------------------------------------


def _norm_queries() -> None:
    forms = {"euclidean": "sqrt(sum(f * f))", "maximum": "max(abs(f))", "manhattan": "sum(abs(f))", "minkowski": "pow(sum(pow(abs(f), 3)), 1.0 / 3)"}
    for by, key in (("row", "target"), ("col", "feature")):
        for method, sql in forms.items():
            query(f"WITH {PARTS_SQL} SELECT {key} AS term, round({sql}, 6) + 0.0 AS norm FROM M GROUP BY 1", f"norms_{by}_{method}")(
                lambda spark, sf_dir, k=key, m=method: rounded(norms.norms(parts(spark, sf_dir).cells, k, m, 3.0), "norm")
            )


_norm_queries()


@query(f"WITH {PARTS_SQL}, L AS (SELECT feature, sum(abs(f)) AS len FROM M GROUP BY 1) SELECT target, feature, round(f / len, 6) + 0.0 AS value FROM M JOIN L USING (feature)")
def normalize_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(norms.normalize(parts(spark, sf_dir).cells, "feature", "manhattan"), "value")


@query(f"WITH {PARTS_SQL} SELECT target, feature, round(f / r1 * 2.0, 6) + 0.0 AS value FROM M JOIN R USING (target)")
def scale_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = parts(spark, sf_dir)
    return rounded(norms.scale_margins(m.cells, m.rows.select("term", (1 / F.col("f")).alias("weight")), 2.0), "value")


# -- distances ----------------------------------------------------------------------------

_PAIRS = f"{FULL_SQL}, P AS (SELECT A.target AS a, B.target AS b, A.f AS x, B.f AS y FROM D A JOIN D B USING (feature))"
_COS = "least(1, greatest(-1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))"
_DIST = {
    "cosine": f"CASE WHEN {_COS} > 1 - 1e-12 THEN 0 ELSE degrees(acos({_COS})) END",
    "euclidean": "sqrt(sum((x - y) * (x - y)))",
    "maximum": "max(abs(x - y))",
    "manhattan": "sum(abs(x - y))",
    "minkowski": "pow(sum(pow(abs(x - y), 3)), 1.0 / 3)",
    "canberra": "sum(CASE WHEN x = 0 AND y = 0 THEN 0 ELSE abs(x - y) / (abs(x) + abs(y)) END)",
    "jaccard": "1 - sum(least(x, y)) / sum(greatest(x, y))",
    "overlap": "1 - sum(least(x, y)) / sum(x)",
}


def _distance_queries() -> None:
    for method, sql in _DIST.items():
        query(f"WITH {_PAIRS} SELECT a, b, round({sql}, 6) + 0.0 AS distance FROM P GROUP BY a, b", f"distance_{method}")(
            lambda spark, sf_dir, m=method: rounded(distances.distances(months(spark, sf_dir).cells, method=m, p=3.0), "distance")
        )


_distance_queries()


@query(f"WITH {_PAIRS} SELECT a, b, round(sum(pow(abs(x - y), 0.5)), 6) + 0.0 AS distance FROM P WHERE a < b GROUP BY a, b")
def distance_compact_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.distances(months(spark, sf_dir).cells, method="minkowski", p=0.5, compact=True), "distance")


@query(f"WITH {MONTHS_SQL}, P AS (SELECT A.feature AS a, B.feature AS b, sum(abs(A.f - B.f)) AS d FROM (SELECT R.target, C.feature, coalesce(M.f, 0.0) AS f FROM R CROSS JOIN C LEFT JOIN M USING (target, feature)) A JOIN (SELECT R.target, C.feature, coalesce(M.f, 0.0) AS f FROM R CROSS JOIN C LEFT JOIN M USING (target, feature)) B USING (target) GROUP BY 1, 2) SELECT a, b, round(d, 6) + 0.0 AS distance FROM P")
def distance_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.distances(months(spark, sf_dir).cells, method="manhattan", by_row=False), "distance")


@query(f"WITH {_PAIRS}, S AS (SELECT a, b, sum(abs(x - y)) AS d FROM P WHERE a <> b AND substr(a, 2)::BIGINT % 100 = 0 GROUP BY a, b), K AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM S) SELECT a AS target, b AS neighbour, rank, round(d, 6) + 0.0 AS distance FROM K WHERE rank <= 10")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier whose id is divisible by 100, searched among all."""
    asked = table(spark, sf_dir, "lineitem").where("l_suppkey % 100 = 0").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("term"))
    return rounded(neighbours.nearest_neighbours(months(spark, sf_dir).cells, asked, 10, method="manhattan", skip_missing=True), "distance")


@query(f"WITH {FULL_SQL}, V AS (SELECT feature, sum(f) AS x FROM D GROUP BY 1), S AS (SELECT target AS b, sum(abs(x - f)) AS d FROM D JOIN V USING (feature) GROUP BY 1), K AS (SELECT *, row_number() OVER (ORDER BY d, b) AS rank FROM S) SELECT 'sum' AS target, b AS neighbour, rank, round(d, 6) + 0.0 AS distance FROM K WHERE rank <= 10")
def nearest_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers nearest to the sum of all."""
    cells = months(spark, sf_dir).cells
    vector = cells.groupBy(F.lit("sum").alias("target"), "feature").agg(F.sum("f").alias("value"))
    return rounded(neighbours.neighbours_of_vectors(vector, cells, 10, "manhattan"), "distance")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers, one with an unknown word each tenth, rated by the gap of their balances."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    t = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_acctbal").alias("other"))
    second = F.when(F.col("s_suppkey") % 10 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey") + 1))
    return s.join(t, "s_suppkey").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("word1"), second.alias("word2"), F.abs(F.col("s_acctbal") - F.col("other")).alias("score"))


_RATED = """W AS (SELECT 's' || s.s_suppkey AS word1, CASE WHEN s.s_suppkey % 10 = 0 THEN 'unknown' ELSE 's' || (s.s_suppkey + 1) END AS word2, abs(s.s_acctbal - t.s_acctbal) AS score FROM supplier s JOIN supplier t ON t.s_suppkey = s.s_suppkey + 1)"""
_RATED_D = f"{FULL_SQL}, {_RATED}, X AS (SELECT word1, word2, score, sum(abs(A.f - B.f)) AS d FROM W LEFT JOIN D A ON A.target = word1 LEFT JOIN D B ON B.target = word2 AND B.feature = A.feature GROUP BY 1, 2, 3)"


@query(f"WITH {_RATED_D} SELECT word1 AS w1, word2 AS w2, coalesce(round(d, 6), 'inf'::DOUBLE) AS distance FROM X")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _rated(spark, sf_dir).select(F.col("word1").alias("w1"), F.col("word2").alias("w2"))
    return rounded(neighbours.pair_distances(pairs, months(spark, sf_dir).cells, "manhattan"), "distance")


_RANKS = f"""{FULL_SQL}, W AS (SELECT DISTINCT 's' || l_suppkey AS w1, 's' || (l_suppkey % 5 + 1) AS w2 FROM lineitem),
S AS (SELECT A.target AS a, B.target AS b, sum(abs(A.f - B.f)) AS d FROM D A JOIN D B USING (feature) GROUP BY 1, 2),
K AS (SELECT a, b, rank() OVER (PARTITION BY a ORDER BY d) - 1.0 AS r FROM S)"""


def _rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("w1"), F.concat(F.lit("s"), F.col("l_suppkey") % 5 + 1).alias("w2")).distinct()


@query(f"WITH {_RANKS} SELECT w1, w2, r::DOUBLE AS rank FROM W JOIN K ON a = w1 AND b = w2")
def pair_ranks_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pair_ranks(_rank_pairs(spark, sf_dir), months(spark, sf_dir).cells, "fwd", method="manhattan")


@query(f"WITH {_RANKS} SELECT w1, w2, r::DOUBLE AS rank FROM W JOIN K ON a = w2 AND b = w1")
def pair_ranks_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pair_ranks(_rank_pairs(spark, sf_dir), months(spark, sf_dir).cells, "bwd", method="manhattan")


@query(f"WITH {_RANKS} SELECT w1, w2, round(CASE WHEN F.r + B.r = 0 THEN 0 ELSE 2 * F.r * B.r / (F.r + B.r) END, 6) + 0.0 AS rank FROM W JOIN K F ON F.a = w1 AND F.b = w2 JOIN K B ON B.a = w2 AND B.b = w1")
def pair_ranks_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.pair_ranks(_rank_pairs(spark, sf_dir), months(spark, sf_dir).cells, "avg", "harmonic", method="manhattan"), "rank")


# -- contexts -----------------------------------------------------------------------------


@query(
    f"""WITH {MONTHS_SQL}, B AS (SELECT o_orderpriority AS ctx_id, 's' || l_suppkey AS target, count(*) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), T AS (SELECT ctx_id, sum(w) AS t FROM B GROUP BY 1)
SELECT ctx_id, feature, round(sum(w * f) / any_value(t), 6) + 0.0 AS value FROM B JOIN M USING (target) JOIN T USING (ctx_id) GROUP BY 1, 2"""
)
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the suppliers that orders of each priority meet."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    bags = lines.groupBy(F.col("o_orderpriority").alias("ctx_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("s")).count()
    # Few suppliers make a context here; a large bag comes as rows, not as a map.
    bags = bags.groupBy("ctx_id").agg(F.map_from_entries(F.collect_list(F.struct("s", F.col("count").cast("double")))).alias("context"))
    return rounded(contexts.context_vectors(months(spark, sf_dir).cells, bags), "value")


def neighbouring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with the next one: (name, w1, w2)."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.cast("string").alias("name"), F.concat(F.lit("s"), key).alias("w1"), F.concat(F.lit("s"), key + 1).alias("w2"))


#: Suppliers and the next ones, where both are known.
NEXT_SQL = "W AS (SELECT s_suppkey::VARCHAR AS name, 's' || s_suppkey AS w1, 's' || (s_suppkey + 1) AS w2 FROM supplier SEMI JOIN R A ON A.target = 's' || s_suppkey SEMI JOIN R B ON B.target = 's' || (s_suppkey + 1))"


@query(f"WITH {MONTHS_SQL}, {NEXT_SQL} SELECT name, feature, round(sum(f), 6) + 0.0 AS value FROM W JOIN M ON M.target IN (w1, w2) GROUP BY 1, 2")
def composed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = months(spark, sf_dir)
    pairs = neighbouring(spark, sf_dir)
    for c in ("w1", "w2"):
        pairs = pairs.join(m.rows.select(F.col("term").alias(c)), c, "left_semi")
    return rounded(contexts.composed(m.cells, pairs), "value")


# -- evaluation ---------------------------------------------------------------------------


@query(f"WITH {_RATED_D}, H AS (SELECT min(d) AS lo, max(d) AS hi FROM X) SELECT word1, word2, round(score, 6) AS score, round(coalesce(d, hi + (hi - lo) * 0.1), 6) AS distance, d IS NULL AS missing FROM X, H")
def rated_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.rated_distances(_rated(spark, sf_dir), months(spark, sf_dir).cells, method="manhattan"), "score", "distance")


@query(
    f"""WITH {_RATED_D}, H AS (SELECT min(d) AS lo, max(d) AS hi FROM X), Y AS (SELECT score, coalesce(d, hi + (hi - lo) * 0.1) AS d, d IS NULL AS lost FROM X, H),
Z AS (SELECT score, d, lost, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rd FROM Y)
SELECT round(abs(corr(rs, rd)), 6) AS rho, round(abs(corr(score, d)), 6) AS r, count(*) FILTER (lost) AS missing, count(*) AS n FROM Z"""
)
def similarity_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluation.similarity_correlation(_rated(spark, sf_dir), months(spark, sf_dir).cells, method="manhattan")
    return rounded(spark.createDataFrame([(got.rho, got.r, got.missing, got.n)], "rho double, r double, missing long, n long"), "rho", "r")


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("s"), F.col("s_suppkey") + k)
    return table(spark, sf_dir, "supplier").select(name(0).alias("target"), name(1).alias("correct"), name(2).alias("distract1"), name(3).alias("distract2"))


_CHOICE = f"""{FULL_SQL}, Q AS (SELECT s_suppkey AS i, unnest([0, 1, 2]) AS k FROM supplier),
X AS (SELECT i, k, sum(abs(A.f - B.f)) AS d FROM Q LEFT JOIN D A ON A.target = 's' || i LEFT JOIN D B ON B.target = 's' || (i + k + 1) AND B.feature = A.feature GROUP BY 1, 2),
Y AS (SELECT i, k, coalesce(d, 'inf'::DOUBLE) AS d FROM X),
Z AS (SELECT i, k, d, (SELECT count(*) FROM Y o WHERE o.i = y.i AND o.d <= y.d) AS r, (SELECT min(d) FROM Y o WHERE o.i = y.i) AS best FROM Y y),
T AS (SELECT i, d, r, CASE WHEN best < 'inf'::DOUBLE THEN r = 1 END AS ok FROM Z WHERE k = 0)"""


@query(f"WITH {_CHOICE} SELECT 100.0 * count(*) FILTER (ok) / count(*) AS accuracy, count(*) FILTER (ok) AS tp, count(*) - count(*) FILTER (ok) AS fp, count(*) FILTER (d = 'inf'::DOUBLE) AS missing FROM T")
def multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.multiple_choice(_choices(spark, sf_dir), months(spark, sf_dir).cells, method="manhattan")


_GOLD = "A AS (SELECT c_nationkey AS cluster, c_mktsegment AS gold, count(*) AS n FROM customer GROUP BY 1, 2)"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_mktsegment").alias("gold"))


@query(f"WITH {_GOLD}, B AS (SELECT cluster, max(n) AS best, sum(n) AS s FROM A GROUP BY 1) SELECT round(100.0 * sum(best) / sum(s), 6) AS purity FROM B")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.purity(_assigned(spark, sf_dir)), "purity")


@query(f"WITH {_GOLD}, B AS (SELECT cluster, sum(n) AS s, sum(n * log2(n)) AS h FROM A GROUP BY 1) SELECT round(sum(s * log2(s) - h) / sum(s), 6) AS entropy FROM B")
def cluster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.entropy(_assigned(spark, sf_dir)), "entropy")


@query(f"WITH {_GOLD} SELECT cluster, arg_min(gold, (-n, gold)) AS label FROM A GROUP BY 1")
def cluster_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority(_assigned(spark, sf_dir))


@query()
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("word"), F.col("s_nationkey").alias("class"))
    return evaluation.clustering_details(task, months(spark, sf_dir).cells, clusters=8, method="manhattan")


# -- projection ---------------------------------------------------------------------------


@query()
def project_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.score(months(spark, sf_dir), "MI", normalize_rows=True)
    return rounded(projection.project(m, 5, "svd").long().select("target", "feature", F.abs("value").alias("value")), "value")


@query()
def project_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.score(months(spark, sf_dir), "MI")
    return projection.project(m, 20, "ri", rate=0.1).vectors


# -- binding ------------------------------------------------------------------------------

_HALF = "SELECT 's' || l_suppkey || '.{0}' AS target, strftime(l_shipdate, '%Y-%m') AS feature, sum(l_quantity) AS f FROM lineitem WHERE l_returnflag = '{0}' GROUP BY 1, 2"


@query(
    f"""WITH A AS ({_HALF.format('A')}), B AS ({_HALF.format('R')}), C AS ({_HALF.format('N')}), K AS (SELECT DISTINCT feature FROM A INTERSECT SELECT DISTINCT feature FROM B INTERSECT SELECT DISTINCT feature FROM C)
SELECT target, feature, f FROM (SELECT * FROM A UNION ALL SELECT * FROM B UNION ALL SELECT * FROM C) SEMI JOIN K USING (feature)"""
)
def merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [months(spark, sf_dir, f"l_returnflag = '{x}'") for x in "ARN"]
    return binding.merge(kinds, [".A", ".R", ".N"]).cells


@query("SELECT 's' || l_suppkey AS target, strftime(l_shipdate, '%Y-%m') AS feature, sum(l_quantity) AS f FROM lineitem GROUP BY 1, 2")
def add_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.add_counts([months(spark, sf_dir, f"l_returnflag = '{x}'") for x in "ANR"]).cells


@query("SELECT strftime(l_shipdate, '%Y-%m') AS term FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_returnflag = 'R'")
def vocabulary_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.vocabulary([months(spark, sf_dir, f"l_returnflag = '{x}'").cols for x in "ANR"], "intersection")


# -- co-occurrence ------------------------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tokens of an order; the head of each is the one before."""
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_returnflag")
    t = table(spark, sf_dir, "lineitem").withColumn("term", F.concat(F.lit("s"), F.col("l_suppkey")))
    return t.select("l_orderkey", F.col("l_linenumber").alias("pos"), "term", F.lag("term").over(by_line).alias("head_term"), "l_returnflag")


@query("WITH T AS (SELECT DISTINCT l_orderkey, 's' || l_suppkey AS term FROM lineitem) SELECT A.term AS target, B.term AS feature, count(*)::DOUBLE AS f FROM T A JOIN T B ON A.l_orderkey = B.l_orderkey AND A.term <> B.term GROUP BY 1, 2")
def cooccurrence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.in_units(_tokens(spark, sf_dir), "l_orderkey").cells


@query(
    """WITH T AS (SELECT l_orderkey, 's' || l_suppkey AS term, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS p FROM lineitem)
SELECT A.term AS target, B.term AS feature, count(*)::DOUBLE AS f FROM T A JOIN T B ON A.l_orderkey = B.l_orderkey AND B.p BETWEEN A.p - 2 AND A.p + 2 AND B.p <> A.p GROUP BY 1, 2"""
)
def cooccurrence_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _tokens(spark, sf_dir).withColumn("at", F.struct("pos", F.substring("term", 2, 20).cast("long")))
    return cooccurrence.in_span(numbered, "at", text="l_orderkey", left=2, right=2).cells


@query(
    """WITH T AS (SELECT 's' || l_suppkey AS term, lag('s' || l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS head, l_returnflag AS rel FROM lineitem),
P AS (SELECT term AS target, rel || ':' || head AS feature FROM T WHERE head IS NOT NULL UNION ALL SELECT head, rel || '-1:' || term FROM T WHERE head IS NOT NULL) SELECT target, feature, count(*)::DOUBLE AS f FROM P GROUP BY 1, 2"""
)
def cooccurrence_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.along_dependencies(_tokens(spark, sf_dir), relation="l_returnflag").cells


@query(
    f"""WITH {FULL_SQL}, T AS (SELECT feature FROM C ORDER BY c1 DESC, feature LIMIT 10), X AS (SELECT D.target, D.feature, f / r1 AS s FROM D SEMI JOIN T USING (feature) JOIN R USING (target)),
Z AS (SELECT feature, avg(s) AS m, stddev_samp(s) AS v FROM X GROUP BY 1), Y AS (SELECT target, feature, (s - m) / v AS z FROM X JOIN Z USING (feature))
SELECT A.target AS a, B.target AS b, round(sum(abs(A.z - B.z)), 6) + 0.0 AS distance FROM Y A JOIN Y B USING (feature) GROUP BY 1, 2"""
)
def burrows_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cooccurrence.burrows_delta(months(spark, sf_dir).transposed(), 10), "distance")


# -- streams ------------------------------------------------------------------------------


@query("SELECT user_id::VARCHAR AS target, event_type AS feature, count(*)::DOUBLE AS f FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept from a stream of events, as a model's cells."""
    from .streaming import counts

    folder = shared_folder(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    counts.keep_table(counts.running_counts(stream, "user_id", "event_type"), f"{folder}/table", f"{folder}/progress").awaitTermination()
    return counts.model_of(spark, f"{folder}/table").cells


@query("""WITH E AS (SELECT user_id::VARCHAR AS target, event_type AS feature, cast(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
L AS (SELECT target, feature FROM E WHERE day > (SELECT max(day) FROM E) - 10), M AS (SELECT target, feature, count(*)::DOUBLE AS f FROM L GROUP BY 1, 2)
SELECT target, feature, f, sum(f) OVER (PARTITION BY target) AS target_f, sum(f) OVER (PARTITION BY feature) AS feature_f, sum(f) OVER () AS n FROM M""")
def stream_kept_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model kept from a stream of events: cells, marginals and N of the newest ten days, after compaction."""
    from .streaming import kept

    folder = shared_folder(spark, "kept")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    counts = kept.kept_counts(stream, "user_id", "event_type", "ts")
    kept.keep_model(counts, f"{folder}/table", f"{folder}/progress", keep=10, every=1).awaitTermination()
    m = kept.kept_model(spark, f"{folder}/table", 10)
    side = lambda info, key: info.select(F.col("term").alias(key), F.col("f").alias(f"{key}_f"))
    return m.cells.join(side(m.rows, "target"), "target").join(side(m.cols, "feature"), "feature").withColumn("n", F.lit(m.N))
