"""Evaluation against gold standards: similarity ratings, multiple choice, clustering.

Distances stay in Spark; of a clustering only the medoids are on the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.association import named
from ..model import ModelError, values
from ..shared import kept, written
from . import medoids
from .distances import distances, is_similarity
from .filters import convert_lemma
from .graphs import exact_quantile
from .neighbours import pair_distances
from .swept import Swept, quantile


def _words(c: str, form: str | None) -> Column:
    return F.col(c).cast("string") if form is None else convert_lemma(F.col(c).cast("string"), form)


def with_average_rank(df: DataFrame, name: str, as_name: str) -> DataFrame:
    """``df`` with the ranks of a column, ties sharing their mean rank.

    Distinct values are numbered by range partitions: rows below a partition are counted, and
    only sums inside a partition are ordered.
    """
    own = f"{as_name}_part"
    sizes = df.groupBy(name).agg(F.count("*").alias("_k")).repartitionByRange(name).sortWithinPartitions(name)
    sizes = written(sizes.withColumn(own, F.spark_partition_id()), "ranks")
    # One row a partition.
    parts = sizes.groupBy(own).agg(F.sum("_k").alias("_n"), F.min(name).alias("_low"))
    below = parts.alias("x").join(F.broadcast(parts.alias("y")), F.col("y._low") < F.col("x._low"), "left").groupBy(F.col(f"x.{own}").alias(own)).agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_below"))
    inside = F.sum("_k").over(Window.partitionBy(own).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sizes.withColumn("_in", inside).join(F.broadcast(below), own).select(name, (F.col("_below") + F.col("_in") - (F.col("_k") - 1) / 2).alias(as_name))
    return df.join(ranked, name)


@dataclass(frozen=True)
class Correlation:
    """Rank and linear correlation with p value and 95 % interval, as absolute values."""

    rho: float
    p_value: float
    missing: int
    r: float
    r_lower: float
    r_upper: float
    n: int


def student_tail(t: float, df: float) -> float:
    """P(|T| > t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    if df <= 0 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for i in range(300):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
        c = 1 + num / c if abs(1 + num / c) > tiny else tiny
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    got = front * (value - 1)
    return 1 - got if swap else got


def rated_distances(task: DataFrame, table: DataFrame, form: str | None = None, word1: str = "word1", word2: str = "word2", score: str = "score", **how) -> DataFrame:
    """Word pairs with rating and distance; pairs with unknown words are put just beyond the range.

    (word1, word2, score, distance, missing)
    """
    pairs = task.select(_words(word1, form).alias("w1"), _words(word2, form).alias("w2"), F.col(word1).alias("_1"), F.col(word2).alias("_2"), F.col(score).cast("double").alias("_s"))
    found = pair_distances(pairs, table, **how)
    similarity = is_similarity(how.get("method", "cosine"), how.get("convert", True))
    lost = F.abs(F.col("distance")) == float("inf")
    span = found.where(~lost).agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"))
    margin = (F.col("_hi") - F.col("_lo")) * 0.1
    beyond = F.col("_lo") - margin if similarity else F.col("_hi") + margin
    # ``span`` is one row.
    out = found.crossJoin(F.broadcast(span))
    return out.select(F.col("_1").alias("word1"), F.col("_2").alias("word2"), F.col("_s").alias("score"), F.when(lost, beyond).otherwise(F.col("distance")).alias("distance"), lost.alias("missing"))


def similarity_correlation(task: DataFrame, table: DataFrame, form: str | None = None, word1: str = "word1", word2: str = "word2", score: str = "score", **how) -> Correlation:
    found = rated_distances(task, table, form, word1, word2, score, **how)
    return correlation(found)


def correlation(found: DataFrame) -> Correlation:
    """Statistics of a table (score, distance, missing)."""
    held = written(found.select("score", "distance", "missing"), "rated")
    ranked = with_average_rank(with_average_rank(held, "score", "rs"), "distance", "rd")
    got = ranked.agg(F.corr("rs", "rd").alias("rho"), F.corr("score", "distance").alias("r"), F.count("*").alias("n"), F.sum(F.col("missing").cast("long")).alias("missing")).first()
    n, rho, r = got["n"], got["rho"], got["r"]
    if rho is None or r is None:
        nan = float("nan")
        return Correlation(nan, nan, got["missing"] or 0, nan, nan, nan, n)
    t = abs(rho) * math.sqrt((n - 2) / max(1e-300, 1 - rho * rho)) if n > 2 else float("nan")
    lower, upper = float("nan"), float("nan")
    if n > 3 and abs(r) < 1:
        z, half = math.atanh(r), 1.959963984540054 / math.sqrt(n - 3)
        lower, upper = math.tanh(z - half), math.tanh(z + half)
        if r < 0:
            lower, upper = -upper, -lower
    return Correlation(abs(rho), student_tail(t, n - 2), got["missing"], abs(r), lower, upper, n)


def choices_of(task: DataFrame, target: str = "target", correct: str = "correct", distractor: str = "^distract") -> DataFrame:
    """(item, choice number, target, choice): choice 0 is the correct one."""
    others = [c for c in task.columns if re.search(distractor, c)]
    if not others:
        raise ModelError(f"no column matches {distractor!r}")
    numbered = task.withColumn("item", F.monotonically_increasing_id())
    every = F.array(*[F.col(c).cast("string") for c in (correct, *others)])
    return numbered.select("item", F.col(target).cast("string").alias("target"), F.posexplode(every).alias("number", "choice"))


def multiple_choice_details(task: DataFrame, table: DataFrame, form: str | None = None, target: str = "target", correct: str = "correct", distractor: str = "^distract", **how) -> DataFrame:
    """One row an item: target, correct, best_choice, best_dist, correct_choice, correct_rank, correct_dist.

    A tie takes the worst rank, so a correct choice tied with a distractor is wrong; correct is
    null if no pair is known.
    """
    pairs = choices_of(task, target, correct, distractor).withColumn("w1", _words("target", form)).withColumn("w2", _words("choice", form))
    found = pair_distances(pairs, table, **how)
    similarity = is_similarity(how.get("method", "cosine"), how.get("convert", True))
    d = -F.col("distance") if similarity else F.col("distance")
    w = Window.partitionBy("item").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.withColumn("d", d).withColumn("rank", F.count("*").over(w))
    first = F.struct("rank", "number")
    at_zero = lambda c: F.max(F.when(F.col("number") == 0, F.col(c)))
    got = ranked.groupBy("item").agg(
        F.first("target").alias("target"),
        F.min_by("choice", first).alias("best_choice"),
        F.min_by("distance", first).alias("best_dist"),
        F.min("d").alias("_best"),
        at_zero("choice").alias("correct_choice"),
        at_zero("rank").alias("correct_rank"),
        at_zero("distance").alias("correct_dist"),
    )
    right = F.when(F.col("_best") < float("inf"), F.col("correct_rank") == 1)
    return got.select("item", "target", right.alias("correct"), "best_choice", "best_dist", "correct_choice", "correct_rank", "correct_dist")


def multiple_choice(task: DataFrame, table: DataFrame, **how) -> DataFrame:
    """One row: accuracy in percent, tp, fp, and missing (items whose correct pair is unknown)."""
    found = multiple_choice_details(task, table, **how)
    tp = F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0))
    lost = F.sum((F.abs(F.col("correct_dist")) == float("inf")).cast("long"))
    return found.agg((100.0 * tp / F.count("*")).alias("accuracy"), tp.alias("tp"), (F.count("*") - tp).alias("fp"), lost.alias("missing"))


def pam(d: np.ndarray, k: int) -> np.ndarray:
    """Partitioning around medoids of a distance matrix: greedy start, then best swaps; clusters from 0."""
    n = len(d)
    if not 1 <= k <= n:
        raise ValueError(f"between 1 and {n} clusters are possible")
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:
        near = d[:, medoids].min(1)
        gain = np.maximum(near[:, None] - d, 0).sum(0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    cost = d[:, medoids].min(1).sum()
    while True:
        best = (cost - 1e-12, None)
        for i in range(k):
            rest = [m for j, m in enumerate(medoids) if j != i]
            near = d[:, rest].min(1) if rest else np.full(n, np.inf)
            costs = np.minimum(near[:, None], d).sum(0)
            costs[medoids] = np.inf
            c = int(costs.argmin())
            if costs[c] < best[0]:
                best = (costs[c], (i, c))
        if best[1] is None:
            break
        medoids[best[1][0]], cost = best[1][1], best[0]
    own = d[:, medoids].argmin(1)
    own[medoids] = np.arange(k)
    # Clusters are numbered in the order in which the items meet them.
    order = {c: i for i, c in enumerate(dict.fromkeys(own.tolist()))}
    return np.array([order[c] for c in own.tolist()])


def medoid_clusters(d: DataFrame, k: int) -> DataFrame:
    """(w, cluster): ``pam`` over a written table (a, b, distance) of all ordered pairs, the diagonal too; ties go by name.

    Each step is one aggregation over the pairs; a swap has to lower the cost by more than the
    rounding of sums in another order.  What each word has beside its pairs (a row a word) is
    small next to them and broadcast.
    """
    spark = d.sparkSession
    pick = lambda found, by: found.agg(F.min(F.struct(by, "b")).alias("x")).first()["x"]
    medoids = [pick(d.groupBy("b").agg(F.sum("distance").alias("cost")), "cost")["b"]]

    def near() -> DataFrame:
        """(a, m, n1, n2): position of the nearest medoid, a medoid's own first, and the two least distances."""
        at = spark.createDataFrame(list(enumerate(medoids)), "m int, b string")
        first = F.struct(F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("other"), "distance", "m")
        got = d.join(F.broadcast(at), "b").groupBy("a").agg(F.slice(F.array_sort(F.collect_list(first)), 1, 2).alias("x"))
        second = F.when(F.size("x") > 1, F.col("x")[F.size("x") - 1]["distance"]).otherwise(float("inf"))
        return written(got.select("a", F.col("x")[0]["m"].alias("m"), F.col("x")[0]["distance"].alias("n1"), second.alias("n2")), "near")

    def others(at: DataFrame) -> DataFrame:
        return d.join(F.broadcast(spark.createDataFrame([(x,) for x in medoids], "b string")), "b", "left_anti").join(F.broadcast(at), "a")

    at = near()
    while len(medoids) < k:
        gain = others(at).groupBy("b").agg((-F.sum(F.greatest(F.col("n1") - F.col("distance"), F.lit(0.0)))).alias("loss"))
        medoids.append(pick(gain, "loss")["b"])
        at = near()
    while True:
        kept, moved = F.least("distance", "n1"), F.least("distance", "n2")
        by = others(at).groupBy("b", "m").agg(F.sum(kept - F.col("n1")).alias("all"), F.sum(moved - kept).alias("own"))
        # Every medoid is near itself, so each candidate has a row for each of them.
        best = by.groupBy("b").agg(F.sum("all").alias("all"), F.min(F.struct("own", "m")).alias("x"))
        best = best.agg(F.min(F.struct((F.col("all") + F.col("x.own")).alias("change"), "x.m", "b")).alias("x")).first()["x"]
        cost = at.agg(F.sum("n1")).first()[0]
        if best is None or not best["change"] < -1e-9 * cost - 1e-12:
            break
        medoids[best["m"]] = best["b"]
        at = near()
    # Clusters are numbered by their first word.
    order = [r["m"] for r in at.groupBy("m").agg(F.min("a").alias("a")).orderBy("a").collect()]
    number = spark.createDataFrame([(m, str(i + 1)) for i, m in enumerate(order)], "m int, cluster string")
    return at.join(F.broadcast(number), "m").select(F.col("a").alias("w"), "cluster")


def majority(assigned: DataFrame) -> DataFrame:
    """(cluster, label): the most frequent gold class of each cluster, ties to the first in the alphabet."""
    w = Window.partitionBy("cluster").orderBy(F.desc("count"), "gold")
    counts = assigned.groupBy("cluster", "gold").count()
    return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster", F.col("gold").alias("label"))


def purity(assigned: DataFrame) -> DataFrame:
    """One row (purity): percent of items (cluster, gold) in the majority class of their cluster."""
    best = assigned.groupBy("cluster", "gold").count().groupBy("cluster").agg(F.max("count").alias("best"), F.sum("count").alias("all"))
    return best.agg((100.0 * F.sum("best") / F.sum("all")).alias("purity"))


def entropy(assigned: DataFrame, scale: bool = False) -> DataFrame:
    """One row (entropy): mean entropy of gold classes in clusters, in bits, weighted by size; ``scale`` divides by that of the gold classes."""
    counts = assigned.groupBy("cluster", "gold").count()
    sizes = counts.groupBy("cluster").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    total = sizes.agg((F.sum(F.col("all") * F.log2("all") - F.col("s")) / F.sum("all")).alias("entropy"))
    if not scale:
        return total
    gold = assigned.groupBy("gold").count().agg((F.log2(F.sum("count")) - F.sum(F.col("count") * F.log2("count")) / F.sum("count")).alias("h"))
    return total.crossJoin(gold).select((F.col("entropy") / F.col("h")).alias("entropy"))


def clustering_details(task: DataFrame, table: DataFrame, form: str | None = None, clusters: int | None = None, word: str = "word", gold: str = "class", pairs_up_to: int = 5000, **how) -> DataFrame:
    """(word, cluster, label, gold, correct, missing); words without a vector are the cluster n/a.

    Up to ``pairs_up_to`` words are partitioned by all their distances, more by sampled medoids
    (:mod:`.medoids`; distances with their usual options only).
    """
    rows = task.select(F.col(word).alias("word"), _words(word, form).alias("w"), F.col(gold).cast("string").alias("gold"))
    known = table.select(F.col(table.columns[0]).cast("string").alias("term")).distinct()
    if how.get("info") is not None:
        known = known.join(how["info"].select("term"), "term", "left_semi")
    words = written(known.join(rows.select(F.col("w").alias("term")), "term", "left_semi"), "words")
    many = words.count()
    k = min(rows.select("gold").distinct().count() if clusters is None else clusters, many)
    if k and many > pairs_up_to:
        if not set(how) <= {"method", "p", "info"}:
            raise ModelError("sampled medoids take method, p and info only")
        cells = values(table).join(words.select(F.col("term").alias("target")), "target", "left_semi")
        found = medoids.sampled_medoids(cells, k, **{x: v for x, v in how.items() if x != "info"}, info=words).assigned.select(F.col("term").alias("w"), "cluster")
    elif k:
        transform = how.pop("transform", None)
        half = distances(table, terms=words, skip_missing=True, **how).where("a > b")
        half = half.select("a", "b", (transform(F.col("distance")) if transform else F.col("distance")).alias("distance"))
        half = written(half, "distances")
        every = half.union(half.select("b", "a", "distance")).union(words.select("term", "term", F.lit(0.0)))
        found = medoid_clusters(written(every, "pairs"), k)
    else:
        found = words.select(F.col("term").alias("w"), F.lit(None).cast("string").alias("cluster"))
    assigned = rows.join(found, "w", "left")
    assigned = assigned.select("word", F.coalesce("cluster", F.lit("n/a")).alias("cluster"), "gold", F.col("cluster").isNull().alias("missing"))
    out = assigned.join(majority(assigned), "cluster")
    return out.select("word", "cluster", "label", "gold", (F.col("label") == F.col("gold")).alias("correct"), "missing")


def clustering(task: DataFrame, table: DataFrame, scale_entropy: bool = False, **how) -> DataFrame:
    """One row: purity in percent, entropy, missing words."""
    found = written(clustering_details(task, table, **how), "clusters")
    lost = found.agg(F.sum(F.col("missing").cast("long")).alias("missing"))
    return purity(found).crossJoin(entropy(found, scale_entropy)).crossJoin(lost)


def linkage(d: np.ndarray, how: str = "complete") -> list[tuple[int, int, float]]:
    """Hierarchical clustering of a small distance matrix: (cluster, cluster, height) of each step, new clusters from len(d) on."""
    how = named(how, ["complete", "single", "average"], "linkage")
    live: dict[int, list[int]] = {i: [i] for i in range(len(d))}
    join = {"complete": np.max, "single": np.min, "average": np.mean}[how]
    out = []
    while len(live) > 1:
        height, a, b = min((float(join(d[np.ix_(live[a], live[b])])), a, b) for a in live for b in live if a < b)
        live[len(d) + len(out)] = live.pop(a) + live.pop(b)
        out.append((a, b, height))
    return out


def scaled_map(found: DataFrame, most: int = 2000) -> DataFrame:
    """Two-dimensional coordinates (term, x, y) of a full distance table (a, b, distance), by classical scaling.

    For more than ``most`` terms, or maps that keep stress low, see :func:`.maps.stress_map`; for more
    terms than a matrix on the driver holds, trees are in :mod:`.trees`.
    """
    rows = found.limit(most * most + 1).collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    if len(names) > most or len(rows) > most * most:
        raise ModelError(f"a map has at most {most} terms")
    at = {x: i for i, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = r["distance"]
    centre = np.eye(len(d)) - 1 / max(1, len(d))
    power, turn = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre) if len(d) else (np.zeros(0), np.zeros((0, 0)))
    xy = turn[:, ::-1][:, :2] * np.sqrt(np.maximum(power[::-1][:2], 0)) if len(d) > 1 else np.zeros((len(d), 2))
    return found.sparkSession.createDataFrame([(x, float(xy[i, 0]), float(xy[i, 1])) for i, x in enumerate(names)], "term string, x double, y double")


def nearest_point(points: DataFrame, x: float, y: float, within: float = float("inf")) -> DataFrame:
    """The point of a map (term, x, y) nearest to a place: (term, x, y, distance); none if it is further than ``within``."""
    far = F.hypot(F.col("x") - F.lit(float(x)), F.col("y") - F.lit(float(y)))
    return points.withColumn("distance", far).where(F.col("distance") <= F.lit(within)).orderBy("distance", "term").limit(1).select("term", "x", "y", "distance")


def map_edges(found: DataFrame | Swept, similarity: bool = False, share: float = 2 / 3) -> DataFrame:
    """Edges (a, b, distance, strength) of a map: pairs nearer than the quantile, strength from 0 to 1."""
    # The quantile comes from counts by ranges, so no task holds all distances.
    if isinstance(found, Swept):
        pairs, (at, *ends) = found.table(compact=True), quantile(found, 1 - share if similarity else share)
        cut = pairs.sparkSession.createDataFrame([(at, *ends)], "cut double, lo double, hi double")
    else:
        pairs = kept(found, "distances").where("a < b")
        at = exact_quantile(pairs, "distance", 1 - share if similarity else share)
        cut = pairs.agg(F.lit(at).cast("double").alias("cut"), F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    near = F.col("distance") >= F.col("cut") if similarity else F.col("distance") <= F.col("cut")
    gap = F.col("hi") - F.col("lo")
    strength = (F.col("distance") - F.col("lo")) / gap if similarity else (F.col("hi") - F.col("distance")) / gap
    return pairs.crossJoin(F.broadcast(cut)).where(near).select("a", "b", "distance", F.when(gap == 0, 1.0).otherwise(strength).alias("strength"))
