"""Toxicity by weak supervision.

Voters are words of a small seed lexicon, words and word beginnings mined from labelled
training rows, and surface patterns.  A generative label model (each voter fires with one
rate on toxic and another on clean texts) is fitted by expectation-maximisation on the
votes of all documents; pairwise correlations of voters given the class, estimated in the
same posterior, share out the weight of voters that say the same thing twice.  A linear
classifier over hits is then trained on posterior labels of a bounded sample of training
rows.  Scores come from the text alone.

Null and empty texts have no hits and get the score of a text without evidence.  Repeated
rows are scored each on their own; repeated labels of a document are one toxic label if any
is toxic.  Without labels the seed lexicon and patterns vote alone.  Very long texts are
read whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import slices, written

#: Plain insults that vote toxic before anything is learned.
SEED_LEXICON = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")

_WORD = re.compile(r"[^\W\d_]+")
_BANG = re.compile(r"[!?]{3,}")
_STARS = re.compile(r"\b\w\*{2,}\w*")
PATTERNS = ("exclamations", "masked word", "shouting")


@dataclass(frozen=True)
class Lexicon:
    """Voters, by bit: seed words, groups of mined words, groups of mined beginnings, patterns.

    Beginnings of words carry a ``^``.  A group votes if any of its terms is in the text.
    """

    terms: tuple[str, ...]  # classifier features: seed words, then mined terms, strongest first
    word_groups: int = 28
    start_groups: int = 18

    @property
    def voters(self) -> int:
        return len(SEED_LEXICON) + self.word_groups + self.start_groups + len(PATTERNS)

    @property
    def bits(self) -> dict[str, int]:
        """The voter of each term: terms are dealt to the groups in turn."""
        out, words, starts = {t: i for i, t in enumerate(SEED_LEXICON)}, 0, 0
        for t in self.terms:
            if t in out:
                continue
            if t[0] == "^":
                out[t] = len(SEED_LEXICON) + self.word_groups + starts % self.start_groups
                starts += 1
            else:
                out[t] = len(SEED_LEXICON) + words % self.word_groups
                words += 1
        return out


def terms_of(text: str, start: int = 5) -> set[str]:
    """Words in lower case, and beginnings of longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {"^" + w[:start] for w in words if len(w) > start}


def patterns_of(text: str) -> list[bool]:
    """Runs of exclamation or question marks, masked words, all in capitals."""
    return [bool(_BANG.search(text)), bool(_STARS.search(text)), text.isupper()]


#: Shares of the strongest term's evidence that are tried, largest first.
SHARES = tuple(2.0 ** (-k / 2) for k in range(21))


def mine(texts: DataFrame, terms: int = 4000, evidence: float = 25.0, share: float | None = None) -> Lexicon:
    """Terms of toxic texts, from training rows (doc_id, text, toxic).

    A term is kept if it has at least ``share`` of the strongest term's evidence: words that
    toxic texts hold by chance gain evidence with the number of texts as voters do, so only a
    share of it keeps them out.  Without ``share`` a quarter of the training rows chooses it,
    with terms rated by the others.
    """
    if share is None:
        part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
        share = chosen_share(texts.where(part == 0), rated(texts.where(part != 0), terms, evidence))
    top = rated(texts, terms, evidence)
    kept = [term for term, rate in top if rate >= share * top[0][1]]
    return Lexicon(tuple(dict.fromkeys((*SEED_LEXICON, *kept))))


def chosen_share(texts: DataFrame, top: list[tuple[str, float]]) -> float:
    """The share at which the kept terms part toxic from clean ``texts`` best: most toxic ones held, fewest clean ones.

    Of equally good shares the middle one; a text counts by its strongest term.
    """
    strength = {term: rate / top[0][1] for term, rate in top} if top else {}

    def run(batches):
        import pyarrow as pa

        held = np.zeros((2, len(SHARES) + 1), dtype=np.int64)
        for b in slices(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                best = max((strength.get(t, 0.0) for t in terms_of(text or "")), default=0.0)
                held[toxic, next((k for k, s in enumerate(SHARES) if best >= s), len(SHARES))] += 1
        label, k = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(k, pa.int32()), pa.array(held[label, k], pa.int64())], names=["toxic", "k", "n"])

    found = np.zeros((2, len(SHARES) + 1))
    for r in texts.select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, k int, n long").groupBy("toxic", "k").agg(F.sum("n").alias("n")).collect():
        found[r["toxic"], r["k"]] = r["n"]
    rates = found.cumsum(1)[:, :-1] / np.maximum(found.sum(1, keepdims=True), 1)
    gap = rates[1] - rates[0]
    best = np.flatnonzero(gap >= gap.max() - 1e-9)
    return SHARES[int(best[len(best) // 2])]


def rated(texts: DataFrame, terms: int, evidence: float) -> list[tuple[str, float]]:
    """The ``terms`` strongest terms of ``texts`` (text, toxic) with their evidence, strongest first.

    Per term, toxic and clean texts that hold it are counted over all rows given.  A term counts
    if its log-likelihood ratio is at least ``evidence`` and over 0.8 of its texts would be toxic
    at equal class sizes.
    """

    def count(batches):
        import pyarrow as pa

        toxic: dict[str, int] = {}
        clean: dict[str, int] = {}
        n = [0, 0]

        def flush():
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic.get(k, 0) for k in keys], pa.int64()), pa.array([clean.get(k, 0) for k in keys], pa.int64())],
                names=["term", "toxic", "clean"],
            )
            toxic.clear()
            clean.clear()

        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[label] += 1
                into = toxic if label else clean
                for t in terms_of(text or ""):
                    into[t] = into.get(t, 0) + 1
            if len(toxic) + len(clean) > 500_000:
                yield from flush()
        toxic[""], clean[""] = n[1], n[0]  # the classes' sizes, under a term no text has
        yield from flush()

    counts = texts.select("text", F.col("toxic").cast("int")).mapInArrow(count, "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts.where((F.col("toxic") > 1) | (F.col("term") == "")), "terms")
    sizes = counts.where(F.col("term") == "").select(F.col("toxic").alias("nt"), F.col("clean").alias("nc"))
    found = counts.where(F.col("term") != "").join(F.broadcast(sizes))
    pt, pc = (F.col("toxic") + 0.5) / (F.col("nt") + 1), (F.col("clean") + 0.5) / (F.col("nc") + 1)
    both = F.col("toxic") + F.col("clean")
    base = F.col("nt") / (F.col("nt") + F.col("nc"))
    hit = F.col("toxic") * F.log(F.col("toxic") / (both * base))
    miss = F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - base)))).otherwise(0.0)
    found = found.where(F.col("nc") > 0).withColumn("rate", 2 * (hit + miss)).where((F.col("rate") >= evidence) & (pt / (pt + pc) > 0.8))
    return [tuple(r) for r in found.orderBy(F.desc("rate"), "term").select("term", "rate").limit(terms).collect()]


def vote(docs: DataFrame, lexicon: Lexicon, extra: list[str]) -> DataFrame:
    """``extra`` columns, votes (a bit a voter) and hits (indices of features the text holds)."""

    def run(batches):
        import pyarrow as pa

        lex = lexicon
        bits = {k: 1 << i for k, i in lex.bits.items()}
        feature = {k: i for i, k in enumerate(lex.terms)}
        first = lex.voters - len(PATTERNS)
        for b in slices(batches):
            votes, hits = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                text = text or ""
                held = [t for t in terms_of(text) if t in feature]
                v = 0
                for t in held:
                    v |= bits[t]
                for i, on in enumerate(patterns_of(text)):
                    v |= on << (first + i)
                votes.append(v)
                hits.append(sorted(feature[t] for t in held))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(votes, pa.int64()), pa.array(hits, pa.list_(pa.int32()))], names=[*extra, "votes", "hits"]
            )

    picked = docs.select(*extra, F.col("text").cast("string").alias("text"))
    schema = picked.drop("text").schema.add("votes", "long").add("hits", ArrayType(IntegerType()))
    return picked.mapInArrow(run, schema)


@dataclass
class LabelModel:
    """Firing rates by class, the prior, and what share of its evidence each voter keeps."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(toxic) for rows of 0/1 votes."""
        on = np.log(self.toxic / self.clean)
        off = np.log((1 - self.toxic) / (1 - self.clean))
        odds = math.log(self.prior / (1 - self.prior)) + (fired * (on - off) + off) @ self.share
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _unpack(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n)) & 1).astype(float)


def _moments(patterns: DataFrame, model: LabelModel, pairs: bool, only_known: bool) -> np.ndarray:
    """Sums under the posterior: P, n, fired·P, fired·(1-P) and, with ``pairs``, co-firing by class.

    Where a training label is known it is the posterior.
    """
    n = len(model.toxic)

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            x, known, c = _unpack(b.column(0).to_numpy(), n), b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            p = np.where(known < 0, model.posterior(x), known)
            c = np.where((known < 0) & only_known, 0.0, c)
            pt, pc = p * c, (1 - p) * c
            parts = [np.array([pt.sum(), c.sum()]), pt @ x, pc @ x]
            if pairs:
                parts += [((x * pt[:, None]).T @ x).ravel(), ((x * pc[:, None]).T @ x).ravel()]
            flat = np.concatenate(parts)
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    # One short vector a task; the sums are of (2 + 2 n + 2 n²) numbers at most.
    got = patterns.mapInArrow(run, "sums array<double>").toLocalIterator()
    size = 2 + 2 * n + (2 * n * n if pairs else 0)
    out = np.zeros(size)
    for r in got:
        out += np.asarray(r["sums"])
    return out


def fit_label_model(votes: DataFrame, voters: int, rounds: int = 6) -> LabelModel:
    """EM over vote patterns; ``votes`` holds votes and toxic (null: not known) of every document.

    Patterns are counted first, so rounds read a table of patterns, not documents.  The first
    round sees known labels alone, if there are any.  From the middle on each round estimates the
    correlations of voters given the class anew, and a voter's share of its evidence is
    1 / (1 + sum of its strong correlations with others).
    """
    known = F.coalesce(F.col("toxic").cast("int"), F.lit(-1)).alias("known")
    patterns = written(votes.groupBy("votes", known).count(), "votes").coalesce(6)
    model = LabelModel(0.05, np.full(voters, 0.2), np.full(voters, 0.002), np.ones(voters))
    for k in range(rounds):
        pairs = k >= rounds // 2
        s = _moments(patterns, model, pairs, only_known=k == 0)
        pt, c = s[0], s[1]
        if pt == 0 or pt == c:
            continue
        ft, fc = s[2 : 2 + voters], s[2 + voters : 2 + 2 * voters]
        toxic = (ft + 0.2) / (pt + 1)
        clean = (fc + 0.02) / (c - pt + 1)
        share = model.share
        if pairs:
            at = 2 + 2 * voters
            excess = np.zeros((voters, voters))
            for x, n, mean in ((s[at : at + voters**2], pt, toxic), (s[at + voters**2 :], c - pt, clean)):
                both = x.reshape(voters, voters) / (n + 1)
                var = np.maximum(mean * (1 - mean), 1e-6)
                excess = np.maximum(excess, (both - np.outer(mean, mean)) / np.sqrt(np.outer(var, var)) * (n > 50))
            np.fill_diagonal(excess, 0)
            share = 1 / (1 + np.where(excess > 0.7, excess, 0).sum(1))
        # A voter that fires no more on toxic texts than on clean ones has nothing to say.
        share = np.where(toxic <= 1.5 * clean, 0.0, np.maximum(share, 0.05))
        prior = model.prior if k == 0 else min(max(pt / c, 1e-4), 0.5)
        model = LabelModel(prior, np.clip(toxic, 1e-6, 1 - 1e-6), np.clip(clean, 1e-6, 1 - 1e-6), share)
    return model


def train_classifier(rows: list[tuple[list[int], float]], features: int, steps: int = 60) -> np.ndarray:
    """Logistic regression on (hits, posterior label); the last weight is the bias.

    A hit counts as present or not; weights are drawn to 0 a little.  Newton's diagonal sets
    the step of each weight.
    """
    w = np.zeros(features + 1)
    if not rows:
        w[-1] = -4.0
        return w
    at = np.concatenate([np.full(len(h), i) for i, (h, _) in enumerate(rows)] or [np.zeros(0)]).astype(int)
    col = np.concatenate([np.asarray(h, dtype=int) for h, _ in rows])
    y = np.array([p for _, p in rows])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    many = np.bincount(at, minlength=len(y)) + 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(at, w[col], len(y)), -40, 40)))
        g, h = p - y, np.maximum(p * (1 - p), 1e-4) * many
        w[:-1] -= 0.7 * (np.bincount(col, g[at], features) + 0.05 * w[:-1]) / (np.bincount(col, h[at], features) + 0.05)
        w[-1] -= 0.7 * g.sum() / (h.sum() + 0.05)
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    label_model: LabelModel
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, training: Column, label_rows: int = 60_000, train_rows: int = 20_000):
    """(model, votes of all documents as a written table of doc_id, votes, hits).

    At most about ``label_rows`` labelled training rows are mined and ``train_rows`` train the
    classifier, picked by a hash of doc_id; the label model sees the votes of all documents.
    """
    gold = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    gold = gold.groupBy("doc_id").agg(F.max(F.col("toxic")).alias("toxic")).where(training)
    picked = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 20))
    share = min(1.0, label_rows / max(1, gold.count()))
    few = gold.where(picked < F.lit(int(share * (1 << 20))))
    # ``few`` is bounded by label_rows, so texts stay where they are.
    lexicon = mine(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"))
    votes = written(vote(docs, lexicon, ["doc_id"]), "votes")
    label_model = fit_label_model(votes.join(gold, "doc_id", "left"), lexicon.voters)
    part = min(1.0, train_rows / max(1, votes.count()))
    sample = votes.where(training & (picked < F.lit(int(part * (1 << 20))))).select("votes", "hits")
    hits, packed = [], []
    for r in sample.toLocalIterator():
        hits.append(r["hits"])
        packed.append(r["votes"])
    p = label_model.posterior(_unpack(np.array(packed, dtype=np.int64), lexicon.voters)) if packed else []
    weights = train_classifier(list(zip(hits, p, strict=True)), len(lexicon.terms))
    return ToxicityModel(lexicon, label_model, weights), votes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(votes: DataFrame, model: ToxicityModel) -> DataFrame:
    """A votes table with its score; other columns of the table stay."""
    shared = votes.sparkSession.sparkContext.broadcast(model.weights)
    names = [*votes.columns, "score"]
    at = votes.columns.index("hits")

    def run(batches):
        import pyarrow as pa

        w = shared.value
        for b in batches:
            hits = b.column(at)
            many = np.diff(hits.offsets.to_numpy())
            row = np.repeat(np.arange(len(many)), many)
            odds = w[-1] + np.bincount(row, w[hits.flatten().to_numpy()], len(many))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sigmoid(odds))], names=names)

    return votes.mapInArrow(run, StructType([*votes.schema.fields, StructField("score", DoubleType())]))


def keep_clean(docs: DataFrame, model: ToxicityModel, reject: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        w = model.weights
        feature = {k: i for i, k in enumerate(model.lexicon.terms)}
        for b in slices(batches):
            odds = [w[-1] + sum(w[feature[t]] for t in terms_of(x or "") if t in feature) for x in b.column(at).to_pylist()]
            yield b.filter(pa.array(_sigmoid(np.array(odds)) < reject))

    return docs.mapInArrow(run, docs.schema)
