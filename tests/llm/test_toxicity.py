import numpy as np
from pyspark.sql import functions as F

from termfield.llm import toxicity as tx
from termfield.llm.queries import op1_toxicity


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "toxic").collect()
    pos, neg = np.array([r.score for r in got if r.toxic]), np.array([r.score for r in got if not r.toxic])
    auc = (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2
    assert len(pos) > 10 and auc > 0.85
    assert (neg >= 0.7).mean() < 0.05


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "you pathetic idiot scum"), (3, "you pathetic idiot scum"), (None, "fine day"), (4, "quiet words " * 100_000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, votes int, toxic int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model, votes = tx.learn(docs, labels, F.lit(True))
    got = tx.score(votes, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] and by[3] > by[4]
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    none, votes = tx.learn(docs, labels.limit(0), F.lit(True))
    assert tx.score(votes, none).count() == len(rows)
    empty, votes = tx.learn(docs.limit(0), labels, F.lit(True))
    assert tx.score(votes, empty).collect() == []


def test_label_model_recovers_rates(spark):
    rng = np.random.default_rng(3)
    n, voters = 20_000, 5
    y = rng.random(n) < 0.2
    hit, false = np.array([0.7, 0.5, 0.6, 0.4, 0.05]), np.array([0.02, 0.05, 0.01, 0.03, 0.05])
    fired = rng.random((n, voters)) < np.where(y[:, None], hit, false)
    votes = (fired * (1 << np.arange(voters))).sum(1)
    known = np.where(rng.random(n) < 0.1, y.astype(int), -1)
    table = spark.createDataFrame([(int(v), None if k < 0 else int(k)) for v, k in zip(votes, known, strict=True)], "votes long, toxic int")
    model = tx.fit_label_model(table, voters)
    assert np.abs(model.toxic[:4] - hit[:4]).max() < 0.06 and np.abs(model.clean[:4] - false[:4]).max() < 0.02
    assert abs(model.prior - 0.2) < 0.03 and model.share[4] == 0
