import math

from pyspark.sql import functions as F

import corpus_pipeline as cp
from termfield.llm import langid, nearcopies, pii, toxicity


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, sf).cache()
        assert out.columns == docs.columns, name
        assert out.schema == at.schema or [f.dataType for f in out.schema] == [f.dataType for f in at.schema]
        assert out.count() <= at.count()
        if name == "near_copies":
            found = nearcopies.near_copies(at.select("doc_id", "text"))
            assert out.count() == found.select("class_id").distinct().count()
            assert {r.doc_id for r in out.collect()} == {r.class_id for r in found.collect()}
        if name == "language":
            assert out.count() >= 0.9 * at.count()
        if name == "personal_data":
            assert out.count() == at.count() and not any(pii.base_spans(r.text) for r in out.collect() if r.text)
        at = out
    packed = cp.STAGES[-1][1](spark, at, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in at.collect()}
    assert langid.UNDETERMINED == "und"


def odd_documents(spark):
    """Documents with nulls, empty and repeated rows, and columns that operators use names of."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None), (5000, "", "en", "x", 0), (5001, "...", "en", None, 3), (5002, rows[2][1] * 40, "en", "x", None)]
    rows += [(5003, rows[3][1] + " mail jane.doe@example.com or +49 30 1234567", "en", "x", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, mark string, _mark string, votes int, hits string, score double, row_id long, held boolean, extra string"
    more = [("m", None, 1, "h", 0.5, 7, True, "q"), (None, "m", None, None, None, None, None, None)]
    return spark.createDataFrame([(*r, *more[k % 2]) for k, r in enumerate(rows)], names)


def test_odd_documents_pass_every_stage(spark):
    docs = odd_documents(spark)
    schema, at = docs.schema, docs
    for name, stage in cp.STAGES[:-1]:
        at = cp.written(stage(spark, at, "/root/testdata/sf0.001"), name)
        assert at.columns == docs.columns and [f.dataType for f in at.schema] == [f.dataType for f in schema], name
    kept = at.collect()
    known = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    assert kept and all(tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars")) in known for r in kept)
    assert len({r.text for r in kept}) == len(kept) and not any("@" in (r.text or "") for r in kept)
    packed = cp.STAGES[-1][1](spark, at, "/root/testdata/sf0.001").collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(r.doc_id) for r in kept)
    at = docs.limit(0)
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, "/root/testdata/sf0.001"), name)
        assert at.collect() == []


def test_stages_against_their_operators(spark):
    """What each stage keeps, decided document by document with the stage's own model and plain calls."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model, _ = toxicity.learn(docs, labels, F.lit(True))
    weight = dict(zip(model.lexicon.terms, model.weights[:-1], strict=True))
    odds = lambda t: model.weights[-1] + sum(weight.get(x, 0.0) for x in toxicity.terms_of(t or ""))
    rows = docs.collect()
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, "/root/testdata/sf0.001").collect()}
    assert kept == {r.doc_id for r in rows if 1 / (1 + math.exp(-odds(r.text))) < 0.7}
    model = langid.learn(docs, F.lit(True))
    coder = langid.Coder(model.dictionaries)
    told = {r.doc_id: coder.predict(r.text) for r in rows}
    kept = {r.doc_id for r in cp.drop_unidentified(spark, docs, "").collect()}
    assert kept == {i for i, (lang, _, margin) in told.items() if lang != "und" and margin >= model.narrow}
    spans = pii.learn(docs)
    for r, new in zip(sorted(rows), sorted(cp.mask_personal_data(spark, docs, "").collect()), strict=True):
        text = r.text or ""
        for kind, a, b in sorted(pii.spans_of(text, spans)[1], key=lambda s: -s[1]):
            text = text[:a] + f"<{pii.KINDS[kind].upper()}>" + text[b:]
        assert (new.text or "") == text


def test_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r.offset + r.length for r in got) <= 2048
