import random
import zlib

from pyspark.sql import functions as F

from termfield.llm import langid
from termfield.llm.queries import op8_langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_langid(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.values())
    test = [d for d in docs if got[d.doc_id].held_out and d.lang and d.text]
    right = lambda some: sum(got[d.doc_id].lang_pred == d.lang for d in some) / len(some)
    assert right(test) > 0.95 and right([d for d in test if len(d.text) > 200]) > 0.97
    out = [d for d in test if got[d.doc_id].rejected]
    assert 0 < len(out) < 0.05 * len(test)


def test_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs, F.lit(True))
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "les éeaux que avec pour est dans une " * 9, "x"), (4, "les éeaux que avec pour est dans une " * 9, "x"), (None, "the and of", "y"), (5, "der die und " * 50_000, "z")]
    mine = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(mine, model).collect()
    by = {(r.doc_id): r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert by[4].lang_pred == "fr" and by[5].lang_pred == "de"
    kept = langid.keep_identified(mine, model)
    assert kept.columns == mine.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4, 5]
    assert langid.identify(mine.limit(0), model).collect() == []
    assert langid.learn(mine.limit(0), F.lit(True)) == langid.LanguageModel()
    assert {(r.lang_pred, r.rejected) for r in langid.identify(mine, langid.LanguageModel()).collect()} == {("und", True)}


def test_narrow_margins_are_rejected(spark):
    """With the margin that is learned: gibberish and evenly mixed texts mostly go, texts of one language stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, F.lit(True))
    assert model.narrow > 0.01
    rng = random.Random(3)
    long = [r for r in docs.where("length(text) > 2000 and lang is not null").collect()]
    by = {x: [langid.normal(r.text).split() for r in long if r.lang == x] for x in ("en", "de", "fr")}
    plain = [" ".join(w[:200]) for ws in by.values() for w in ws[:60]]
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(60)]
    mixed = [" ".join(w for pair in zip(a[:200], b[:200], c[:200]) for w in pair) for a, b, c in zip(*(ws[:40] for ws in by.values()))]
    rows = [(kind, t) for kind, ts in enumerate((plain, gibberish, mixed)) for t in ts]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    share = [sum(r.rejected for r in found if r.doc_id == k) / len(ts) for k, ts in enumerate((plain, gibberish, mixed))]
    assert share[0] < 0.05 and share[1] > 0.95 and share[2] > 0.5, share
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert kept.count() == sum(not r.rejected for r in found)


def test_a_language_of_long_texts_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    de = " ".join(langid.normal(r.text) for r in docs.where("lang = 'de'").limit(60).collect())
    rows = [(i, r.text, "en") for i, r in enumerate(docs.where("lang = 'en'").limit(60).collect())] + [(100, de, "de"), (101, None, "fr"), (102, "...", "es")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(de) > 100_000 and sorted(model.dictionaries) == ["de", "en"] and len(model.dictionaries["de"]) > 30_000


def test_the_smallest_encoding_wins():
    coder = langid.Coder({"a": b"alpha beta gamma delta " * 300, "b": b"one two three four five " * 300})
    assert coder.predict("alpha beta gamma delta alpha beta")[0] == "a"
    assert coder.predict("one two three four five one two")[0] == "b"


def test_number_signs_are_no_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs, F.lit(True))
    rows = [(1, "\u00bd"), (2, "\u00b2\u00b3 \u2460 \u2167"), (3, "12 _ \u0301"), (4, "\u00bda"), (5, "\u4e2d")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred == "und" for i in range(1, 6)] == [True, True, True, False, False]
    assert langid.normal("A\u00bdb \u00b2 c1d \u00c9t\u00e9") == "a b c d \u00e9t\u00e9"


def test_prediction_is_the_smallest_plain_encoding(spark):
    """Every text encoded anew with every dictionary by encoders made for it alone, quick, and once more where that is close."""
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs, F.lit(True))
    coder = langid.Coder(model.dictionaries)
    plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    quick = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=14, chain_log=14, search_log=3, **plain)
    thorough = z.ZstdCompressionParameters.from_level(12, **plain)

    def size(lang, data, params):
        held = model.dictionaries[lang]
        d = z.ZstdCompressionDict(held[: len(held) * 7 // 8], dict_type=z.DICT_TYPE_RAWCONTENT)
        return sum(len(z.ZstdCompressor(dict_data=d, compression_params=params).compress(data[i : i + 8192])) for i in range(0, len(data), 8192))

    seen = same = 0
    for r in docs.select("text").limit(120).collect():
        data = langid.normal(r.text or "").encode()
        if len(data) < 400:
            continue
        sizes = {x: size(x, data, quick) for x in coder.langs}
        best, second = sorted(sizes.values())[:2]
        if second - best < 0.06 * second:
            sizes = {x: size(x, data, thorough) for x in coder.langs}
        whole = {x: size(x, data, thorough) for x in coder.langs}
        least = min(sizes, key=lambda x: (sizes[x], x))
        assert coder.predict(r.text)[0] == least
        seen, same = seen + 1, same + (least == min(whole, key=lambda x: (whole[x], x)))
    assert seen > 50 and same >= 0.97 * seen
