import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from termfield.llm import dropout as d

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PLAIN, VARIED = d.Encoder(MODEL, 0.0, 1), d.Encoder(MODEL, 0.3, 1)


def ids(enc, text, doc=1):
    return list(memoryview(enc.packed(text, doc)).cast("I"))


def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_without_dropout_is_the_library(spark):
    sp = SentencePieceProcessor(model_file=MODEL)
    for t in [*texts(spark), "  a  b ", "\t x\n", "aaaa" * 200, "Ⅳ ﬁ é 漢字"]:
        assert ids(PLAIN, t) == sp.encode(t)
        assert d.decoded(sp.encode(t), PLAIN.pieces) == t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_comes_back(t):
    t = t.encode("utf-8", "ignore").decode()
    for enc in (PLAIN, VARIED):
        assert d.decoded(ids(enc, t), enc.pieces) == t


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcthein", min_size=1, max_size=120), st.integers(0, 3))
def test_both_agendas_agree(t, variant):
    """The agendas that run side by side do what the heap does, and what a plain list of ranks does."""
    key = variant * 77 + 5
    symbols = np.array([VARIED.pieces.symbol(p) for p in VARIED._long(t, key)])
    for e in (VARIED, PLAIN):
        if len(t) <= d._BESIDE - 1 and (d._MARK + t) not in e.words:
            e._learn([d._MARK + t])
    if len(t) <= d._BESIDE - 1:
        word = np.array([VARIED.words[d._MARK + t]])
        assert VARIED._run(word, np.array([key], dtype=np.uint64))[0].tolist() == symbols.tolist()
    ranks, parts, starts, skipped = VARIED.pieces.ranks, list(t), list(range(len(t) + 1)), set()
    while True:
        offers = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks and tuple(starts[i : i + 3]) not in skipped]
        if not offers:
            break
        i = min(offers)[1]
        if VARIED.skips(key, *starts[i : i + 3]):
            skipped.add(tuple(starts[i : i + 3]))
        else:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del starts[i + 1]
    assert parts == VARIED._long(t, key)


def test_space_sign_in_text():
    for t in (d.SPACE, f"a{d.SPACE} b", f"{d.SPACE}{d.SPACE} {d.SPACE}"):
        assert d.decoded(ids(VARIED, t), VARIED.pieces) == t


def test_dropout_varies_and_repeats(spark):
    t = " ".join(texts(spark)[:5])
    a, b = ids(VARIED, t, 1), ids(VARIED, t, 2)
    assert a != b and len(a) > len(ids(PLAIN, t))
    assert a == ids(d.Encoder(MODEL, 0.3, 1), t, 1) != ids(d.Encoder(MODEL, 0.3, 2), t, 1)


def test_rate_of_skips():
    n = sum(VARIED.skips(k * 0x9E3779B97F4A7C15, s, s + 1, s + 2) for k in range(200) for s in range(50))
    assert abs(n / 10_000 - 0.3) < 0.02


@pytest.mark.parametrize("rate", [0.0, 0.1])
def test_tables(spark, rate):
    rows = [(1, None, 5), (2, "", 5), (3, "the cat", 5), (3, "the cat", 5), (None, "the cat", 5), (4, "long " * 50_000 + "x" * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tokens = d.encode(docs, MODEL, rate)
    back = d.decode(tokens, MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    full = d.round_trip(docs, MODEL, rate).collect()
    assert all(r.lossless for r in full)
    assert sorted(r.n_tokens for r in full) == sorted(len(r.ids) for r in tokens.collect())
    assert d.round_trip(docs.limit(0), MODEL).collect() == []


def test_every_occurrence_has_its_own_draws():
    """Many occurrences of one word get far more than four segmentations."""
    text = " ".join(["internationalization"] * 3000)
    back, cut = d.decoded(ids(VARIED, text), VARIED.pieces), set()
    assert back == text
    word = []
    for i in ids(VARIED, text):
        piece = VARIED.pieces.bytes[i]
        if piece[:1] == b" " and word:
            cut.add(tuple(word))
            word = []
        word.append(piece)
    assert len(cut) > 50


def test_batches_do_not_matter():
    """A text's tokens are the same alone, among others, after forgetting, and beside long segments."""
    texts = ["the unbelievable tokenization", None, "", "abcabcabc " * 30, "lengthy" * 40 + " end", f"a{d.SPACE}b  c ", "é漢字🙂 " * 5]
    got, ends = VARIED.batch(texts, range(7))
    small = d.Encoder(MODEL, 0.3, 1, keep=2)
    start = 0
    for k, (t, end) in enumerate(zip(texts, ends.tolist())):
        assert got[start:end].tolist() == ids(small, t, k) == ids(VARIED, t, k)
        start = end
