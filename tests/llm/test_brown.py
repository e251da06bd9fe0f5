import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termfield.llm import brown
from termfield.llm.queries import op2_brown


def words_of(text):
    raw = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw] + [None]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fold = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 for d in docs}
    c = collections.Counter(w for d in docs if fold[d.doc_id] != 1 for w in words_of(d.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in op2_brown(spark, sf).collect()}
    assert len(got) == len(docs)
    better = 0
    for d in docs:
        r, w = got[d.doc_id], words_of(d.text)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, fold[d.doc_id] == 1)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score <= 0
        better += r.held_out and r.score > r.base_score
    held = sum(r.held_out for r in got.values())
    assert better / held > 0.6


def class_of(m, tail, w):
    """A word's class: common words by their unit, other known ones by the tail table, unknown ones by shape."""
    return tail[w] if w in tail else int(m.cls[m.units.of(w)])


def test_model_is_a_distribution(spark):
    """Over all known words and the unknown one of each class, probabilities after any class sum to 1."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a d", "c c a b b", "e f"])], "doc_id long, text string")
    m, tail = brown.learn(docs, F.lit(True), classes=4, common=4, buckets=3, least=1)
    counts = dict(zip(m.units.common, m.counts, strict=True)) | {bytes(r["word"]): r["n"] for r in tail.collect()}
    where = {bytes(r["word"]): r["cls"] for r in tail.collect()}
    assert len(counts) == 7 and sum(counts.values()) == m.tokens == 18
    for before in range(4):
        total = sum(10 ** (m.log_move[before, k] + m.log_unknown[k]) for k in range(4))
        for w, n in counts.items():
            k = class_of(m, where, w)
            total += 10 ** m.log_move[before, k] * (n - m.discount) / m.class_tokens[k]
        assert abs(total - 1) < 1e-9


def test_score_against_plain_sum(spark):
    """Every document's score by walking its tokens one by one over the same model, with few common words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    m, tail = brown.learn(docs, F.col("doc_id") % 5 != 1, classes=16, common=500, buckets=64, least=3)
    known = {bytes(r["word"]): r for r in tail.collect()}
    n = dict(zip(m.units.common, m.counts, strict=True)) | {w: r["n"] for w, r in known.items()}
    where = {w: r["cls"] for w, r in known.items()}
    assert len(where) > 1000 and len(set(where.values())) > 8 and sum(n.values()) == m.tokens
    got = {r.doc_id: r for r in brown.score(docs, m, tail).collect()}
    unknown = 0
    for d in docs.collect():
        c, total = class_of(m, where, brown.END), 0.0
        for w in words_of(d.text):
            w = brown.END if w is None else w
            k = class_of(m, where, w)
            total += m.log_move[c, k] + (math.log10((n[w] - m.discount) / m.class_tokens[k]) if w in n else m.log_unknown[k])
            unknown += w not in n
            c = k
        assert abs(got[d.doc_id].score - total) < 1e-6 * max(1, abs(total)), d.doc_id
    assert unknown > 100


@pytest.mark.parametrize("common,least", [(500, 3), (6, 2), (2, 1)])
def test_transitions_are_those_of_the_final_classes(spark, common, least):
    """Class bigrams counted token by token with the classes that all words have in the end, also where few words are common."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("text").limit(60)
    m, tail = brown.learn(docs, F.lit(True), classes=8, common=common, buckets=32, least=least)
    where = {bytes(r["word"]): r["cls"] for r in tail.collect()}
    moved = sum(k != m.cls[m.units.of(w)] for w, k in where.items())
    counts = np.zeros((8, 8))
    for d in docs.collect():
        ids = [class_of(m, where, brown.END if w is None else w) for w in [None, *words_of(d.text)]]
        np.add.at(counts, (ids[:-1], ids[1:]), 1)
    assert moved > 50 and counts.sum() == m.tokens and (counts.sum(0) == m.class_tokens).all()
    share = (m.class_tokens + 0.5) / (m.class_tokens + 0.5).sum()
    assert np.allclose(10**m.log_move, (counts + 4.0 * share) / (counts.sum(1, keepdims=True) + 4.0), rtol=1e-9)


def test_bigrams_are_those_of_the_texts(spark):
    """Unit bigrams, also where units are summed in salted groups and tables are flushed early."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").repartition(5)
    want = collections.Counter()
    units = brown.Units([brown.END, b"the", b"der", b"la"], 16)
    for d in docs.collect():
        ids = [units.of(brown.END if w is None else w) for w in [None, *words_of(d.text)]]
        want.update(zip(ids, ids[1:]))
    got = collections.Counter()
    table = brown.bigrams(docs, units, np.array([0, 1]), gather=50).toArrow()
    for b in table.to_batches():
        row, slot, other, n = brown.entries(b)
        unit = slot * units.blocks + b.column(0).to_numpy()[row]
        for u, o, side, k in zip(unit.tolist(), other.tolist(), b.column(1).to_numpy()[row].tolist(), n.tolist(), strict=True):
            got[(*((u, o) if side else (o, u)), side)] += k
    assert max(got.values()) > 255 and len(got) == sum(len(brown.entries(b)[0]) for b in table.to_batches())
    assert got == {(*k, side): n for k, n in want.items() for side in (0, 1)}


def test_clustering_improves(spark):
    """The likelihood never falls, ends well above its start, and tokens lie in most classes; the counts are those of the classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    m, _ = brown.learn(docs, F.lit(True), classes=32)
    table = brown.written(brown.bigrams(docs, m.units, np.zeros(0, int)), "bigrams")
    # The same with a head of 300 units first, as large vocabularies have it.
    cls, counts, history = brown.cluster(table, m.units, 32, head=300)
    assert (counts == brown.class_bigrams(table, cls, 32, m.units.blocks)).all() and cls.max() < 32
    assert all(a < b for a, b in zip(history, history[1:])) and history[-1] - history[0] > 0.05 * abs(history[0])
    assert abs(history[-1] - m.history[-1]) < 0.03 * abs(m.history[-1])
    assert all(a < b for a, b in zip(m.history, m.history[1:]))
    assert m.history[-1] - m.history[0] > 0.05 * abs(m.history[0])
    share = np.sort(m.class_tokens)[::-1] / m.class_tokens.sum()
    assert (share > 0).sum() > 24 and share[0] < 0.35


def test_quick_gains_agree_with_exact_ones():
    rng = np.random.default_rng(1)
    counts = rng.integers(2_000, 40_000, (6, 6)).astype(float)
    for _ in range(50):
        old = int(rng.integers(6))
        before, after = rng.integers(0, 12, 6).astype(float), rng.integers(0, 12, 6).astype(float)
        got = brown.quick_gains(np.array([old]), before[None], after[None], counts)[0]
        best = brown.best_class(old, before, after, 0.0, counts, counts.sum(1), counts.sum(0))
        assert got[best] >= got.max() - 0.05


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 20, (6, 6)).astype(float)
    a, b = counts[:, :3].sum(0), counts.sum(1)
    assert a.shape == (3,) and b.shape == (6,)
    cls = np.array([0, 1, 2, 0, 1, 2])

    def likelihood(k):
        t = np.zeros((3, 3))
        np.add.at(t, (k[:, None].repeat(6, 1), k[None, :].repeat(6, 0)), counts)
        x = lambda z: np.where(z > 0, z * np.log(np.maximum(z, 1)), 0).sum()
        return x(t) - x(t.sum(1)) - x(t.sum(0)), t

    for u in range(6):
        now, t = likelihood(cls)
        before, after = np.bincount(cls, counts[:, u], 3), np.bincount(cls, counts[u], 3)
        best = brown.best_class(cls[u], before, after, counts[u, u], t, t.sum(1), t.sum(0))
        options = []
        for k in range(3):
            other = cls.copy()
            other[u] = k
            options.append(likelihood(other)[0])
        assert options[best] >= max(options) - 1e-9 and options[best] >= now - 1e-9
        cls[u] = best


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "A b", 0), (3, "A b", 0), (None, "zz top b", 0), (4, "w x " * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    m, words = brown.learn(docs, F.col("doc_id") > 1, classes=4, common=3, buckets=4, least=1)
    got = {r.doc_id: r for r in brown.score(docs, m, words).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[1].score == got[2].score
    assert got[None].n_tokens == 4 and got[None].n_known == 2 and got[4].n_tokens == 200_001 and got[4].n_known == 200_001
    none, words = brown.learn(docs, F.lit(False))
    assert {(r.score, r.base_score, r.n_known) for r in brown.score(docs, none, words).collect()} == {(0.0, 0.0, 0)}
    assert brown.score(docs.limit(0), m, words).collect() == []


def test_rare_words_keep_their_shape_without_another_pass(spark, tables):
    """Where no word beyond the common ones is frequent, the pass over texts gives what the words alone give."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("text").limit(40)
    words = brown.count_words(docs)
    top = [bytes(r["word"]) for r in words.where("n >= 5").collect()]
    units = brown.Units(sorted(top), 32)
    cls = (np.arange(units.size) % 7).astype(np.int16)
    rows = lambda df: {(bytes(r["word"]), r["n"], r["cls"]) for r in df.collect()}
    short = rows(brown.shape_classes(words.where("n < 5"), units, cls))
    # The end of a text is no word to move.
    end = {r for r in short if r[0] == brown.END}
    assert short and short == rows(brown.tail_classes(brown.tail_places(docs, units, cls, 7), np.ones((7, 7)), 5)) | end
    # Fewer common words: those beyond that are frequent, through a filter.
    units, counts = brown.Units(sorted(top)[::3], 32), np.random.default_rng(1).integers(1, 50, (7, 7)).astype(float)
    every = rows(brown.tail_classes(brown.tail_places(docs, units, cls, 7), counts, 5))
    frequent = words.where("n >= 5").where(~F.col("word").isin(units.common))
    few = rows(brown.tail_classes(brown.tail_places(docs, units, cls, 7, brown.word_filter(frequent)), counts, 5))
    assert {r for r in every if r[1] >= 5} == {r for r in few if r[1] >= 5} and len(few) < 0.7 * len(every)


ODD = [None, "", " ", "\t\n", " A b", "b \x0b\x0c\r c ", "x\x1cy\x85z w", "\x00 É ﬁ 漢字 ٣², a...", "end of THE the"]


def test_lots_of_texts_are_looked_up_at_once(monkeypatch):
    """Tokens, units and rare words are those of a plain walk; one lookup serves a lot, also where the end is not common."""
    import types

    import pyarrow as pa
    import pyarrow.compute as pc

    calls = []
    find = lambda *a, **b: calls.append(1) or pc.index_in(*a, **b)
    monkeypatch.setattr(brown, "pc", types.SimpleNamespace(**{k: getattr(pc, k) for k in dir(pc)} | {"index_in": find}))
    texts = [t and t.encode() for t in ODD * 200] + [b"\xc3 \xff\xa9A. \xc3"]
    for common in ([brown.END, b"b", b"the"], [b"b"]):
        units = brown.Units(common, 64)
        batches = pa.Table.from_arrays([pa.array(texts, pa.binary())], names=["text"]).to_batches(max_chunksize=100)
        got, rare = [], []
        for c in brown.coded(iter(batches), units):
            assert c.rows.num_rows <= 256 and len(c.unit) == c.ends[-1] and len(c.at) == len(c.words)
            got += [x.tolist() for x in np.split(c.unit, c.ends[:-1])]
            rare += c.words
        plain = [(t or b"").lower().split() + [brown.END] for t in texts]
        assert got == [[units.of(w) for w in ws] for ws in plain]
        assert rare == [w for ws in plain for w in ws if w not in common]
    assert len(calls) == 2


def test_shapes_are_hashed_once_an_ending():
    def plain(word, buckets):
        text = word.decode("utf-8", "replace")
        letters = "".join(filter(str.isalpha, text))
        odd = 0 if letters == text else 1 + (text[-1:] in ".,;:") + 2 * any(map(str.isdigit, text)) + 4 * (text[-3:].count(text[-1:]) == 3)
        h = 2166136261
        for c in letters[-2:] + chr(48 + odd):
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h % buckets

    words = [w.encode() for t in ODD if t for w in re.split("[ \n]", t)] + [b"", b"\xff.", b"a\xc3.\xa9", b"\xc31\xa9", "x²".encode(), b"1...", "é9,".encode()]
    words += [b"w%dng" % i for i in range(1000)]
    assert [brown.shape_bucket(w, 1024) for w in words] == [plain(w, 1024) for w in words]
    before = brown._ending.cache_info().misses
    for i in range(1000):
        brown.shape_bucket(b"q" * i + b"zq", 1024)
    assert brown._ending.cache_info().misses <= before + 1
