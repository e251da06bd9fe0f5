import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from termfield.llm import packing as pk
from termfield.llm.queries import op6_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def expected(docs, size=2048):
    """(doc_id, piece, start, length, crc32) with the library alone."""
    tok, out = Tokenizer.from_file(VOCABULARY), []
    for doc, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            out.append((doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out, key=str)


def assert_packed(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = op6_packing(spark, "/root/testdata/sf0.001").collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == expected(docs)
    need = -(-sum(r.length for r in got) // 2048)
    assert assert_packed(got) <= need * 1.02 + 1


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "It's <|endoftext|> É ﬁ 漢字 12ab", 0), (3, "It's <|endoftext|> É ﬁ 漢字 12ab", 0), (None, "a b", 0), (4, "long text " * 60_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pk.best_fit_packing(docs, VOCABULARY).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == expected([r[:2] for r in rows])
    assert_packed(got)
    assert pk.best_fit_packing(docs.limit(0), VOCABULARY).collect() == []


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for size in (10, 64):
        for _ in range(20):
            counts = np.zeros(size + 1, dtype=np.int64)
            counts[1:] = rng.integers(0, 30, size) * (rng.random(size) < 0.6)
            used, bins = np.zeros(size + 1, dtype=np.int64), 0
            for lengths, times in pk.plan(counts, size):
                assert times > 0 and sum(lengths) <= size
                np.add.at(used, lengths, times)
                bins += times
            assert (used == counts).all()
            lower = -(-int((np.arange(size + 1) * counts).sum()) // size)
            larger = int(counts[size // 2 + 1 :].sum())
            assert bins <= max(lower, larger) * 1.15 + 2


def test_exact_complements_are_found():
    counts = np.zeros(11, dtype=np.int64)
    counts[[7, 2, 1]] = 5
    assert pk.plan(counts, 10) == [([7, 2, 1], 5)]


def test_a_triple_is_found_behind_many_longer_first_lengths():
    """Over 64 longer lengths only reach the gap with a piece that is already held."""
    import numpy as np

    from termfield.llm.packing import _Stock

    counts = np.zeros(2400, dtype=np.int64)
    x = np.arange(1190, 1332, 2)
    counts[x], counts[1700 - x], counts[301], counts[667] = 1, 1, 1, 3
    assert _Stock(counts).exact(2001, [301]) == [667, 667, 667]


def test_new_words_of_many_texts_are_encoded_together(monkeypatch):
    """One call of the library serves all texts, with the ids that it gives for each alone."""
    enc, tok, alone = pk.WordEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), []
    direct = enc._direct
    monkeypatch.setattr(enc, "_direct", lambda words: alone.append(words) or direct(words))
    plain = ["", "can't we'll ''s !!'d a'b 12 éßÿ  \t\r\n x", "À-Ö'RE ~~", *(f"Word{i} quoi{i}é, %{i}..." for i in range(300))]
    ids = lambda t: struct.pack(f"<{len(x := tok.encode(t, add_special_tokens=False).ids)}I", *x)
    assert enc.packed(plain) == [ids(t) for t in plain] and not alone
    odd = ["a <|endoftext|> b", "漢字 É ﬁ", plain[1] * 50_000]
    assert enc.packed(odd) == [ids(t) for t in odd] and alone == [odd[:1], odd[1:2]]
    # Where words don't stay apart they are encoded one by one.
    assert enc._words(["a b", "c"]) == direct(["a b", "c"]) and alone[2:] == [["a b", "c"]]
