import collections
import re

import numpy as np
import pytest

from termfield.llm import nearcopies as nc


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0))


def similarity(a, b):
    both = sum((a & b).values())
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 1.0


def classes(bags, threshold=0.8):
    """Smallest index of each component, by comparing all pairs."""
    root = list(range(len(bags)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bags)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(bags))]


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(5)
    base = nc.mixed(np.arange(1, 61, dtype=np.uint64))
    hits = []
    for trial in range(40):
        items = (nc.mixed(base + np.uint64(trial * 1000)) >> np.uint64(32)).astype(np.uint32)
        wa, wb = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
        a, b = np.flatnonzero(wa), np.flatnonzero(wb)
        sig = nc.signatures(
            np.concatenate([items[a], items[b]]), np.concatenate([wa[a], wb[b]]), np.repeat([0, 1], [len(a), len(b)]), 2, 256
        )
        hits.append((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(hits)) < 0.012  # 40 · 256 components: standard error 0.005


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = classes([bag(r.text) for r in rows])
    want = {r.doc_id: rows[k].doc_id for r, k in zip(rows, want, strict=True)}
    got = nc.near_copies(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert sum(r.kept for r in got) == len(set(want.values()))


def test_chain_of_near_copies_is_one_class(spark):
    """Each text is near the next one only; no leader is near all."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * i : 8 * i + 100]) for i in range(30)]
    bags = [bag(t) for t in texts]
    assert similarity(bags[0], bags[1]) > 0.8 and similarity(bags[0], bags[3]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = nc.near_copies(docs).collect()
    assert {r.class_id for r in got} == {0}


def test_crowded_buckets_match_brute_force(spark):
    """Heavily edited copies of one text, most pairs of them not near: all buckets count as crowded."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words[rng.integers(0, 3) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes([bag(t) for t in texts])
    assert len(set(want)) > 5
    for crowd in (1, 10_000):
        got = {r.doc_id: r.class_id for r in nc.near_copies(docs, bands=60, rows=3, crowd=crowd).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_block_comparison_is_overlap():
    rng = np.random.default_rng(4)
    items = []
    for _ in range(12):
        h = np.unique(rng.integers(0, 40, 30).astype(np.uint32))
        items.append((nc.packed(h), b"" if rng.random() < 0.4 else rng.integers(1, 4, len(h)).astype(np.uint32).tobytes()))
        assert (nc.unpacked(nc.packed(h)) == h).all()
    items[3] = items[0]
    for threshold in (0.3, 0.5, 0.8):
        got = set(nc.comparer(threshold)([list(c) for c in zip(*items)], [list(c) for c in zip(*items)]))
        assert got == {(i, j) for i in range(12) for j in range(12) if nc.overlap(*items[i], *items[j]) >= threshold}


CASES = [
    (1, None, 1), (2, "", 1), (3, "one two", 3), (4, "One, two!", 3), (4, "One, two!", 3), (5, "a b c d e f", 5),
    (None, "a b c d e f", 5), (6, "word " * 300_000, 6), (7, "word " * 290_000, 6), (8, "...", 1),
]


def test_edges(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t, _ in CASES], "doc_id long, text string, mark string, class_id int")
    got = nc.near_copies(docs).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(d, c) for d, _, c in CASES], key=str)
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 4
    assert nc.near_copies(docs.limit(0)).collect() == []
    assert nc.keep_one(docs.limit(0)).collect() == []


def test_keep_one_loses_no_row(spark):
    """Columns with the names the operator uses, nulls that stand in different columns, whole rows that repeat."""
    rows = [
        (1, "one two three four five six", None, "x", "a"), (1, "one two three four five six", None, "x", "a"),
        (None, "one two three four", None, None, "b"), (None, None, "one two three four", None, "b"), (2, "seven eight nine ten eleven", "y", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, _mark string, mark_0 string")
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted({r for r in rows}, key=str)
    assert [r.a for r in nc.keep_one(spark.createDataFrame([("x", 1, "t", "u")], "a string, doc_id long, text string, `b``.c` string")).collect()] == ["x"]


@pytest.mark.parametrize("text", ["", "a b", "a b c d e", "x y z " * 50])
def test_shingles_against_counter(text):
    h, c = nc.shingles(text, nc.WordHashes())
    assert sorted(c) == sorted(bag(text).values()) and len(h) == len(bag(text))
