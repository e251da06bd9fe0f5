import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from termfield.llm import merkle
from termfield.llm.queries import op11_merkle

NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def plain(docs):
    """Of a list of (doc_id, text) without ties: what the query says, from texts side by side on one machine."""
    docs = sorted((i, t or "") for i, t in docs)
    out = {}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        prints = [merkle.fingerprint(merkle.tree(t)) for t in (text, edited, following)]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], merkle.likeness(prints[0], prints[1]), merkle.likeness(prints[0], prints[2]))
    return out


def test_the_query_equals_a_plain_walk(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in op11_merkle(spark, tables).collect()}
    assert got == plain(docs)
    # An edit keeps about half of a text; another document shares little, but for copies.
    near = [v[4] for v in got.values() if v[0] > 500]
    assert 0.35 < sum(near) / len(near) < 0.65
    assert sum(v[4] > v[5] for v in got.values()) > 0.9 * len(got)


def test_ranges_without_rows_and_many_ranges(spark):
    docs = [(i * 7 % 101, f"Text {i}. And more of {i % 5}.\nA line.\n" * (i % 4)) for i in range(101)]
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = merkle.succession(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
            assert {r.doc_id: tuple(r[n] for n in NAMES) for r in got.collect()} == plain(docs)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@given(st.text(alphabet="ab.\n !é", max_size=60), st.text(alphabet="ab.\n !é", max_size=60))
def test_roots_tell_texts_apart(a, b):
    x, y = merkle.tree(a), merkle.tree(b)
    assert (x.hash == y.hash) == (a == b) == (merkle.fingerprint(x) == merkle.fingerprint(y))
    assert merkle.alike(x, y) == pytest.approx(merkle.likeness(merkle.fingerprint(x), merkle.fingerprint(y)))
    assert 0 <= merkle.alike(x, y) <= 1 and merkle.alike(x, y) == merkle.alike(y, x)
    # Replacing what differs turns one into the other.
    u, v, out, at = a.encode(), b.encode(), b"", 0
    for s, e, s2, e2 in merkle.differing(x, y):
        out += u[at:s] + v[s2:e2]
        at = e
    assert out + u[at:] == v


def test_edits_are_located(spark):
    old = "".join(f"Paragraph {i} says this. It also says that {i}.\n" for i in range(200))
    new = old.replace("Paragraph 77 says this. ", "Paragraph 77 säys other. ").replace("Paragraph 150 says this. It also says that 150.\n", "")
    docs = lambda t: spark.createDataFrame([(1, t, 0), (2, "same", 0), (3, None, 0)], "doc_id long, text string, start int")
    got = sorted(tuple(r) for r in merkle.edits(docs(old), docs(new)).collect())
    assert [g[0] for g in got] == [1, 1]
    (_, s, e, s2, e2), (_, s3, e3, s4, e4) = got
    assert old[s:e] == "Paragraph 77 says this. " and new[s2:e2] == "Paragraph 77 säys other. "
    assert "Paragraph 150" in old[s3:e3] and "Paragraph 150" not in new[s4:e4] and e3 - s3 < 1500
    marks = {r.doc_id: r.fingerprint for r in merkle.fingerprints(docs(old)).collect()}
    assert marks[3] == merkle.fingerprint(merkle.tree("")) and marks[1].count("/") > 5


def test_edges(spark):
    rows = [(5, "a. b.", 1), (5, "a. b.", 2), (None, "x", 3), (7, None, 4), (8, "", 5), (9, "long " * 200_000, 6), (9, "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_chars) for r in merkle.succession(docs).collect())
    assert got == [(-1, 1), (5, 5), (5, 5), (7, 0), (8, 0), (9, 5), (9, 1_000_000)]
    by = {(r.doc_id, r.n_chars): r for r in merkle.succession(docs).collect()}
    assert by[7, 0].near_edited == 1.0 and by[7, 0].near_next == 1.0 and by[8, 0].near_next == 0.0
    one = merkle.succession(docs.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert merkle.succession(docs.limit(0)).collect() == [] and merkle.fingerprints(docs.limit(0)).collect() == []
