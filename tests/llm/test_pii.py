import hashlib
import re
import time

import numpy as np

from termfield.llm import pii
from termfield.llm.queries import op3_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def plain(text):
    """Base spans by the patterns as they are given."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "a@b.c d@e", "@x.y a@@b.c", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "+1 (555) 010-9999", "+12", "++49 30 123456 7",
    "é@b.de mail: jane(at)site.org", "a.b@c.d.e.f-", "4111  1111 1111 1111", "", "12345678901234567890123",
]


def test_base_is_the_plain_patterns(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == plain(t), t[:200]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op3_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want, r = plain(d.text or ""), got[d.doc_id]
        written = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",") if r.spans else [])


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "call +49 30 1234567", 0), (3, "call +49 30 1234567", 0), (None, "x@y.zz", 0), (4, "no data here " * 100_000 + "1.2.3.4", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    model = pii.learn(docs)
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone) for r in pii.find(docs, model).collect())
    assert got == [(0, 1, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 1), (3, 0, 0, 1), (4, 0, 1, 0)]
    masked = pii.redact(docs, model)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "call <PHONE>" and texts[4].endswith("<IP>")
    assert pii.find(docs.limit(0), pii.learn(docs.limit(0))).collect() == []


def test_written_out_addresses_with_a_plain_dot_are_offered():
    """What else stands in the text does not decide whether a span is a candidate."""
    text = "mail: jane.doe at example.com"
    for t in (text, text + ", or ask (at) the desk"):
        assert ["jane.doe at example.com"] == [t[a:b] for k, a, b in pii.offers(t, []) if pii.KINDS[k] == "email"]


PLANTED = [
    "contact jane.doe(at)example.com today", "mail bob at site dot org please", "write to ann_1 [at] web [dot] net now", "email joe at firm.com",
    "call (555) 210-9943 now", "phone 619 555 1368 today", "tel 030 1234 5678 bitte", "server 10[.]0[.]12[.]7 is down", "from host 192 dot 168 dot 1 dot 20 again",
    "card 4111.1111.1111.1111 was charged", "visa 5500/0000/0000/0004 expired",
]
LOOK_ALIKES = [
    "we met at home. Then we left", "look at this. Now", "he was at work. She too", "on 2024-01-05 it rained", "between 1999.12.31 and later", "pages 100-200 300", "about 12 000 000 people",
    "number 1234.5678.9012.3456 failed", "id 9999-0000-1111-2223", "sizes 900[.]800[.]700[.]999 here",
]


def test_candidates_are_accepted_and_refused(spark):
    """Written-out data beside base data of the same kinds becomes spans; look-alikes do not."""
    base = ["mail ann@site.org or call +49 30 1234567", "server 10.0.0.1 took card 4111 1111 1111 1111", "tel +1 (619) 555-1368, joe@web.com"]
    rows = [(i, t, 0) for i, t in enumerate((base + PLANTED) * 12 + LOOK_ALIKES * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    model = pii.learn(docs)
    for t in PLANTED:
        found, more = pii.spans_of(t, model)
        assert not found and len(more) == 1, t
    for t in LOOK_ALIKES:
        assert pii.offers(t, []) and pii.spans_of(t, model)[1] == [], t
    added = pii.find(docs, model).where("n_added > 0").count()
    assert added == 12 * len(PLANTED)
    assert len({r.text for r in pii.redact(docs.limit(3 + len(PLANTED)), model).collect() if any(c.isdigit() for c in r.text)} & set(PLANTED)) == 0


def test_without_candidates_the_start_rates_decide(spark):
    model = pii.learn(spark.createDataFrame([], "text string"))
    assert pii.spans_of("contact jane.doe(at)example.com today", model)[1] and not pii.spans_of("we met at home. Then we left", model)[1]


def test_long_runs_take_linear_time():
    """A million characters of digits, dots, signs and names: seconds, no crash, and the plain patterns' result on short ones."""
    model = pii.SpanModel(np.full(4, 0.3), np.full((4, 5), 0.8), np.full((4, 5), 0.3), np.zeros((4, 11)))
    n = 1_000_000
    start = time.process_time()
    for t in ("0" * n + ".1.1.1", "1." * (n // 2), "." * n, "@" * n, "a" * n + " at ", "a@" * (n // 2), "+1" * (n // 2), "1 " * (n // 2), "12-" * (n // 3), "555 010 9999, " * (n // 14), "x at y.z " * (n // 9)):
        pii.spans_of(t, model)
    assert time.process_time() - start < 60
    for t in ("0" * 300 + ".1.1.1", "0" * 300 + "1.2.3.4 5", "1.2.3.4" * 20, "00.1..2.3.4.5", "1" * 200 + ".2.3.4", "+1" * 40, "a@b." * 30, "@.1.1.1.1@"):
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == plain(t)
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]
