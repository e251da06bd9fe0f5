"""Personal data by aggregated weak labels.

Base spans follow fixed patterns and always stay.  Beside them, loose patterns propose
candidates: written-out addresses, host numbers with guarded dots, digit groups that may be
card or telephone numbers.  Regex, gazetteer and context labelers vote on every span.
Expectation-maximisation over counts of vote patterns of all documents estimates each
labeler's reliability, with base spans held to be personal data, and a classifier over votes
and the form of the span, trained on the posteriors, decides which candidates become spans.
Offsets are code points, end exclusive.

Null and empty texts have no spans.  Very long texts, long runs of digits, dots or signs
among them, are searched whole, in time that grows with the text.  Repeated rows get the same
result each.  Nothing is learned from doc_id, lang or source.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_OFFER = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]++)++", re.IGNORECASE
    ),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?| dot )[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\) ?)?[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,4}(?![0-9])|(?<![0-9])00[0-9]{2}[ ()0-9-]{6,14}[0-9](?![0-9])"),
}
_MARKED_AT = re.compile(r" at |\(at\)|\[at\]|\{at\}", re.IGNORECASE)

#: Words that go before or after personal data, by kind, in the four languages at hand.
CONTEXT = {
    "email": {"email", "mail", "contact", "correo", "courriel", "write", "address"},
    "ip": {"ip", "host", "server", "address", "from", "login"},
    "card": {"card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "telefon", "telefono", "fax", "contact"},
}
#: Common top-level domains.
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu", "us"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _number(digits: str) -> int:
    """The value of a run of digits; 1000 for all long ones."""
    digits = digits.lstrip("0")
    return 1000 if len(digits) > 3 else int(digits or 0)


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping addresses: around each @, the longest run before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(_number(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def offers(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser candidates that touch no base span and not each other."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, pattern in _OFFER.items():
        if kind == "email":
            if not _MARKED_AT.search(text):
                continue
        elif not _DIGIT.search(text):
            break
        new = []
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect_right(taken, (a, len(text)))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                continue
            if kind == "phone" and not 7 <= sum(map(str.isdigit, m[0])) <= 15:
                continue
            new.append((a, b))
        out += [(KINDS.index(kind), a, b) for a, b in new]
        taken = sorted(taken + new)
    return sorted(out)


#: The first bit tells base spans; the others are the labelers.
LABELERS = ("fixed pattern", "check digits, ranges or shape", "gazetteer", "context word", "bare surroundings", "usual length")
FORMS = ("words for signs", "brackets", "blanks", "dots or slashes", "several kinds of signs")


def votes_of(text: str, kind: int, start: int, end: int, fixed: bool) -> int:
    """A bit for each labeler that takes the span for personal data, then a bit for each trait of its form."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    name = KINDS[kind]
    if name == "email":
        tail = re.split(r"@|\(at\)|\[at\]|\{at\}| at ", span, maxsplit=1, flags=re.IGNORECASE)[-1]
        # A full stop with a blank beside it ends a sentence.
        checked = bool(re.search(r"[A-Za-z]", span)) and ". " not in tail and " ." not in tail and ".." not in span
        listed = re.split(r"[^a-z0-9]+", span.lower())[-1] in DOMAINS
        usual = 6 <= len(span) <= 64
    elif name == "ip":
        parts = re.findall("[0-9]+", span)
        checked = all(_number(p) <= 255 and (p == "0" or p[0] != "0") for p in parts)
        listed = _number(parts[0]) not in (0, 255) and _number(parts[0]) < 240
        usual = 4 <= len(digits) <= 12
    elif name == "card":
        checked = luhn(digits)
        listed = digits[:1] in ("3", "4", "5", "6")
        usual = len(digits) in (15, 16)
    else:
        # Years in front or behind make a date.
        checked = len(set(digits)) > 2 and not re.match(r"(?:19|20)[0-9]{2}[ ./-]|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}$", span)
        listed = span[:1] in ("+", "(") or digits[:1] == "0" or bool(re.fullmatch(r"[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}", span))
        usual = 9 <= len(digits) <= 13
    near = set(re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-4:]) | set(re.findall(r"[^\W\d_]+", text[end : end + 24].lower())[:2])
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    bare = not re.search(r"[\w@/:=+$€£%#-]", around)
    signs = {c for c in span if not c.isalnum()}
    form = (bool(re.search(r"\b(?:at|dot)\b", span, re.IGNORECASE)), bool(signs & set("()[]{}")), " " in signs, bool(signs & set("./")), len(signs) > 1)
    return sum(x << i for i, x in enumerate((fixed, checked, listed, bool(near & CONTEXT[name]), bare, usual, *form)))


@dataclass
class SpanModel:
    """Reliabilities of the labelers by kind, and the weights of the final classifier."""

    prior: np.ndarray  # by kind: share of personal data among candidates
    hit: np.ndarray  # kind x labeler: rate on personal data
    false: np.ndarray  # kind x labeler: rate on other spans
    weights: np.ndarray  # kind x (labelers, forms, bias)

    def accepts(self, kind: int, votes: int) -> bool:
        return _features(np.array([votes]))[0] @ self.weights[kind] >= 0


def _features(votes: np.ndarray) -> np.ndarray:
    """Labelers' votes and form, without the bit that tells base spans, and a bias."""
    bits = ((votes[:, None] >> np.arange(1, len(LABELERS) + len(FORMS))) & 1).astype(float)
    return np.column_stack([bits, np.ones(len(votes))])


def learn(docs: DataFrame, rounds: int = 40) -> SpanModel:
    """Fit on the votes of every span of ``docs`` (text).

    Only counts of (kind, votes) reach the driver: at most 4 · 2^11 rows.
    """

    def run(batches):
        import pyarrow as pa

        seen: dict[tuple[int, int], int] = {}
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for spans, fixed in ((base, True), (offers(text, base), False)):
                    for kind, start, end in spans:
                        key = kind, votes_of(text, kind, start, end, fixed)
                        seen[key] = seen.get(key, 0) + 1
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int32()), pa.array([v for _, v in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["kind", "votes", "n"],
            )

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, votes int, n long")
    rows = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    k, m = len(KINDS), len(LABELERS) - 1
    model = SpanModel(np.full(k, 0.3), np.full((k, m), 0.8), np.full((k, m), 0.3), np.zeros((k, m + len(FORMS) + 1)))
    for kind in range(k):
        votes = np.array([r["votes"] for r in rows if r["kind"] == kind], dtype=int)
        n = np.array([r["n"] for r in rows if r["kind"] == kind], dtype=float)
        _fit(model, kind, votes, n, rounds)
    return model


def _fit(model: SpanModel, kind: int, votes: np.ndarray, n: np.ndarray, rounds: int) -> None:
    """EM for the labelers of one kind, then its classifier.

    Base spans are personal data by definition.  Of each pattern of votes there is a thousandth
    of a candidate more than there is, labelled by the start rates, so that kinds without
    candidates have a classifier too.
    """
    m = len(LABELERS) - 1
    every = np.arange(2**m) << 1
    votes, n = np.concatenate([votes, every]), np.concatenate([n, np.full(2**m, 1e-3)])
    f, fixed = _features(votes), (votes & 1) > 0
    x = f[:, :m]
    for _ in range(rounds):
        hit, false = model.hit[kind], model.false[kind]
        odds = np.log(model.prior[kind] / (1 - model.prior[kind])) + x @ np.log(hit / false) + (1 - x) @ np.log((1 - hit) / (1 - false))
        p = np.where(fixed, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        loose = np.where(fixed, 0.0, n)
        model.prior[kind] = (p @ loose + 3) / (loose.sum() + 10)
        # Weak priors keep rates apart where a kind has few spans; few base spans count whole, many like 1000.
        mine = np.where(fixed, n * min(1.0, 1000 / max(1.0, n[fixed].sum())), n)
        model.hit[kind] = np.clip(((p * mine) @ x + 8) / (p @ mine + 10), 0.02, 0.98)
        model.false[kind] = np.clip((((1 - p) * loose) @ x + 3) / ((1 - p) @ loose + 10), 0.02, 0.98)
    weight = loose / loose.sum() + np.where(fixed, n / max(1.0, n[fixed].sum()), 0.0)
    w = np.zeros(f.shape[1])
    for _ in range(1500):
        q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        w -= 1.0 * (f.T @ (weight * (q - p)) + 1e-3 * w)
    model.weights[kind] = w


def spans_of(text: str, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    more = [s for s in offers(text, base) if model.accepts(s[0], votes_of(text, *s, False))]
    return base, sorted(base + more)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of base spans, spans of all, n_added."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for b in slices(batches):
            counts, digests, texts, added = [], [], [], []
            for text in b.column(1).to_pylist():
                base, spans = spans_of(text or "", model)
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
                texts.append(written_spans(spans))
                added.append(len(spans) - len(base))
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(digests), pa.array(texts), pa.array(added, pa.int64())], names=names)

    out = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows if it is there."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, free = [], 0
        for kind, start, end in sorted(spans_of(text, model)[1], key=lambda s: (s[1], -s[2])):
            if start >= free:
                out += [text[free:start], f"<{KINDS[kind].upper()}>"]
            free = max(free, end)
        return "".join([*out, text[free:]]) if out else text

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            old = b.column(at).to_pylist()
            new = [clean(t) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if chars is not None:
                n = [len(x) if x is not None and x is not y else c for x, y, c in zip(new, old, cols[chars].to_pylist(), strict=True)]
                cols[chars] = pa.array(n, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
