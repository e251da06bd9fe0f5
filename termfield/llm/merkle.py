"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text is cut without loss: a paragraph is a line with its break, a sentence ends after ``.``,
``!`` or ``?`` and the blanks behind it, and a section ends at a blank line or after a paragraph
whose hash says so (one in eight), so that an insertion moves no later border.  Leaves are
hashes of sentences; each level hashes the one below.  Equal roots mean equal texts; where roots
differ, branches that differ lead to the edits (:func:`edits`).

A fingerprint is the root, then the first 32 bits of each leaf, paragraphs parted by ``-`` and
sections by ``/``.  The likeness of two fingerprints is 1 where they are equal, else the Dice
coefficient of their leaves as multisets: what equal branches hold of both.

Defined cases: a null text is empty, an empty text has a root and no leaf, and its likeness to
any other text is 0.  Repeated rows are fingerprinted each on their own.  An empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

_CUT = re.compile(rb"[.!?][ \t]+|\n")
#: A paragraph's hash below this ends its section.
_BORDER = 32


@dataclass(frozen=True)
class Node:
    hash: bytes
    size: int  # bytes of text below
    below: tuple[Node, ...] = ()


def _hash(level: bytes, data: bytes) -> bytes:
    return blake2b(level + data, digest_size=16).digest()


def _node(level: bytes, below: list[Node]) -> Node:
    return Node(_hash(level, b"".join(b.hash for b in below)), sum(b.size for b in below), tuple(below))


def tree(text: str) -> Node:
    """Root over sections over paragraphs over sentences (leaves)."""
    data = text.encode()
    sections: list[Node] = []
    paragraphs: list[Node] = []
    leaves: list[Node] = []

    def end_paragraph(blank: bool) -> None:
        paragraphs.append(_node(b"p", leaves))
        leaves.clear()
        if blank or paragraphs[-1].hash[0] < _BORDER:
            end_section()

    def end_section() -> None:
        sections.append(_node(b"s", paragraphs))
        paragraphs.clear()

    at = line = 0
    for end in [m.end() for m in _CUT.finditer(data)] + [len(data)]:
        if end > at:
            leaves.append(Node(_hash(b"l", data[at:end]), end - at))
            at = end
            if data[end - 1] == 10:
                end_paragraph(not data[line:end].strip())
                line = end
    if leaves:
        end_paragraph(False)
    if paragraphs:
        end_section()
    return _node(b"r", sections)


def leaves_of(root: Node) -> list[bytes]:
    return [leaf.hash[:4] for s in root.below for p in s.below for leaf in p.below]


def fingerprint(root: Node) -> str:
    return f"{root.hash.hex()}:" + "/".join("-".join("".join(leaf.hash[:4].hex() for leaf in p.below) for p in s.below) for s in root.below)


def _dice(a: list, b: list) -> float:
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a and b else 0.0


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    parts = [re.findall("[0-9a-f]{8}", x.partition(":")[2].replace("-", "").replace("/", "")) for x in (a, b)]
    return _dice(*parts)


def alike(a: Node, b: Node) -> float:
    """:func:`likeness` of the trees' fingerprints."""
    return 1.0 if a.hash == b.hash else _dice(leaves_of(a), leaves_of(b))


def _matched(a: tuple[Node, ...], b: tuple[Node, ...]) -> list[tuple[int, int]]:
    """Places of equal children in both, ascending: common ends, then the longest run of hashes that both hold once."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low].hash == b[low].hash:
        low += 1
    while n > low and m > low and a[n - 1].hash == b[m - 1].hash:
        n, m = n - 1, m - 1
    once = [{x.hash: i for i, x in enumerate(side[low:end], low) if many[x.hash] == 1} for side, end in ((a, n), (b, m)) for many in [Counter(x.hash for x in side[low:end])]]
    both = sorted((i, once[1][h]) for h, i in once[0].items() if h in once[1])
    tails: list[int] = []
    ends: list[tuple] = []
    for i, j in both:  # longest ascending run; each keeps the run it extends
        k = bisect_left(tails, j)
        tails[k : k + 1], ends[k : k + 1] = [j], [(i, j, ends[k - 1] if k else None)]
    run, last = [], ends[-1] if ends else None
    while last:
        run.append(last[:2])
        last = last[2]
    return [(i, i) for i in range(low)] + run[::-1] + [(n + k, m + k) for k in range(len(a) - n)]


def differing(a: Node, b: Node, at: int = 0, to: int = 0) -> list[tuple[int, int, int, int]]:
    """Byte spans (start, end in a; start, end in b) of what differs, found by descending where hashes differ."""
    if a.hash == b.hash:
        return []
    if not a.below or not b.below:
        return [(at, at + a.size, to, to + b.size)]
    out: list[tuple[int, int, int, int]] = []
    i = j = 0
    for k, m in [*_matched(a.below, b.below), (len(a.below), len(b.below))]:
        # Between equal branches: what lies below these, side by side.
        left, right = (Node(b"", sum(x.size for x in part), tuple(y for x in part for y in x.below)) for part in (a.below[i:k], b.below[j:m]))
        if left.size or right.size:
            for s, e, s2, e2 in differing(left, Node(b"other", right.size, right.below), at, to):
                # Spans that touch in both texts are one.
                touch = bool(out) and out[-1][1] == s and out[-1][3] == s2
                out[-1 if touch else len(out) :] = [(out[-1][0], e, out[-1][2], e2)] if touch else [(s, e, s2, e2)]
            at, to = at + left.size, to + right.size
        if k < len(a.below):
            at, to = at + a.below[k].size, to + b.below[m].size
        i, j = k + 1, m + 1
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every document."""

    def run(batches):
        for b in (s for batch in batches for s in slices([batch])):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(tree(t)) for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    return _texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, start, end, new_start, new_end): spans, in code points, that two versions of a document do not share.

    Documents of both tables meet by doc_id; a repeated id meets every version of it.
    """
    both = _texts(old).join(_texts(new).withColumnRenamed("text", "new_text"), "doc_id").where("text != new_text")

    def run(batches):
        for b in (s for batch in batches for s in slices([batch])):
            rows = []
            for key, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "new_text")), strict=True):
                u, v = x.encode(), y.encode()
                rows += [(key, *(len(side[:p].decode()) for side, p in ((u, s), (u, e), (v, s2), (v, e2)))) for s, e, s2, e2 in differing(tree(x), tree(y))]
            if rows:
                keys, *spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column("doc_id").type), *(pa.array(s, pa.int64()) for s in spans)], names=["doc_id", "start", "end", "new_start", "new_end"])

    return both.mapInArrow(run, f"doc_id {old.schema['doc_id'].dataType.simpleString()}, start long, end long, new_start long, new_end long")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def succession(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and the next document, ascending doc_id (after the last: the first).

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).  The
    edited text has its last half replaced by as much of the next document's beginning.  A null
    doc_id comes first; documents of one doc_id follow by a hash of their text, equal ones by place.

    Texts move once, into ranges of doc_id.  A task walks its range in order and holds two
    documents; the last of each range is finished beside the first of the next, a row a range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def beside(text: str, root: Node, following: str, other: Node) -> tuple:
        new = _edited(text, following)
        changed = tree(new)
        return len(text), sha256(new.encode()).hexdigest(), fingerprint(root), fingerprint(changed), alike(root, changed), alike(root, other)

    def run(batches):
        part = TaskContext.get().partitionId()
        edges = pa.schema([pa.field("doc_id", pa.null()), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), *((n, pa.float64()) for n in names[5:]), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
        last, key_type = None, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, key_type if i == 0 else edges.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], names=edges.names)

        for b in slices(batches):
            key_type, rows = b.column("doc_id").type, []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                root = tree(text)
                if last is None:
                    rows.append((key, *[None] * 6, part, "first", text))
                else:
                    rows.append((last[0], *beside(last[1], last[2], text, root), part, None, None))
                last = key, text, root
            if rows:
                yield table(rows)
        if last is not None:
            yield table([(last[0], *[None] * 6, part, "last", last[1])])

    def finish(batches):
        for b in slices(batches):
            rows = [(key, *beside(text, tree(text), following, tree(following))) for key, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
            if rows:
                keys, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column("doc_id").type), *(pa.array(c) for c in rest)], names=names)

    placed = _texts(docs).withColumns({"_h": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    ranges = placed.repartitionByRange("doc_id", "_h", "_at").sortWithinPartitions("doc_id", "_h", "_at").select("doc_id", "text")
    walked = written(ranges.mapInArrow(run, f"{made}, part int, edge string, text string"), "succession", codec="zstd")
    firsts, lasts = walked.where("edge = 'first'"), walked.where("edge = 'last'")
    # One number a range.
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    if not parts:
        return walked.select(*names)
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    met = lasts.join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following")
    return walked.where("edge is null").select(*names).unionByName(met.mapInArrow(finish, made))
