"""Conversation structure repair: cheapest edits by dynamic programming over a trie of signatures.

Rows of a conversation become a signature, one letter a row: its role (system, user, assistant,
other) and fault.  The fewest edits that make role initials ``(s?(ua)+)?`` depend on the signature
alone, so distinct signatures are sorted, a task walks its range of them as a prefix trie, and a
layer of the DP is computed once for every shared prefix; where a signature ends, its answer is
read off.  Of answers of one cost the ASCII-least string of edits (D, I, K, R) counts.

A conversation is read in order, by turn (null first), then role, then SHA-256 of the text;
rows equal in all of these are alike.  Its rows are dealt by ranges, so that one conversation may
lie in many tasks; it is cut into segments of at most ``SEGMENT`` rows, and a layer holds the best
edits from each state to each state, so that segments' answers follow one another.  Only the rows of
conversations of several segments (one row a segment) meet again by conversation.  Texts move once, into
conversations, and are streamed past the edits; the hash of one conversation's text can't be split,
so one task streams each of them, with a batch of rows in memory.

Defined cases: a null role or text is one space; a row whose role begins with none of s, u and a can't be
kept.  A null conv_id is a conversation.  A conversation whose rows are all gone has zeros, no
edits and no repaired rows.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SEGMENT = 512
#: Characters that are no text.
BLANKS = " \t\n\x0b\f\r"
#: What has been put out: nothing, a system turn, ... and a user turn, ... and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, TRUNCATED = 2, 5, 5
#: Signature letters: role when sound, role when truncated; x for what has to go.
_SOUND, _CUT = "suao", "SUAO"
#: The state after a kept role, from each state where it can be kept.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

Best = list[tuple[int, str] | None]


def _inserted(best: Best) -> Best:
    """With turns inserted where that is the cheapest way into a state."""
    for s in (START, SYSTEM, ASSISTANT, USER, ASSISTANT):
        if (b := best[s]) is not None:
            new, to = (b[0] + INSERT, b[1] + "I"), _NEXT[s]
            if best[to] is None or new < best[to]:
                best[to] = new
    return best


def first_layer() -> list[Best]:
    return [_inserted([(0, "") if s == t else None for t in range(4)]) for s in range(4)]


def next_layer(layer: list[Best], letter: str) -> list[Best]:
    """From each state to each state, past one more row."""
    extra, kept = (TRUNCATED if letter in _CUT else 0), _KEEP.get(letter.lower(), {})
    out = []
    for best in layer:
        new: Best = [None] * 4
        for s, b in enumerate(best):
            if b is None:
                continue
            ways = [(s, b[0] + DELETE, "D")]
            if letter != "x":
                ways.append((_NEXT[s], b[0] + 1 + extra, "R"))
                if s in kept:
                    ways.append((kept[s], b[0] + extra, "K"))
            for to, cost, edit in ways:
                if new[to] is None or (cost, b[1] + edit) < new[to]:
                    new[to] = (cost, b[1] + edit)
        out.append(_inserted(new))
    return out


def trie_answers(signatures: Iterator[str]) -> Iterator[tuple[str, list[Best]]]:
    """(signature, last layer) of sorted signatures; the layers of a path through the trie are held, one a letter."""
    before, path = "", [first_layer()]
    for sig in signatures:
        shared = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(before, sig, strict=False)))
        del path[shared + 1 :]
        for letter in sig[shared:]:
            path.append(next_layer(path[-1], letter))
        before = sig
        yield sig, path[-1]


def ended(best: Best) -> tuple[int, str]:
    """The cheaper of a conversation without turns and one that an assistant ends."""
    return min(b for b in (best[START], best[ASSISTANT]) if b is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(conv_id:turn) mod 20: 0 gone, 1 text empty, 2 without ``.!?``, 3 twice, 4 from the user.

    (conv_id, turn, role, text, gone); a null counts as one space, also in the key, but a null turn stays.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(draw == 4, "user").otherwise(plain("role"))
    copies = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (draw == 0).alias("gone"), F.explode(copies).alias("_c")).drop("_c")


def _rows(rows: DataFrame) -> DataFrame:
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    t = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    return t.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _letters(rows: DataFrame) -> DataFrame:
    """One row a turn without its text: its place, initial, fault ('' if none) and signature letter."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    # Rows of one conversation, turn, role and text are told apart by place, so that one of them is the first.
    t = written(rows.select("conv_id", "turn", "role", "digest", "gone", fault.alias("fault"), F.monotonically_increasing_id().alias("at")), "turns")
    seen = t.where("not gone and fault != 'blank'").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    firsts = seen.agg(F.min(F.struct("turn", "at")).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    both = t.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    repeated = F.col("first").isNotNull() & ~F.struct("turn", "at").eqNullSafe(F.col("first")) & (F.col("fault") != "blank")
    initial = F.left("role", F.lit(1))
    both = both.select("conv_id", "turn", "role", "digest", "at", "gone", initial.alias("initial"), F.when(repeated, "duplicate").otherwise(F.col("fault")).alias("fault"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return both.withColumn("letter", letter)


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


class _Segment:
    def __init__(self, conv, whole: bool):
        self.conv, self.whole = conv, whole
        self.letters: list[str] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.turns = 0

    def add(self, turn, initial: str, fault: str, letter: str) -> None:
        self.letters.append(letter)
        if fault:
            self.counts[fault] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn


def _segments(letters: DataFrame) -> DataFrame:
    """Segments of conversations in order; ``whole`` marks those that are all of their conversation."""
    kind = letters.schema["conv_id"].dataType.simpleString()
    fields = "part int, segment int, whole boolean, signature string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
    names = ["conv_id", *[f.split(" ")[0] for f in fields.split(", ")]]

    def run(batches):
        part, made, current, key_type = TaskContext.get().partitionId(), 0, None, None

        def batch(segments):
            nonlocal made
            rows = []
            for s in segments:
                rows.append((s.conv, part, made, s.whole, "".join(s.letters), *[s.counts[c] for c in _COUNTS], s.first, s.last, s.low, s.high, s.turns))
                made += 1
            types = [key_type, pa.int32(), pa.int32(), pa.bool_(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in slices(batches, 4096):
            key_type, done = b.column("conv_id").type, []
            for conv, turn, gone, initial, fault, letter in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "initial", "fault", "letter")), strict=True):
                if current is None or current.conv != conv:
                    # The first and last of a task may go on in another.
                    if current is not None:
                        done.append(current)
                    current = _Segment(conv, current is not None)
                elif not gone and len(current.letters) == SEGMENT:
                    current.whole = False
                    done.append(current)
                    current = _Segment(conv, False)
                if not gone:
                    current.add(turn, initial, fault, letter)
            if done:
                yield batch(done)
        if current is not None:
            current.whole = False
            yield batch([current])

    order = ["conv_id", "turn", "role", "digest", "at"]
    ranges = letters.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.col("turn").cast("long").alias("turn"), "gone", "initial", "fault", "letter")
    return written(ranges.mapInArrow(run, f"conv_id {kind}, {fields}"), "segments")


def _answers(segments: DataFrame) -> DataFrame:
    """(signature, cost, audit, costs, audits) of distinct signatures: for a whole conversation, and from each state to each."""

    def run(batches):
        sigs = (s for b in batches for s in b.column("signature").to_pylist())
        rows: list[tuple] = []

        def batch():
            types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["signature", "cost", "audit", "costs", "audits"])

        for sig, layer in trie_answers(sigs):
            every = [b or (None, None) for best in layer for b in best]
            rows.append((sig, *ended(layer[START]), [b[0] for b in every], [b[1] for b in every]))
            if len(rows) == 256:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    distinct = segments.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return written(distinct.mapInArrow(run, "signature string, cost long, audit string, costs array<long>, audits array<string>"), "answers")


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(parts: DataFrame) -> DataFrame:
    """Conversations of several segments: their answers one after another."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split(" ")[0] for f in _FOUND.split(", ")]]

    def run(batches):
        conv, counts, best, last, low, high, turns, key_type, begun = None, None, None, None, None, None, 0, None, False

        def row():
            gaps = 0 if low is None else high - low + 1 - turns
            return (conv, gaps, *counts, *ended(best))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, key_type if i == 0 else pa.string() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

        for b in slices(batches):
            key_type, done = b.column("conv_id").type, []
            for r in b.to_pylist():
                if not begun or r["conv_id"] != conv:
                    if begun:
                        done.append(row())
                    begun, conv, counts, best, last, low, high, turns = True, r["conv_id"], [0] * 4, first_layer()[START], None, None, None, 0
                counts = [a + r[c] for a, c in zip(counts, _COUNTS, strict=True)]
                if r["first"] is not None:
                    if last is not None and last + r["first"] not in ("su", "ua", "au"):
                        counts[3] += 1
                    last = r["last"]
                if r["low"] is not None:
                    turns += r["turns"] - (r["low"] == high)
                    low, high = (r["low"] if low is None else low), r["high"]
                new: Best = [None] * 4
                for s, p in enumerate(best):
                    for t in range(4):
                        if p is not None and (c := r["costs"][4 * s + t]) is not None:
                            way = (p[0] + c, p[1] + r["audits"][4 * s + t])
                            new[t] = way if new[t] is None else min(new[t], way)
                best = new
            if done:
                yield batch(done)
        if begun:
            yield batch([row()])

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return ordered.mapInArrow(run, f"conv_id {kind}, {_FOUND}")


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation in ``rows`` (conv_id, turn, role, text).

    Rows marked in a column ``gone`` are not there, but their conversation is.
    """
    segments = _segments(_letters(_rows(rows)))
    met = segments.join(_answers(segments), "signature")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = met.where("whole").select("conv_id", gaps.alias("gaps"), *_COUNTS, "cost", "audit")
    return written(whole.unionByName(_joined(met.where("not whole"))), "repairs")


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, role, text) conversation by conversation, in order; at -1 opens each of them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")], F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("audit"))
    turns = _rows(rows).where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit"))
    ordered = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text", "audit")

    def run(batches):
        conv, audit, p, state, at, out, key_type = None, "", 0, START, 0, [], None

        def put(role: str | None, text: str | None) -> None:
            nonlocal state, at
            if role is None or role == "I":
                role = "user" if _NEXT[state] == USER else "assistant"
            state = SYSTEM if state == START and role[:1] == "s" else _NEXT[state]
            out.append((conv, at, role, text))
            at += 1

        def insertions() -> None:
            nonlocal p
            while p < len(audit) and audit[p] == "I":
                put(None, "")
                p += 1

        for b in slices(batches):
            key_type = b.column("conv_id").type
            for key, head, role, text, edits in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")), strict=True):
                if head == 0:
                    insertions()
                    conv, audit, p, state, at = key, edits, 0, START, 0
                    out.append((conv, -1, None, None))
                    continue
                insertions()
                if audit[p] != "D":
                    put(role if audit[p] == "K" else None, text)
                p += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [key_type, pa.int64(), pa.string(), pa.string()], strict=True)], names=["conv_id", "at", "role", "text"])
                out.clear()
        insertions()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [key_type, pa.int64(), pa.string(), pa.string()], strict=True)], names=["conv_id", "at", "role", "text"])

    return ordered.mapInArrow(run, f"conv_id {kind}, at long, role string, text string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the repaired conversations, from :func:`repairs` of the same rows."""
    return _streamed(rows, found).where("at >= 0")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of every conversation's repaired ``role:text``, joined by newlines."""
    from hashlib import sha256

    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        open_, held, key_type = False, None, None
        conv = None
        for b in batches:
            key_type, done = b.column("conv_id").type, []
            for key, at, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "role", "text")), strict=True):
                if at < 0:
                    if open_:
                        done.append((conv, held.hexdigest()))
                    open_, conv, held = True, key, sha256()
                else:
                    held.update(f"{chr(10) if at else ''}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [key_type, pa.string()], strict=True)], names=["conv_id", "repaired_sha256"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([conv], key_type), pa.array([held.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return written(_streamed(rows, found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string"), "digests")


def summary(rows: DataFrame) -> DataFrame:
    """:func:`repairs` with :func:`digests`, a row a conversation."""
    found = repairs(rows)
    hashes = digests(rows, found).withColumnRenamed("conv_id", "c")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
