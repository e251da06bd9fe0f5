"""Brown class-based bigram scoring.

Words fall into classes; a text's probability is the product over its tokens of a class
transition and a word emission.  Exchange clustering finds the classes.  The ``common`` most
frequent words are units of their own, all other words share units by their last letters and
shape.  A round looks for each unit's best class against the class bigram counts, in
parallel, and moves a keyed share of the units; counts are renewed and the round stands only
if the likelihood of the class bigrams has risen, else the share is halved.  Rounds end when no
unit moves or a round gains less than ``tolerance`` of the likelihood.  The ``head`` most
frequent units go first, by their bigrams with one another; all units are then placed beside
them and rounds go on over all.  Words beyond the common ones then each get the class that
their own neighbours make likeliest, and transitions are recounted; words with less than ``least`` occurrences, whose few
neighbours tell little, stay with their shape.

Counting words and bigrams reads the whole corpus; unit bigrams are a table in Spark, and the
driver holds one class a unit and classes² counts.  Counts and classes of common words travel
to the tasks (a bounded table); each other word of a text is joined to its own.  An unknown
word stands for all unknown words of its shape's class, whose mass is what absolute discounting
takes from the class's known words, so the next step is conditioned on what was paid for.

Null texts are empty: one end token.  Repeated rows are scored each on their own.  Without
training rows every token is unknown: score 0, and log10(0.5 / 0.5) = 0 a token for the base.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, place, remembered, slices, small_batches, written

#: The end token; a space cannot be in a word.
END = b" "


#: Units in a block, and bits for the other unit of a bigram.
SLOTS, OTHER = 16, 27


#: Bytes of ASCII that are no letters, and those that are digits.
NO_LETTERS, DIGITS = bytes(c for c in range(128) if not chr(c).isalpha()), b"0123456789"


@lru_cache(1 << 16)
def _ending(letters: str, odd: int) -> int:
    h = 2166136261
    for c in letters + chr(48 + odd):
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def shape_bucket(word: bytes, buckets: int) -> int:
    """A stable group of rare words: last letters, and what else is in the word."""
    try:
        text, letters = word.decode(), word.translate(None, NO_LETTERS).decode()
    except UnicodeDecodeError:
        text = letters = word.decode("utf-8", "replace")
    if letters and not letters.isalpha():
        letters = "".join(filter(str.isalpha, letters))
    odd = 0
    if len(letters) < len(text):
        digits = len(word.translate(None, DIGITS)) < len(word) or (not text.isascii() and any(map(str.isdigit, text)))
        odd = 1 + (text[-1:] in ".,;:") + 2 * digits + 4 * (text[-3:].count(text[-1:]) == 3)
    return _ending(letters[-2:], odd) % buckets


def bytes_of(docs: DataFrame) -> Column:
    return F.col("text").cast("string").cast("binary").alias("text")


#: Bytes of texts that are split at once; a lookup table is built for each lot.
LOT = 8 << 20


def lots(batches: Iterator[pa.RecordBatch], column: int = 0, size: int = LOT) -> Iterator[list[tuple[pa.RecordBatch, pa.ListArray]]]:
    """Short slices of rows with their tokens, as many as hold ``size`` bytes; only tokens are copies."""
    held, many = [], 0
    for b in slices(batches):
        held.append((b, tokens(b.column(column))))
        many += b.nbytes
        if many >= size:
            yield held
            held, many = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield held


def tokens(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space, A-Z in lower case, then one end, here the empty word; nulls are empty."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.view(pa.string()), "")))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(low, ""), "", pc.binary_join_element_wise(low, "", " ")))


def words_of(lot: list[tuple[pa.RecordBatch, pa.ListArray]]) -> pa.ChunkedArray:
    return pa.chunked_array([x.flatten().view(pa.binary()) for _, x in lot], pa.binary())


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of ``docs`` (text)."""

    def run(batches):
        for lot in lots(batches):
            found = pc.value_counts(words_of(lot))
            word = found.field("values")
            word = pc.if_else(pc.equal(word, b""), END, word)
            yield pa.RecordBatch.from_arrays([word, found.field("counts")], names=["word", "n"])

    return docs.select(bytes_of(docs)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Unit of a word: its own if common, else its shape's."""

    common: list[bytes]
    buckets: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def size(self) -> int:
        return len(self.common) + self.buckets

    @property
    def plain(self) -> tuple[list[bytes], int, str]:
        """What a broadcast holds: values that a worker needs no module for."""
        return self.common, self.buckets, self.name

    @property
    def blocks(self) -> int:
        """Units are kept in blocks of at most SLOTS; the most frequent ones are in different blocks."""
        return -(-self.size // SLOTS)

    @property
    def end(self) -> int:
        """The unit of the end token."""
        return self.common.index(END) if END in self.common else len(self.common) + shape_bucket(END, self.buckets)

    def numbering(self) -> Numbering:
        """Words to units; one a worker process."""
        return remembered("brown_units", (self.name,), lambda: Numbering(self))

    def of(self, word: bytes) -> int:
        return self.numbering()[word]


class Numbering(dict):
    """Units of the common words; other words go to their shape's."""

    def __init__(self, units: Units):
        super().__init__(zip(units.common, range(len(units.common)), strict=True))
        self.first, self.buckets = len(units.common), units.buckets

    def __missing__(self, word: bytes) -> int:
        return self.first + shape_bucket(word, self.buckets)


@dataclass
class Coded:
    """Some rows with their tokens, one after the other, as units."""

    rows: pa.RecordBatch
    unit: np.ndarray
    ends: np.ndarray  # where each text ends
    at: np.ndarray  # tokens that are not common
    words: list[bytes]  # and their words


def coded(batches: Iterator[pa.RecordBatch], units: Units, column: int = 0) -> Iterator[Coded]:
    """The tokens of all texts: common words are looked up for a lot of texts at once, rows come in short slices."""
    first = len(units.common)
    known = remembered("brown_words", (units.name,), lambda: pa.array([b"" if w == END else w for w in units.common], pa.binary()))
    for lot in lots(batches, column):
        flat = words_of(lot)
        units_of = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy()
        rows, ends = [b for b, _ in lot], [np.cumsum(pc.list_value_length(x).to_numpy(), dtype=np.int64) for _, x in lot]
        lot.clear()
        parts = np.split(units_of, np.cumsum([end[-1] for end in ends])[:-1])
        rare = [x.take(pa.array(np.flatnonzero(k < 0))).to_pylist() for x, k in zip(flat.chunks, parts, strict=True)]
        del flat
        for b, end, k, words in zip(rows, ends, parts, rare, strict=True):
            unit, words = k.astype(np.int64), [w or END for w in words]
            at = np.flatnonzero(unit < 0)
            unit[at] = np.fromiter((first + shape_bucket(w, units.buckets) for w in words), np.int64, len(words))
            yield Coded(b, unit, end, at, words)


def packed(data: np.ndarray, many: np.ndarray) -> pa.Array:
    """A binary value for each run of ``many`` numbers."""
    at = np.concatenate([[0], np.cumsum(many * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


ROWS = "block int, side int, salt int, k0 binary, k1 binary, k2 binary, k3 binary, low binary, high binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _rows(key: np.ndarray, n: np.ndarray, side: int, salt: int) -> pa.RecordBatch:
    """A row for each block: ``key`` is sorted, (block · SLOTS + slot) << OTHER | other.

    Keys are kept as steps, a column for each of their bytes, and counts as single bytes with
    those from 255 on apart: most bytes are alike and compress.
    """
    cuts = np.flatnonzero(np.diff(key >> np.int64(OTHER + 4), prepend=-1))
    many = np.diff(np.append(cuts, len(key)))
    steps = np.diff(key, prepend=0)
    steps[cuts] = key[cuts] & np.int64((1 << OTHER + 4) - 1)
    planes = steps.astype("<u4").view(np.uint8).reshape(-1, 4)
    del steps
    large = np.flatnonzero(n >= 255)
    owner = np.searchsorted(cuts, large, side="right") - 1
    cols = [pa.array((key[cuts] >> np.int64(OTHER + 4)).astype(np.int32)), pa.array(np.full(len(cuts), side, np.int32)), pa.array(np.full(len(cuts), salt, np.int32))]
    cols += [packed(np.ascontiguousarray(planes[:, i]), many) for i in range(4)]
    cols += [packed(np.minimum(n, 255).astype(np.uint8), many), packed(n[large].astype("<i8"), np.bincount(owner, minlength=len(cuts)))]
    return pa.RecordBatch.from_arrays(cols, names=NAMES)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a binary column without nulls, how many in each row)."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], np.diff(at).astype(np.int64)


def entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, slot, other unit, count) of a batch of packed rows."""
    at = {x: b.schema.get_field_index(x) for x in ("k0", "k1", "k2", "k3", "low", "high")}
    low, many = _joined(b.column(at["low"]))
    planes = np.empty((len(low), 4), np.uint8)
    for i in range(4):
        planes[:, i] = _joined(b.column(at[f"k{i}"]))[0]
    # The first step of a row is its first key, so a row's keys are sums from its start.
    total = np.cumsum(planes.view("<u4").ravel(), dtype=np.int64)
    ends = np.cumsum(many)
    before = np.concatenate([[0], total])[ends - many]
    local = total - np.repeat(before, many)
    n = low.astype(np.int64)
    n[low == 255] = _joined(b.column(at["high"]))[0].view("<i8")
    return np.repeat(np.arange(len(many)), many), local >> OTHER, local & ((1 << OTHER) - 1), n


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key; the lists are emptied, since what they hold is large."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    by = np.argsort(key)
    key = key[by]
    n = n[by]
    del by
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[cuts], np.add.reduceat(n, cuts) if len(cuts) else n


def bigrams(docs: DataFrame, units: Units, hot: np.ndarray, gather: int = 1_000_000) -> DataFrame:
    """How often each unit stands after (side 1) or before (side 0) each unit, as packed rows of blocks of units.

    Blocks of the units ``hot`` are first summed in salted groups, so that what one task sums
    for a unit does not grow with the tasks before it.
    """
    size, blocks = units.size, units.blocks
    shared = docs.sparkSession.sparkContext.broadcast(units.plain)

    def place_of(unit: np.ndarray) -> np.ndarray:
        return unit % blocks * SLOTS + unit // blocks

    def run(batches):
        units, salt = Units(*shared.value), TaskContext.get().partitionId()
        keys, counts, held, pieces, raw = [], [], 0, [], 0
        last = np.array([units.end])
        places = place_of(np.arange(size)) << OTHER

        def fold():
            nonlocal raw
            x, n = np.unique(np.concatenate(pieces), return_counts=True)
            keys.append(x)
            counts.append(n)
            pieces.clear()
            raw = 0
            return len(x)

        def flush():
            key, n = _summed(keys, counts)
            yield _rows(key, n, 1, salt)
            place, b = key >> OTHER, key & ((1 << OTHER) - 1)
            x = places[b] | (place % SLOTS * blocks + place // SLOTS)
            by = np.argsort(x)
            del place, b, key
            x = x[by]
            yield _rows(x, n[by], 0, salt)

        for c in coded(batches, units):
            # A text's first token follows an end, as it does in the stream.
            x = np.concatenate([last, c.unit])
            pieces.append(places[x[:-1]] | x[1:])
            raw += len(x)
            if raw > gather // 2:
                held += fold()
            if held > 2 * gather:
                yield from flush()
                held = 0
        if pieces:
            held += fold()
        if held:
            yield from flush()

    def merge(batches):
        held: dict[int, list] = {0: [], 1: []}
        many = 0

        def flush(last: bool):
            """Sums of all blocks but the last, which may go on."""
            nonlocal many
            many = 0
            top = max(int(k[-1]) >> OTHER + 4 for parts in held.values() for k, _ in parts)
            for side, parts in held.items():
                if not parts:
                    continue
                keys, sums = [k for k, _ in parts], [n for _, n in parts]
                parts.clear()
                key, n = _summed(keys, sums)
                cut = len(key) if last else int(np.searchsorted(key, top << OTHER + 4))
                held[side] = [(key[cut:], n[cut:])] if cut < len(key) else []
                many += len(key) - cut
                if cut:
                    yield _rows(key[:cut], n[:cut], side, 0)

        for b in slices(batches, 256):
            row, slot, other, n = entries(b)
            block, side = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()
            key = (block[row] * SLOTS + slot) << OTHER | other
            for x in (0, 1):
                mine = side[row] == x
                if mine.any():
                    held[x].append((key[mine], n[mine]))
            many += len(key)
            if many > 2 * gather:
                yield from flush(False)
        if many:
            yield from flush(True)

    parts = docs.select(bytes_of(docs)).mapInArrow(run, ROWS)
    if len(hot):
        busy = F.col("block").isin(sorted({int(u) % blocks for u in hot}))
        parts = written(parts, "parts", 1 << 20)
        salted = parts.where(busy).withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(64)).cast("int"))
        salted = salted.repartition("block", "salt").sortWithinPartitions("block", "salt").mapInArrow(merge, ROWS)
        parts = parts.where(~busy).unionByName(salted)
    # The rows of a block come together, the sides one after the other.
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, ROWS).drop("salt").sortWithinPartitions("block", "side")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what the words alone decide."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(0)).sum() - _xlogx(counts.sum(1)).sum())


def best_class(old: int, before: np.ndarray, after: np.ndarray, itself: float, counts: np.ndarray, out: np.ndarray, into: np.ndarray) -> int:
    """The class for a unit that raises the class-bigram likelihood most.

    ``before``/``after``: how often each class stands before or after the unit, where the unit
    itself counts towards ``old``; ``itself``: how often it follows itself.  ``counts`` are class
    bigrams, ``out`` and ``into`` their row and column sums.
    """
    n = counts.copy()
    n[old, :] -= after
    n[:, old] -= before
    n[old, old] += itself
    b, a = before.copy(), after.copy()
    b[old] -= itself
    a[old] -= itself
    nb, na = b.sum() + itself, a.sum() + itself
    out, into = out.copy(), into.copy()
    out[old] -= na
    into[old] -= nb
    d = np.diag(n)
    gain = (_xlogx(n + a[None, :]) - _xlogx(n)).sum(1) + (_xlogx(n.T + b[None, :]) - _xlogx(n.T)).sum(1)
    # The cell of the class with itself gets both and the unit's own repeats.
    gain += _xlogx(d + a + b + itself) - _xlogx(d + a) - _xlogx(d + b) + _xlogx(d)
    gain -= _xlogx(out + na) - _xlogx(out) + _xlogx(into + nb) - _xlogx(into)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[old] + 1e-9 else old


def quick_gains(old: np.ndarray, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Gains of each class for light units (rows of ``before`` and ``after``), to first order.

    What a unit adds to a cell is small against the cell, so cells count at the value they
    have without the unit (plus one half).  ``old`` is -1 for units that are in no class yet.
    """
    half = 0.5
    out, into = counts.sum(1), counts.sum(0)
    na, nb = after.sum(1), before.sum(1)
    got = after @ np.log(counts + half).T + before @ np.log(counts + half) - np.outer(na, np.log(out + half)) - np.outer(nb, np.log(into + half))
    i = np.flatnonzero(old >= 0)
    k, a, b = old[i], after[i], before[i]
    less = lambda n, x: np.log(np.maximum(n - x, 0) + half)
    own = (a * less(counts[k], a)).sum(1) + (b * less(counts[:, k].T, b)).sum(1)
    got[i, k] = own - na[i] * less(out[k], na[i]) - nb[i] * less(into[k], nb[i])
    return got


def contexts(b: pa.RecordBatch, cls: np.ndarray, classes: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, before, after, itself) of a batch that holds all rows of its units; neighbours that have no class yet are left out."""
    row, slot, other, n = entries(b)
    n = n.astype(float)
    block, side = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().astype(np.int64)
    # Rows of a block lie together, so its units are numbered without sorting the entries.
    first = np.flatnonzero(np.diff(block, prepend=-1))
    lot = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(block))))
    units = (np.arange(SLOTS) * blocks + block[first][:, None]).ravel()
    at, wide = (lot * SLOTS)[row] + slot, classes + 1
    both = np.bincount(2 * wide * at + (side * wide)[row] + cls[other], n, 2 * len(units) * wide).reshape(len(units), 2, wide)
    same = np.flatnonzero(units[at] == other)
    same = same[side[row[same]] == 1]
    itself = np.bincount(at[same], n[same], len(units))
    met = np.flatnonzero(both.any((1, 2)))
    met = met[np.argsort(units[met])]
    return units[met], both[met, 0, :classes], both[met, 1, :classes], itself[met]


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between units: the rows of a unit, which lie together, come together."""
    held = None
    for b in slices(batches, 64):
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        unit = b.column(0).to_numpy()
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut:
            yield b.slice(0, cut)
        held = b.slice(cut)
    if held is not None:
        yield held


def moves(batches: Iterator[pa.RecordBatch], cls: np.ndarray, counts: np.ndarray, blocks: int, heavy: float) -> Iterator[pa.RecordBatch]:
    """(unit, to) of all units that another class would suit better; units of the class ``len(counts)`` have none yet."""
    out, into, classes = counts.sum(1), counts.sum(0), len(counts)
    for b in whole_units(batches):
        units, before, after, itself = contexts(b, cls, classes, blocks)
        old = np.where(cls[units] < classes, cls[units], -1).astype(int)
        gain = quick_gains(old, before, after, counts)
        row = np.arange(len(units))
        to = gain.argmax(1)
        to = np.where((old >= 0) & (gain[row, to] <= gain[row, old] + 1e-9), old, to)
        for i in np.flatnonzero((after.sum(1) > heavy) & (old >= 0)):
            to[i] = best_class(old[i], before[i], after[i], itself[i], counts, out, into)
        moved = to != old
        yield pa.RecordBatch.from_arrays([pa.array(units[moved], pa.int32()), pa.array(to[moved], pa.int32())], names=["unit", "to"])


def class_bigrams(table: DataFrame, cls: np.ndarray, classes: int, blocks: int) -> np.ndarray:
    """Class bigram counts: classes² sums."""
    at = table.sparkSession.sparkContext.broadcast(cls)

    def run(batches):
        c, total = at.value.astype(np.int64), np.zeros(classes * classes)
        for b in slices(batches, 64):
            row, slot, other, n = entries(b)
            block = b.column(0).to_numpy().astype(np.int64)
            total += np.bincount(c[slot * blocks + block[row]] * classes + c[other], n, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total)], names=["cell", "n"])

    with small_batches(table.sparkSession):
        got = table.where("side = 1").drop("side").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(classes * classes)
    for r in got:
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def better(table: DataFrame, cls: np.ndarray, counts: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, classes) of the moves of a round: at most one a unit."""
    at, heavy = table.sparkSession.sparkContext.broadcast((cls, counts)), counts.sum() / 4000

    def run(batches):
        yield from moves(batches, *at.value, blocks, heavy)

    with small_batches(table.sparkSession):
        found = table.mapInArrow(run, "unit int, to int").toArrow()
    return found.column("unit").to_numpy().astype(np.int64), found.column("to").to_numpy()


def exchange(table: DataFrame, cls: np.ndarray, counts: np.ndarray, blocks: int, tolerance: float = 5e-4) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, class bigram counts, likelihood after each round) from a start and its counts."""
    history, share, k = [likelihood(counts)], 0.5, 0
    while True:
        unit, to = better(table, cls, counts, blocks)
        k += 1
        draw = ((unit * 2654435761 + k * 40503) % (1 << 32) * 2246822519 % (1 << 32)) / 2.0**32
        gained = 0.0
        while len(unit) and share > 1e-3:
            new = cls.copy()
            new[unit[draw < share]] = to[draw < share]
            renewed = class_bigrams(table, new, len(counts), blocks)
            gained = likelihood(renewed) - history[-1]
            if gained > 0:
                cls, counts = new, renewed
                history.append(likelihood(counts))
                share = min(0.9, 1.5 * share)
                break
            share /= 2
        if gained <= tolerance * abs(history[-1]):
            return cls, counts, history


def among(table: DataFrame, head: int) -> DataFrame:
    """The bigrams of the first ``head`` units with one another, in the same packed rows."""

    def run(batches):
        for b in slices(batches, 64):
            row, slot, other, n = entries(b)
            block, side = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()
            keep = (slot == 0) & (other < head)
            key = (block[row] * SLOTS) << OTHER | other
            for x in (0, 1):
                mine = keep & (side[row] == x)
                if mine.any():
                    yield _rows(key[mine], n[mine], x, 0)

    return table.where(F.col("block") < head).select("block", "side", *NAMES[3:]).mapInArrow(run, ROWS).drop("salt")


def cluster(table: DataFrame, units: Units, classes: int, head: int = 4096) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, class bigram counts, likelihoods: of a start by rank, then after each round over all units)."""
    blocks, rank = units.blocks, (np.arange(units.size) % classes).astype(np.int16)
    counts = class_bigrams(table, rank, classes, blocks)
    if blocks < head:
        return exchange(table, rank, counts, blocks)
    start = likelihood(counts)
    few = written(among(table, head), "head")
    cls, counts, _ = exchange(few, rank, class_bigrams(few, rank, classes, blocks), blocks)
    cls[head:] = classes
    unit, to = better(table, cls, counts, blocks)
    new = np.where(cls < classes, cls, rank).astype(np.int16)
    placed = cls[unit] == classes
    new[unit[placed]] = to[placed]
    cls, counts, history = exchange(table, new, class_bigrams(table, new, classes, blocks), blocks)
    return cls, counts, [start, *history]


@dataclass
class Model:
    units: Units
    cls: np.ndarray
    counts: list[int]  # of the common words
    discount: float
    tokens: int
    types: int
    log_move: np.ndarray  # class x class, log10
    log_unknown: np.ndarray  # by class, log10: the mass of all its unknown words
    class_tokens: np.ndarray
    history: list[float]

    @property
    def log_floor(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.types + 1))


#: Bits of a filter of words, by crc32.
FILTER = 1 << 26


def word_filter(words: DataFrame) -> np.ndarray:
    """FILTER bits, set where the crc32 of a word falls; at most FILTER / 32 sums come to the driver."""
    at = words.select((F.crc32("word") % FILTER).alias("at"))
    bits = at.selectExpr("cast(at div 32 as int) AS k", "shiftleft(1L, cast(at % 32 as int)) AS bit")
    got = bits.groupBy("k").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER // 32, dtype=np.uint32)
    out[got.column("k").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def in_filter(words: list[bytes], bits: np.ndarray) -> np.ndarray:
    at = np.fromiter(map(crc32, words), np.int64, len(words)) % FILTER
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def tail_places(docs: DataFrame, units: Units, cls: np.ndarray, classes: int, bits: np.ndarray | None = None) -> DataFrame:
    """(word, own, before, after, apart, next, k): how often words that are not common stand between which classes.

    ``own`` is the class of the word's shape, which a neighbour that is not common counts as, too.
    ``apart``: the word before is none of those looked at; ``next``: the word after, if it is one.
    With ``bits``, a :func:`word_filter`, only words in it (and some others) are looked at; the
    end of a text never is.
    """
    shared = docs.sparkSession.sparkContext.broadcast((units.plain, cls, bits))

    def run(batches):
        plain, cls, bits = shared.value
        units = Units(*plain)
        last = int(cls[units.end])
        for x in coded(batches, units):
            c, at, ws = cls[x.unit].astype(np.int32), x.at, x.words
            keep = np.ones(len(at), bool) if bits is None else in_filter(ws, bits)
            keep &= np.isin(at, x.ends - 1, invert=True)
            at, ws = at[keep], [ws[i] for i in np.flatnonzero(keep).tolist()]
            wanted = np.zeros(len(c), bool)
            wanted[at] = True
            # An end follows each last word, so there is a next token; what stands before a first word is an end.
            before, follows = np.concatenate([[last], c[:-1]]).astype(np.int32), wanted[at + 1]
            apart = ~np.concatenate([[False], wanted[:-1]])[at]
            word = pa.array(ws, pa.binary())
            # A wanted word that follows is the next of those wanted.
            after = pa.array([ws[i + 1] if f else None for i, f in enumerate(follows.tolist())], pa.binary())
            fields = [word, pa.array(c[at]), pa.array(before[at]), pa.array(c[at + 1]), pa.array(apart), after]
            yield pa.RecordBatch.from_arrays(fields, names=["word", "own", "before", "after", "apart", "next"])

    schema = "word binary, own int, before int, after int, apart boolean, next binary"
    return docs.select(bytes_of(docs)).mapInArrow(run, schema).groupBy("word", "own", "before", "after", "apart", "next").agg(F.count("*").alias("k"))


def tail_classes(places: DataFrame, counts: np.ndarray, least: int) -> DataFrame:
    """(word, n, cls) of the words of :func:`tail_places`: each that occurs ``least`` times gets the class that suits its neighbours best.

    Of a word at most classes² different pairs of neighbours' classes come together.
    """
    classes = len(counts)
    shared = places.sparkSession.sparkContext.broadcast(counts)

    def choose(batches):
        for b in slices(batches, 4096):
            pairs = b.column("pairs")
            many = np.diff(pairs.offsets.to_numpy())
            left, right, n = (pairs.flatten().field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(many)), many) * classes
            before, after = (np.bincount(row + side, n.astype(float), len(many) * classes).reshape(-1, classes) for side in (left, right))
            # The word's tokens are counted in its shape's class.
            old = b.column("own").to_numpy().astype(int)
            best = np.where(b.column("n").to_numpy() >= least, quick_gains(old, before, after, shared.value).argmax(1), old)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(best, pa.int32())], names=["word", "n", "cls"])

    met = places.groupBy("word", "own", "before", "after").agg(F.sum("k").alias("k"))
    met = met.groupBy("word", "own").agg(F.sum("k").alias("n"), F.collect_list(F.struct("before", "after", "k")).alias("pairs"))
    return met.mapInArrow(choose, "word binary, n long, cls int")


def recounted(counts: np.ndarray, places: DataFrame, tail: DataFrame) -> np.ndarray:
    """Class bigram counts after words of :func:`tail_places` have moved to their classes in ``tail`` (word, cls).

    A bigram of two such words is counted where the first of them stands, so each is moved once.
    At most classes² sums come to the driver.
    """
    now = places.join(tail.select("word", "cls"), "word", "left").withColumn("cls", F.coalesce("cls", "own"))
    pair = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n"))
    k = F.col("k")
    left = now.where("apart and cls <> own").select(F.explode(F.array(pair("before", "own", -k), pair("before", "cls", k))).alias("x"))
    # Where no such word follows there is nothing to look up.
    ahead = now.where("next is not null").join(tail.select(F.col("word").alias("next"), F.col("cls").alias("then")), "next", "left")
    both = [now.where("next is null").withColumn("then", F.col("after")), ahead.withColumn("then", F.coalesce("then", "after"))]
    for x in both:
        left = left.unionByName(x.where("cls <> own or then <> after").select(F.explode(F.array(pair("own", "after", -k), pair("cls", "then", k))).alias("x")))
    out = counts.copy()
    for r in left.groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n")).collect():
        out[r["a"], r["b"]] += r["n"]
    return out


def shape_classes(words: DataFrame, units: Units, cls: np.ndarray) -> DataFrame:
    """(word, n, cls) of words that stay with their shape's class; texts are not read."""
    shared = words.sparkSession.sparkContext.broadcast((units.plain, cls))

    def run(batches):
        plain, cls = shared.value
        units = Units(*plain)
        number = units.numbering()
        for b in slices(batches, 4096):
            own = cls[[number[w] for w in b.column("word").to_pylist()]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(own, pa.int32())], names=["word", "n", "cls"])

    return words.select("word", "n").mapInArrow(run, "word binary, n long, cls int")


def learn(docs: DataFrame, training: Column, classes: int = 64, common: int = 1 << 18, buckets: int = 1024, least: int = 5) -> tuple[Model, DataFrame]:
    """(model, written table of the words that are not common: word, n, cls) of the rows where ``training`` holds."""
    spark = docs.sparkSession
    rows, since = docs.where(training).select("text"), place()
    words = written(count_words(rows), "words")
    top = [(bytes(r["word"]), r["n"]) for r in words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(common).toLocalIterator()]
    units, n = Units([w for w, _ in top], buckets), [x for _, x in top]
    sums = words.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    total, types, ones, twos = (int(x or 0) for x in sums)
    # A unit with more tokens than this is summed in salted groups.
    hot = np.flatnonzero(np.array(n, dtype=np.int64) > 1 << 24)
    table = written(bigrams(rows, units, hot), "bigrams")
    cls, counts, history = cluster(table, units, classes)
    frequent = words.where(F.col("n") >= least).count()
    # Words of fewer occurrences don't leave their shape's class, nor does the end of a text.
    stays = F.col("n") < least
    if END not in units.numbering():
        stays = stays | (F.col("word") == F.lit(END))
    tail = shape_classes(words.where(stays), units, cls)
    if frequent > len(top):
        word, n_last = top[-1]
        beyond = (F.col("n") < n_last) | ((F.col("n") == n_last) & (F.col("word") > F.lit(word)))
        places = written(tail_places(rows, units, cls, classes, word_filter(words.where((F.col("n") >= least) & beyond))), "places")
        moved = written(tail_classes(places, counts, least).where(F.col("n") >= least), "moved")
        counts = recounted(counts, places, moved)
        tail = tail.unionByName(moved)
    tail = written(tail, "tail")
    discard(spark, since)
    size = np.bincount(cls[: len(n)], n, classes) if n else np.zeros(classes)
    kinds = np.bincount(cls[: len(n)], minlength=classes) if n else np.zeros(classes)
    for r in tail.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        size[r["cls"]] += r["n"]
        kinds[r["cls"]] += r["k"]
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    if total:
        share = (size + 0.5) / (size + 0.5).sum()
        move = (counts + 4.0 * share[None, :]) / (counts.sum(1, keepdims=True) + 4.0)
        log_move, log_unknown = np.log10(move), np.log10(np.where(size > 0, discount * kinds / np.maximum(size, 1), 1.0))
    else:
        log_move, log_unknown = np.zeros((classes, classes)), np.zeros(classes)
    return Model(units, cls, n, discount, total, types, log_move, log_unknown, size, history), tail


def score(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    m, classes = model, len(model.class_tokens)
    # Plain values only: bounded by the numbers of units, classes and common words.
    shared = spark.sparkContext.broadcast((m.units.plain, m.cls, np.array(m.counts, dtype=float), m.discount, m.log_floor, m.log_move, np.maximum(m.class_tokens, 1)))

    def run(batches):
        plain, cls, n, discount, floor, move, size = shared.value
        units = Units(*plain)
        first, row_id = len(units.common), TaskContext.get().partitionId() << 33
        end = int(cls[units.end])
        # By unit; units of rare words add nothing here.
        few, flat = np.zeros(units.buckets), move.ravel()
        base = np.concatenate([np.log10(n + 0.5) - floor, few])
        emit = np.concatenate([np.log10(np.maximum(n - discount, 1e-9)) - np.log10(size)[cls[: len(n)]], few])
        names = ["row_id", "doc_id", "n_tokens", "n_common", "base", "total", "rare"]
        for part in coded(batches, units, 1):
            b, x, ends, at = part.rows, part.unit, part.ends, part.at
            starts = np.concatenate([[0], ends[:-1]])
            known, c = x < first, cls[x].astype(np.int64)
            # What stands before a text's first token is an end, which is common.
            prev = np.concatenate([[end], c[:-1]])
            prev[starts] = end
            before = np.concatenate([[True], known[:-1]])
            before[starts] = True
            steps = np.where(known & before, flat[prev * len(move) + c], 0.0) + emit[x]
            sums = [np.add.reduceat(v, starts) for v in (known.astype(np.int64), base[x], steps)]
            # Steps to and from a rare word wait for its class; -1: the neighbour is rare too, or none follows.
            after = np.append(np.where(known, c, -1)[1:], -1)
            after[ends - 1] = -1
            fields = [pa.array(np.where(before, prev, -1)[at], pa.int32()), pa.array(c[at], pa.int32()), pa.array(after[at], pa.int32()), pa.array(part.words, pa.binary())]
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(at, ends)]), pa.int32()), pa.StructArray.from_arrays(fields, names=["before", "shape", "after", "word"]))
            ids = pa.array(np.arange(row_id, row_id + b.num_rows))
            row_id += b.num_rows
            yield pa.RecordBatch.from_arrays([ids, b.column(0), pa.array(ends - starts), *map(pa.array, sums), listed], names=names)

    schema = "row_id long, doc_id long, n_tokens long, n_common long, base double, total double, rare array<struct<before:int,shape:int,after:int,word:binary>>"
    lines = written(docs.select(F.col("doc_id").cast("long"), bytes_of(docs)).mapInArrow(run, schema), "lines")
    rare = lines.select("row_id", F.posexplode("rare").alias("at", "r")).select("row_id", "at", "r.*").join(tail, "word", "left")
    rare = rare.select("row_id", "at", "before", "after", "n", F.coalesce("cls", "shape").alias("cls"))
    order = Window.partitionBy("row_id").orderBy("at")
    rare = rare.withColumn("before", F.when(F.col("before") < 0, F.lag("cls").over(order)).otherwise(F.col("before")))
    # Tables of classes² and of classes numbers.
    k = np.arange(classes, dtype=np.int32)
    steps = spark.createDataFrame(pa.table({"i": np.repeat(k, classes), "j": np.tile(k, classes), "step": m.log_move.ravel()}))
    of = spark.createDataFrame(pa.table({"cls": k, "size": np.log10(np.maximum(1, m.class_tokens)), "unknown": m.log_unknown}))
    rare = rare.join(F.broadcast(steps.toDF("before", "cls", "to")), ["before", "cls"], "left").join(F.broadcast(steps.toDF("cls", "after", "on")), ["cls", "after"], "left")
    rare = rare.join(F.broadcast(of), "cls")
    emit = F.when(F.col("n").isNull(), F.col("unknown")).otherwise(F.log10(F.col("n") - F.lit(m.discount)) - F.col("size"))
    base = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5) - F.lit(m.log_floor)
    found = rare.groupBy("row_id").agg(F.count("n").alias("rare_known"), F.sum(base).alias("rare_base"), F.sum(F.col("to") + F.coalesce("on", F.lit(0.0)) + emit).alias("rare_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return lines.drop("rare").join(found, "row_id", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + zero("rare_known")).alias("n_known"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("total") + zero("rare_total")).alias("score"),
    )
