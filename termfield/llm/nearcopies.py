"""Near copies of texts by BagMinHash signatures and exact multiset overlap.

A text is the multiset of its shingles of five words.  Of every shingle, weights are
discretised into dyadic levels; each level is a Poisson process of the level's width whose
points fall on random signature components, and a level that a weight covers in part keeps
the points of that part (points are placed by halving the level).  A component keeps the
earliest point.  Two texts agree in a component with the probability of their weighted
Jaccard similarity.  Points are drawn in order of time and a process stops once it can no
longer beat the signature.

Texts with equal multisets are one item.  Bands of the signature put items into buckets;
links are verified by the exact overlap of shingle multisets (32-bit shingle hashes).

Words are runs of letters, digits and underscores in lower case; texts of one to four words
have one shingle.  Texts without a word, null or empty, are copies of one another.  Very
long texts are read whole; a repeated row is a copy.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, place, slices, written
from .groups import components, linked, rooted

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(_ODD) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def shingles(text: str | None, known: WordHashes, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes of the text's shingles, and how often each is there."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1) if len(h) else 0
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        total = mixed(total * _ODD + h[k : k + n])
    return np.unique((total >> np.uint64(32)).astype(np.uint32), return_counts=True)


def packed(hashes: np.ndarray) -> bytes:
    """Sorted 32-bit hashes as steps, low bytes first: the high bytes are mostly 0 and compress."""
    steps = np.diff(hashes.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def signatures(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, m: int) -> np.ndarray:
    """BagMinHash signatures: float arrival times, a row of ``m`` for each owner.

    ``items``, ``weights`` (whole numbers from 1) and ``owner`` run in parallel.
    """
    out = np.full((owners, m), np.inf)
    flat = out.reshape(-1)
    seed, rate, low, weight, own = [], [], [], [], []
    level, at = 0, np.arange(len(items))
    while len(at):
        # Level 0 is (0, 1]; level j is (2^(j-1), 2^j].
        width = 1 << max(0, level - 1)
        seed.append(mixed(items[at].astype(np.uint64) + _step(level + 1)))
        rate.append(np.full(len(at), float(width)))
        low.append(np.full(len(at), 0 if level == 0 else width))
        weight.append(weights[at])
        own.append(owner[at])
        level += 1
        at = at[weights[at] > (1 << (level - 1))]
    if not seed:
        return out
    seed, rate, low, weight, own = map(np.concatenate, (seed, rate, low, weight, own))
    time = np.zeros(len(seed))
    turn = 0
    while len(seed):
        turn += 1
        z = mixed(seed + _step(turn))
        time = time - np.log1p(-(z >> np.uint64(11)).astype(float) * 2.0**-53) / rate
        z = mixed(z ^ _ODD)
        part = ((z >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        # The place inside the level, by halving; points beyond the weight are not the item's.
        place = low + ((z & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * rate).astype(np.int64)
        inside = place < weight
        np.minimum.at(flat, (own * m + part.astype(np.int64))[inside], time[inside])
        going = time < out.max(1)[own]
        seed, rate, low, weight, own, time = (x[going] for x in (seed, rate, low, weight, own, time))
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), bits.shape[:2])
    for k in range(rows):
        key = mixed(key * _ODD + bits[:, :, k])
    return key.view(np.int64)


SKETCH = "row_id long, doc_id long, mark string, n long, digest binary, bands array<long>, hashes binary, counts binary"


def sketch(docs: DataFrame, bands: int, rows: int, gather: int = 150_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, mark, text): its shingle multiset, digest and band keys."""

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        row = TaskContext.get().partitionId() << 33
        held, many = [], 0

        def flush():
            nonlocal row
            sizes = [len(h) for _, _, h, _ in held]
            owner = np.repeat(np.arange(len(held)), sizes)
            sig = signatures(np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), owner, len(held), bands * rows)
            keys = bands_of(sig, bands, rows)
            hashes = [packed(h) for _, _, h, _ in held]
            # No counts: every shingle is there once.
            counts = [b"" if (c == 1).all() else c.astype(np.uint32).tobytes() for _, _, _, c in held]
            digest = [hashlib.blake2b(h + c, digest_size=16).digest() for h, c in zip(hashes, counts, strict=True)]
            band_type = pa.array(keys.reshape(-1), pa.int64())
            cols = [
                pa.array(range(row, row + len(held)), pa.int64()),
                pa.array([x[0] for x in held], pa.int64()),
                pa.array([x[1] for x in held], pa.string()),
                pa.array([int(x[3].sum()) for x in held], pa.int64()),
                pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * bands, pa.int32()), band_type),
                pa.array(hashes, pa.binary()),
                pa.array(counts, pa.binary()),
            ]
            row += len(held)
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SKETCH.split(", ")])

        for b in slices(batches):
            for doc, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, c = shingles(text, known)
                held.append((doc, mark, h, c))
                many += len(h) + 8
                if many > gather:
                    yield flush()
                    held, many = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("mark").cast("string"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def overlap(h1: bytes, c1: bytes, h2: bytes, c2: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets; two empty ones are equal."""
    a, b = unpacked(h1), unpacked(h2)
    n = np.frombuffer(c1, np.uint32).astype(np.int64) if c1 else np.ones(len(a), dtype=np.int64)
    m = np.frombuffer(c2, np.uint32).astype(np.int64) if c2 else np.ones(len(b), dtype=np.int64)
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    same = b[at] == a if len(b) else np.zeros(len(a), dtype=bool)
    both = int(np.minimum(n[same], m[at[same]]).sum())
    every = int(n.sum() + m.sum()) - both
    return both / every if every else 1.0


def tester(sets: DataFrame, threshold: float):
    """A test for ``linked``: exact overlap of pairs; ``sets`` holds id, hashes and counts."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            far = [1.0 - overlap(*x) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            far = pa.array(far, pa.float64())
            link = pa.array(np.asarray(far) <= 1 - threshold + 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), far, link], names=["a", "b", "far", "link"])

    def test(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("h1"), F.col("counts").alias("c1"))
        y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("h2"), F.col("counts").alias("c2"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "h1", "c1", "h2", "c2")
        return both.mapInArrow(run, "a long, b long, far double, link boolean")

    return test


def comparer(threshold: float):
    """Links between two blocks of packed multisets, by one product of membership matrices."""

    def tokens(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(item, token) pairs: the k-th copy of a shingle is a token of its own, so overlaps of sets are those of multisets."""
        at, out = [], []
        for i, (h, c) in enumerate(zip(hashes, counts, strict=True)):
            h = unpacked(h).astype(np.uint64)
            if c:
                n = np.frombuffer(c, np.uint32).astype(np.int64)
                copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = np.repeat(h, n) | (copy.astype(np.uint64) << np.uint64(32))
            at.append(np.full(len(h), i))
            out.append(h)
        return np.concatenate(at), np.concatenate(out)

    def compare(x: list[list], y: list[list]) -> list[tuple[int, int]]:
        (i, a), (j, b) = tokens(*x), tokens(*y)
        sizes = np.bincount(i, minlength=len(x[0]))[:, None] + np.bincount(j, minlength=len(y[0]))[None, :]
        # Only tokens of both blocks can overlap; a slice of them at a time.
        both = np.intersect1d(a, b)
        place, other = np.searchsorted(both, a), np.searchsorted(both, b)
        fit = lambda p, t: (p < len(both)) & (both[np.minimum(p, max(0, len(both) - 1))] == t) if len(both) else np.zeros(len(t), dtype=bool)
        u, v = fit(place, a), fit(other, b)
        i, place, j, other = i[u], place[u], j[v], other[v]
        overlap = np.zeros(sizes.shape)
        for lo in range(0, len(both), 8192):
            left, right = np.zeros((len(x[0]), 8192), dtype=np.float32), np.zeros((len(y[0]), 8192), dtype=np.float32)
            p, q = (place >= lo) & (place < lo + 8192), (other >= lo) & (other < lo + 8192)
            left[i[p], place[p] - lo], right[j[q], other[q] - lo] = 1, 1
            overlap += left @ right.T
        return list(zip(*(k.tolist() for k in np.nonzero(1 - overlap / (sizes - overlap) <= 1 - threshold + 1e-12)), strict=True))

    return compare


def near_copies(docs: DataFrame, threshold: float = 0.8, bands: int = 18, rows: int = 4, crowd: int = 32, mark: Column | None = None) -> DataFrame:
    """(doc_id, mark, class_id, kept) of every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of the class; one row of a class is kept: the one with
    that doc_id (of repeated rows, one).  ``mark`` is a text of the caller's for the row.
    A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^rows)^bands: 0.9999.
    """
    mark = F.lit(None) if mark is None else mark
    since = place()
    found = written(sketch(docs.select("doc_id", mark.cast("string").alias("mark"), "text"), bands, rows), "sketch")
    # Rows with equal multisets are one item, named by one of its rows.
    items = written(found.groupBy("digest").agg(F.min("row_id").alias("id")), "items")
    firsts = items.select("id")
    heads = found.join(firsts, F.col("row_id") == F.col("id"), "left_semi").where("n > 0")
    members = heads.select(F.col("row_id").alias("id"), "n", F.explode("bands").alias("bucket"))
    sets = found.select(F.col("row_id").alias("id"), "hashes", "counts")
    links = written(linked(members, sets, lambda held: tester(held, threshold), comparer(threshold), 1 - threshold, threshold, crowd), "joined")
    roots = rooted(items, components(links))
    rows_of = written(found.select("row_id", "doc_id", "mark", "digest").join(roots.select("digest", "root"), "digest").drop("digest"), "rooted")
    discard(docs.sparkSession, since)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    heads = rows_of.groupBy("root").agg(F.min(key).alias("head"))
    out = rows_of.join(heads, "root")
    return out.select("doc_id", "mark", F.col("head.doc_id").alias("class_id"), (F.col("row_id") == F.col("head.row_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class of near copies, with all columns of ``docs``.

    A row is known by two hashes of all its columns, nulls among them, so rows that share a
    mark are the same in every column, and one of them stays.
    """
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    held = [x for c in names for x in (c.isNull(), c.cast("string"))]
    mark = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *held)), 16, "0") for seed in (1, 2)])
    own = next(x for x in (f"mark_{k}" for k in range(len(names) + 1)) if x not in {c.lower() for c in docs.columns})
    found = near_copies(docs, threshold, mark=mark)
    kept = found.where("kept").select(F.col("mark").alias(own)).distinct()
    return docs.withColumn(own, mark).join(kept, own, "left_semi").dropDuplicates([own]).select(*names)
