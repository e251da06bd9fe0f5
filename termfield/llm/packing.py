"""Best-fit packing by exact complements.

Documents become token pieces of at most ``size`` tokens.  Only the histogram of piece
lengths (at most ``size`` numbers) reaches the driver; the plan made from it is a list of
(lengths, how often) patterns.  Each piece then finds its place by its rank among pieces of
its length, so no piece passes through the driver.

Null and empty texts are one piece holding only the end id.  Repeated rows are packed
again, each row on its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remembered, slices, written

_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of whole texts, as packed little-endian 32-bit numbers.

    The vocabulary splits a text into words before any merge, so the ids of a text are those
    of its words in order; words are remembered.  A text with characters for which lower
    case or normal form need the library's own tables goes to the library whole.
    """

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.words = Tokenizer.from_file(path), keep, {}

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that are new in any of about a million characters are encoded together."""
        out, lot, many = [], [], 0
        for t in texts:
            lot.append(t)
            many += len(t)
            if many > 1 << 20:
                out += self._lot(lot)
                lot, many = [], 0
        return out + self._lot(lot)

    def _lot(self, texts: list[str]) -> list[bytes]:
        split = [None if "<|" in t or not _PLAIN.fullmatch(t) else _WORD.findall(t.lower()) for t in texts]
        known = self.words
        if len(known) > self.keep:
            known.clear()
        new = list(set().union(*filter(None, split)).difference(known))
        known.update(zip(new, self._words(new), strict=True))
        return [self._direct([t])[0] if ws is None else b"".join(map(known.__getitem__, ws)) for t, ws in zip(texts, split, strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one text of them all if that splits into just these words."""
        x = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        owner, ids = np.array(x.word_ids, dtype=float), np.array(x.ids, dtype="<u4")
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        # Each word must have begun where it stands in the text.
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
        offsets = x.offsets
        if len(cuts) != len(words) or [offsets[i][0] for i in cuts.tolist()] != starts.tolist():
            return self._direct(words)
        data, at = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [data[i:j] for i, j in zip(at, at[1:])]

    def _direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in got]


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(row_id, doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = remembered("words", (vocabulary,), lambda: WordEncoder(vocabulary))
        end = struct.pack("<I", end_id)
        row, step = TaskContext.get().partitionId() << 33, 4 * size
        for b in slices(batches):
            out = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), enc.packed(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((row, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                row += 1
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class _Stock:
    """How many pieces of each length are left, and an index of the sums that two and three lengths make.

    The index is of lengths that are left at all; counts are looked at when a sum is taken.
    """

    def __init__(self, counts: np.ndarray):
        self.n, self._sums = counts, None

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each number up to the longest length is a sum of two, and of three lengths."""
        if self._sums is None:
            size = len(self.n)
            have, width = (self.n > 0).astype(float), 1 << (2 * size - 1).bit_length()
            spectrum = np.fft.rfft(have, width)
            pairs = np.fft.irfft(spectrum * spectrum, width)[:size] > 0.5
            triples = np.fft.irfft(np.fft.rfft(pairs.astype(float), width) * spectrum, width)[:size] > 0.5
            self._sums = pairs, triples
        return self._sums

    def fits(self, lengths: list[int]) -> bool:
        return all(self.n[x] >= lengths.count(x) for x in lengths)

    def take(self, lengths: list[int]) -> int:
        times = min(int(self.n[x]) // lengths.count(x) for x in lengths)
        for x in lengths:
            self.n[x] -= times
            if not self.n[x]:
                self._sums = None
        return times

    def exact(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three lengths that sum to the gap, the longest first, given what is held."""
        if self.n[gap] > 0 and self.fits([*held, gap]):
            return [gap]
        found = self._pair(gap, held)
        pairs, triples = self.sums()
        if found or not triples[gap]:
            return found
        c = np.arange(1, gap - 1)
        for x in c[(self.n[c] > 0) & pairs[gap - c]][::-1]:
            if (found := self._pair(gap - int(x), [*held, int(x)])) is not None:
                return [int(x), *found]
        return None

    def _pair(self, gap: int, held: list[int]) -> list[int] | None:
        if not self.sums()[0][gap]:
            return None
        a = np.arange(1, gap // 2 + 1)
        for x in a[(self.n[a] > 0) & (self.n[gap - a] > 0)]:
            if self.fits([*held, gap - int(x), int(x)]):
                return [gap - int(x), int(x)]
        return None


def plan(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence, how many such sequences) that use every piece once.

    Longest first: an exact single, pair or triple fills the gap if the counts allow; else the
    best-fitting length goes in and what is left is a gap again.  ``counts[x]`` pieces have
    length x.  Each turn uses up a length, so the turns are bounded by the lengths.
    """
    stock, out = _Stock(np.asarray(counts).copy()), []
    for longest in range(size, 0, -1):
        while stock.n[longest] > 0:
            held, gap = [longest], size - longest
            while gap > 0:
                if (more := stock.exact(gap, held)) is not None:
                    held, gap = held + more, 0
                    break
                left = np.flatnonzero(stock.n[1 : gap + 1] > 0) + 1
                fit = next((int(x) for x in left[::-1] if stock.fits([*held, int(x)])), None)
                if fit is None:
                    break
                held, gap = [*held, fit], gap - fit
            out.append((held, stock.take(held)))
    return out


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence of lo, offset): where pieces ranked lo..hi-1 of a length go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            lo = used.get(x, 0)
            rows.append((x, lo, lo + times, sequence, at))
            used[x], at = lo + times, at + x
        sequence += times
    return rows


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Give every piece its sequence_id and offset; ``cut`` must be a written table.

    Ranks inside a length are taken in salted groups and shifted by the groups before, so
    copies of one text, which share a length, do not meet in one task.
    """
    spark = cut.sparkSession
    found = cut.groupBy("length").count().collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    salts = max(64, int(counts.sum() // 20_000))
    rows = places(plan(counts, size)) or [(0, 0, 0, 0, 0)]
    where = spark.createDataFrame(rows, "length long, lo long, hi long, first long, offset long")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count()
    sums = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id", "piece")) - 1
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("before")).alias("p")
    on = (F.col("p.length") == F.col("w.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(where.alias("w")), on).select(
        "doc_id",
        "piece",
        "start",
        F.col("p.length").alias("length"),
        "ids_crc32",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"),
        "offset",
    )


def best_fit_packing(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); see the module for the defined cases."""
    return pack(written(pieces(docs, vocabulary, size, end_id), "pieces"), size)
