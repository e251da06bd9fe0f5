"""Merge-dropout encoding and lossless decoding with a SentencePiece BPE model.

Pieces, their scores and their kinds come from the model file; merges are done here.  A text
is cut before every word (spaces belong to the word after them), since no piece of a BPE
model crosses such a cut.  In a segment every adjacent pair whose joined piece exists is on
an agenda, best score first, then leftmost.  A merge that comes up is skipped if the keyed
hash of (seed, document, place of the segment, its bounds) draws a skip at the dropout rate; a
skipped pair comes back only as part of another.  Every occurrence of a word has draws of its
own, and a run can be repeated anywhere.  Dropout 0 gives the model's own segmentation.

The agendas of all segments of a batch of texts run side by side, one turn of each at a time.
The segmentation without a skip is remembered for each word; an occurrence whose draws skip
none of its merges has it, all others run their agenda with their draws.

Characters without a piece, and the space sign itself where the text has it, become byte
pieces, so decoding restores every text.  Null and empty texts have no tokens.  Very long
texts and segments are encoded whole.  Repeated rows with one doc_id are cut alike.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices

SPACE = "▁"
#: Cannot be in a text: marks segments that do not begin with a space, and alone a space sign of the text.
_MARK = "\udfff"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MASK = (1 << 64) - 1
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_START, _MIDDLE, _END = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: No pair; ranks stand above six bits of place.
_NONE = np.int32(2**31 - 1)
#: Longest segment whose agenda runs beside others.
_BESIDE = 63


def _places(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each candidate's bounds."""
    return start.astype(np.uint64) * np.uint64(_START) + middle.astype(np.uint64) * np.uint64(_MIDDLE) + end.astype(np.uint64) * np.uint64(_END)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers, as in ``Encoder.skips``."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX2)
    return x ^ x >> np.uint64(31)


def _gathered(pool: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The runs pool[at:at + many], joined."""
    ends = np.cumsum(many)
    return pool[np.repeat(at - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]


class Runs:
    """Runs of numbers of different lengths, kept in one array that grows."""

    def __init__(self, dtype):
        self.data, self.at, self.many, self.size, self.runs = np.zeros(1024, dtype), np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0

    def add(self, data: np.ndarray, many: np.ndarray) -> None:
        for name, need in (("data", self.size + len(data)), ("at", self.runs + len(many)), ("many", self.runs + len(many))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.data[self.size : self.size + len(data)] = data
        self.at[self.runs : self.runs + len(many)] = self.size + np.cumsum(many) - many
        self.many[self.runs : self.runs + len(many)] = many
        self.size, self.runs = self.size + len(data), self.runs + len(many)


class Characters(dict):
    """Symbols of characters; one without a piece gets a symbol of its own when it is first met."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, char: str) -> int:
        i = self.pieces.ids.get(char)
        if i is None:
            i = self.pieces.size + len(self.pieces.expanded)
            self.pieces.expanded.append([self.pieces.byte_ids[b] for b in char.encode()])
        self[char] = i
        return i


class Pieces:
    """What the model file holds: symbols, the merges of two symbols, ids and bytes.

    The symbols are the ids of pieces, then characters without a piece of their own.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.size = len(every)
        self.ids = {sp.id_to_piece(i): i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.ranks = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.bytes = [b""] * self.size
        for piece, i in self.ids.items():
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.chars = Characters(self)
        self.expanded: list[list[int]] = []  # byte ids of the symbols beyond the pieces
        found: dict[int, int] = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k]), self.symbol(piece[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        self.pairs = np.array(sorted(found))
        self.merged = np.array([found[k] for k in self.pairs.tolist()], dtype=np.int32)
        rank = np.zeros(self.size, dtype=np.int32)
        rank[list(self.ids.values())] = [self.ranks[p] for p in self.ids]
        self.merged_rank = rank[self.merged] << 6

    def symbol(self, part: str) -> int | None:
        """A piece's or a character's symbol; longer parts without a piece have none."""
        return self.chars[part] if len(part) == 1 else self.ids.get(part)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank above the place bits, symbol) of each pair's merge; rank _NONE where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged_rank[at], _NONE), self.merged[at]

    def tokens(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(ids, how many for each symbol or None where that is one)."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, None
        parts = [self.expanded[s - self.size] for s in symbols[odd].tolist()]
        many = np.ones(len(symbols), dtype=np.int64)
        many[odd] = [len(p) for p in parts]
        out = np.repeat(symbols, many)
        at = np.cumsum(many)[odd] - many[odd]
        out[np.repeat(at, many[odd]) + np.concatenate([np.arange(len(p)) for p in parts])] = np.concatenate(parts)
        return out, many

    def text(self, ids: np.ndarray) -> bytes:
        return _gathered(self.spelled, self.starts[ids], self.lengths[ids]).tobytes()


class Encoder:
    """Encodes texts with draws of their own at every place; ``keep`` bounds the words that are remembered."""

    def __init__(self, path: str, dropout: float, seed: int, keep: int = 300_000):
        self.pieces, self.seed, self.keep = Pieces(path), seed, keep
        self.varied = dropout > 0
        self.below = int(dropout * 2.0**53)
        self._forget()

    def _forget(self) -> None:
        """Words by number; their symbols, their merges without a skip, and what these give."""
        self.words: dict[str, int] = {}
        self.symbols, self.merges, self.plain = Runs(np.int32), Runs(np.uint64), Runs(np.int32)

    def batch(self, texts: list[str | None], docs: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, joined; where each text ends)."""
        import xxhash

        if len(self.words) > self.keep:
            self._forget()
        segments: list[str] = []
        ends = []
        for t in texts:
            segments += self._segments(t) if t else ()
            ends.append(len(segments))
        ends = np.array(ends, dtype=np.int64)
        known = self.words
        try:
            word = np.array([known[s] for s in segments], dtype=np.int64)
        except KeyError:
            self._learn(list({s: None for s in segments if s not in known}))
            word = np.array([known[s] for s in segments], dtype=np.int64)
        at, many = self.plain.at[word], self.plain.many[word]
        pool = self.plain.data[: self.plain.size]
        counts = np.diff(ends, prepend=0)
        bases = [xxhash.xxh3_64_intdigest(struct.pack("<qq?", self.seed, d or 0, d is None)) for d in docs]
        place = np.arange(len(word)) - np.repeat(ends - counts, counts)
        keys = _mixed(np.repeat(np.array(bases, dtype=np.uint64), counts) + place.astype(np.uint64) * np.uint64(_GOLDEN))
        long = np.flatnonzero(self.symbols.many[word] > _BESIDE)
        if self.varied:
            n = self.merges.many[word]
            x = _gathered(self.merges.data, self.merges.at[word], n) + np.repeat(keys, n)
            hit = np.unique(np.repeat(np.arange(len(word)), n)[self._skipped(x)])
            if len(hit):
                new, sizes = self._run(word[hit], keys[hit])
                at[hit], many[hit] = len(pool) + np.cumsum(sizes) - sizes, sizes
                pool = np.concatenate([pool, new])
        if len(long):
            # Long segments are merged at their place.
            parts = [self._long(self._text(segments[i]), int(keys[i])) for i in long.tolist()]
            new = np.array([self.pieces.symbol(p) for part in parts for p in part], dtype=np.int32)
            sizes = np.array([len(p) for p in parts])
            at[long], many[long] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, new])
        ids, each = self.pieces.tokens(_gathered(pool, at, many))
        done = np.concatenate([[0], np.cumsum(many)])[ends]
        return ids, done if each is None else np.concatenate([[0], np.cumsum(each)])[done]

    def packed(self, text: str | None, doc: int | None) -> bytes:
        """Token ids of one text as little-endian 32-bit numbers."""
        return self.batch([text], [doc])[0].astype("<u4").tobytes()

    @staticmethod
    def _segments(text: str) -> list[str]:
        """Segments of a text, each without the space it begins with."""
        if SPACE in text:
            parts = (SPACE + text.replace(SPACE, _MARK).replace(" ", SPACE)).split(_MARK)
            out = []
            for k, part in enumerate(parts):
                out += [_MARK] * (k > 0) + [s[1:] if s[0] == SPACE else _MARK + s for s in _SEGMENT.findall(part)]
            return out
        words = text.split(" ")
        # Two spaces in a row, or one at an end, leave an empty word: these belong to the word after them.
        return words if "" not in words else [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]

    @staticmethod
    def _text(segment: str) -> str:
        return segment[1:] if segment[:1] == _MARK else SPACE + segment

    def _learn(self, new: list[str]) -> None:
        """Remember words: their symbols, merges and segmentation without a skip."""
        symbol, sign = self.pieces.chars.__getitem__, [self.pieces.byte_ids[b] for b in SPACE.encode()]
        texts = [self._text(s) for s in new]
        sizes = np.array([len(t) for t in texts])
        first = self.symbols.runs
        self.symbols.add(np.fromiter(map(symbol, "".join(texts)), np.int32, sizes.sum()), sizes)
        out, many, merges, merged = self._run(np.arange(first, first + len(new)), None)
        self.merges.add(merges, merged)
        if _MARK in new:
            k = new.index(_MARK)
            out, many[k] = np.insert(out, many[:k].sum(), sign), len(sign)
        self.plain.add(out, many)
        self.words.update(zip(new, range(first, first + len(new)), strict=True))

    def _skipped(self, x: np.ndarray) -> np.ndarray:
        return (_mixed(x) >> np.uint64(11)) < np.uint64(self.below)

    def _run(self, words: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """The symbols that the agendas of ``words`` end with, joined, and how many for each.

        With ``keys`` merges are skipped by draws; without, merges and their numbers are
        returned too.  Segments of like lengths run beside each other; longer ones than
        ``_BESIDE`` give nothing.
        """
        size = self.symbols.many[words]
        parts, low = [], 0
        for high in (8, 12, 20, 36, _BESIDE):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(rows):
                parts.append((rows, *self._agendas(words[rows], size[rows], high, None if keys is None else keys[rows])))
        out = []
        for k in (1, 3) if keys is None else (1,):
            many = np.zeros(len(words), dtype=np.int64)
            for p in parts:
                many[p[0]] = p[k + 1]
            data = np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int32 if k == 1 else np.uint64)
            # From the order of the parts to that of the words.
            at = np.zeros(len(words), dtype=np.int64)
            rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            at[rows] = np.cumsum(many[rows]) - many[rows]
            out += [_gathered(data, at, many), many]
        return tuple(out)

    def _agendas(self, words: np.ndarray, size: np.ndarray, width: int, keys: np.ndarray | None) -> tuple[np.ndarray, ...]:
        n = len(words)
        column, row = np.arange(width + 1)[:, None], np.arange(n)
        # A column for each segment, a line for each place; one more line ends them.
        inside = column < size
        symbols = np.zeros((width + 1, n), dtype=np.int32)
        symbols.T[inside.T] = _gathered(self.symbols.data, self.symbols.at[words], size)
        after = np.repeat((column + 1).astype(np.int8), n, axis=1)
        before = np.repeat((column - 1).astype(np.int8), n, axis=1)
        rank, to = self.pieces.join(symbols[:-1], symbols[1:])
        rank = np.where(inside[1:] & (rank != _NONE), rank + column[:-1], _NONE).astype(np.int32)
        flat, nxt, prev, agenda, target, alive = symbols.ravel(), after.ravel(), before.ravel(), rank.ravel(), to.ravel(), inside.ravel()
        seen_row, seen_place = [], []
        live, best = row, rank.min(0)
        while True:
            best = rank.min(0) if len(live) == n else rank[:, live].min(0)
            going = best != _NONE
            live, best = live[going], best[going]
            if not len(live):
                break
            i = (best & 63).astype(np.int64)
            here = i * n + live
            j = nxt[here].astype(np.int64)
            k = nxt[j * n + live].astype(np.int64)
            turn = live
            if keys is None:
                seen_row.append(live)
                seen_place.append(_places(i, j, k))
            else:
                skip = self._skipped(keys[live] + _places(i, j, k))
                agenda[here[skip]] = _NONE
                keep = ~skip
                turn, i, j, k, here = live[keep], i[keep], j[keep], k[keep], here[keep]
            there = j * n + turn
            flat[here] = target[here]
            nxt[here] = k
            alive[there] = False
            # The last line's places take no part, so what lies beyond them is never a pair.
            agenda[there[j < width]] = _NONE
            agenda[here] = _NONE
            more = k < size[turn]
            prev[k[more] * n + turn[more]] = i[more]
            h = prev[here].astype(np.int64)
            some = h >= 0
            # The new part with the one before it, and with the one after it.
            a = np.concatenate([h[some], i[more]])
            at = np.concatenate([turn[some], turn[more]])
            b = np.concatenate([i[some], k[more]])
            left = a * n + at
            r, t = self.pieces.join(flat[left], flat[b * n + at])
            agenda[left] = np.where(r != _NONE, r + a, _NONE)
            target[left] = t
        got = symbols.T[inside.T], inside.sum(0)
        if keys is not None:
            return got
        rows = np.concatenate(seen_row) if seen_row else np.zeros(0, dtype=np.int64)
        by = np.argsort(rows, kind="stable")
        return *got, (np.concatenate(seen_place) if seen_place else np.zeros(0, np.uint64))[by], np.bincount(rows, minlength=n)

    def skips(self, key: int, start: int, middle: int, end: int) -> bool:
        x = (key + start * _START + middle * _MIDDLE + end * _END) & _MASK
        x = ((x ^ x >> 30) * _MIX1) & _MASK
        x = ((x ^ x >> 27) * _MIX2) & _MASK
        return (x ^ x >> 31) >> 11 < self.below

    def _long(self, text: str, key: int) -> list[str]:
        """Pieces of one long segment: the agenda as a heap, with the same order and the same skips."""
        ranks, n = self.pieces.ranks, len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        agenda: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (r := ranks.get(text[a : end[b]])) is not None:
                heapq.heappush(agenda, (r, a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        alive = bytearray(b"\1" * n)
        while agenda:
            _, a, b, z = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or end[a] != b or end[b] != z:
                continue
            if self.varied and self.skips(key, a, b, z):
                continue
            alive[b], end[a] = 0, z
            if z < n:
                before[z] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [text[a : end[a]] for a in range(n) if alive[a]]


def encoder(model: str, dropout: float, seed: int) -> Encoder:
    """One encoder for all tasks of a worker process, with what it remembers."""
    return remembered("merge_dropout", (model, dropout, seed), lambda: Encoder(model, dropout, seed))


def decoded(ids, pieces: Pieces) -> str:
    """The text of token ids: joined bytes without the space that encoding puts in front."""
    return pieces.text(np.asarray(ids, dtype=np.int64))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text) → doc_id, ids array<int>; null texts have no ids."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(model, dropout, seed)
        for b in slices(batches, 64):
            ids, ends = enc.batch(b.column(1).to_pylist(), b.column(0).to_pylist())
            at = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) → doc_id, text."""

    def run(batches):
        import pyarrow as pa

        pieces = Pieces(model)
        for b in slices(batches, 64):
            texts = [decoded(x or [], pieces) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_crc32 of the decoded text, and lossless, in one pass."""
    names = ["doc_id", "n_tokens", "ids_crc32", "text_crc32", "lossless"]

    def run(batches):
        import pyarrow as pa

        enc = encoder(model, dropout, seed)
        for b in slices(batches, 64):
            texts = b.column(1).to_pylist()
            ids, ends = enc.batch(texts, b.column(0).to_pylist())
            data, out = memoryview(ids.astype("<u4").tobytes()), []
            spelled = memoryview(enc.pieces.text(ids))
            cuts = np.concatenate([[0], np.cumsum(enc.pieces.lengths[ids])])[ends].tolist()
            at = start = 0
            for end, cut, text in zip(ends.tolist(), cuts, texts, strict=True):
                back = spelled[start + 1 : cut]
                out.append((end - at, zlib.crc32(data[4 * at : 4 * end]), zlib.crc32(back), back == (text or "").encode()))
                at, start = end, cut
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long, lossless boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
