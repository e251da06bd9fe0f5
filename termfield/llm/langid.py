"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of a bounded sample of its
training texts (about ``sample_rows`` rows and ``dict_bytes`` bytes a language, the rows with
the smallest key hashes; of a long text no more than what fits).  A text is encoded in chunks
with every dictionary; the language whose dictionary gives the fewest bytes wins.  The score
grows with the margin to the second best.  A margin below ``narrow`` is a rejection: where
languages mix, or in none of them, dictionaries help about alike.  ``narrow`` is the margin that
all but ``lost`` of the sampled rows outside the dictionaries reach, among those told right.

Texts are encoded quickly, close calls (under 6 % of the second size, ``close``) once more: thoroughly,
or, if short, behind primers (see :class:`Coder`); the margin is that of the last encoding.

Null texts and texts without a letter (by Unicode category: number signs are none) are ``und`` with score 0, and rejected.  Very long
texts are encoded whole, chunk by chunk.  Ties go to the language first in the alphabet, and
have no margin.  Without training rows every prediction is ``und``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

UNDETERMINED = "und"

#: Runs of letters and number signs such as one half; which of these are letters is for str.isalpha to say.
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def normal(text: str) -> str:
    """The words in lower case, letters only: what dictionaries and texts have in common."""
    return " ".join(w for x in _WORD.findall(text.lower()) for w in ((x,) if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split()))


@dataclass
class LanguageModel:
    """Dictionary bytes by language, and the margin below which a text is rejected."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    narrow: float = 0.0


def learn(docs: DataFrame, training: Column, sample_rows: int = 400, dict_bytes: int = 36 << 10, lost: float = 0.005) -> LanguageModel:
    """Dictionaries and margin, from rows where ``training`` holds and lang is not null.

    A row is in the sample if its key hash is below a bound that leaves about ``sample_rows``
    rows of its language; only counts of languages and the sample reach the driver.
    """
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = rows.groupBy("lang").count().collect()
    if not langs:
        return LanguageModel()
    most = 1 << 40
    bounds = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], min(most, most * sample_rows // r["count"]))])
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(most))
    # What one text can give is bounded by the dictionary.
    chosen = rows.where(key < bounds[F.col("lang")]).select("lang", key.alias("h"), F.substring("text", 1, 2 * dict_bytes).alias("text")).distinct()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.toLocalIterator():
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    dictionaries, rest = {}, []
    for lang, texts in sorted(by.items()):
        parts = [p for _, t in sorted(texts) if (p := normal(t).encode())]
        # First what fits of each text up to an eighth, then the remains of long ones.
        share, used, size, at = dict_bytes // 8, [], 0, 0
        for at, part in enumerate(parts):
            if size >= dict_bytes:
                break
            used.append(part[: min(share, dict_bytes - size)])
            size += len(used[-1]) + 1
        else:
            at = len(parts)
        used += [p[share : share + max(0, dict_bytes - size)] for p in parts[:at] if len(p) > share and size < dict_bytes]
        data = b"\n".join(used)[:dict_bytes]
        if data:
            dictionaries[lang] = data
            rest += [(lang, p.decode("utf-8", "ignore")) for p in parts[at : at + sample_rows // 2]]
    coder = Coder(dictionaries)
    told = [coder.predict(t) for _, t in rest]
    margins = sorted(m for (lang, _), (x, _, m) in zip(rest, told, strict=True) if x == lang)
    return LanguageModel(dictionaries, margins[int(lost * len(margins))] if margins else 0.0)


class Coder:
    """Encoded sizes of a text by language: quick ones, and thorough ones for close calls.

    The thorough encoder searches longer for matches with the same dictionaries; a text goes
    to it where the quick margin is below ``close``.  A text under ``short`` bytes is too
    little for whole bytes to tell languages apart: it is encoded behind each of several
    primers, the last eighth of the sample in eight parts, which are not in the dictionary,
    and the growth is summed.
    """

    def __init__(self, dictionaries: dict[str, bytes], chunk: int = 8192, close: float = 0.06, short: int = 400):
        import zstandard as z

        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        quick = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=14, chain_log=14, search_log=3, **plain
        )
        thorough = z.ZstdCompressionParameters.from_level(12, **plain)
        self.langs, self.chunk, self.close, self.short = sorted(dictionaries), chunk, close, short
        split = {x: len(dictionaries[x]) * 7 // 8 for x in self.langs}
        self.quick, self.thorough = ([self._coder(z, dictionaries[x][: split[x]], p) for x in self.langs] for p in (quick, thorough))
        self.primers = []
        for x, c in zip(self.langs, self.thorough, strict=True):
            rest = dictionaries[x][split[x] :]
            step = max(1, len(rest) // 8)
            parts = [rest[i : i + step] for i in range(0, len(rest), step)]
            self.primers.append([(p, len(c.compress(p))) for p in parts])

    @staticmethod
    def _coder(z, data: bytes, params):
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return z.ZstdCompressor(dict_data=d, compression_params=params)

    def sizes(self, data: bytes, coders: list) -> list[int]:
        step = self.chunk
        parts = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(c.compress(p)) for p in parts) for c in coders]

    def growth(self, data: bytes) -> list[int]:
        pairs = zip(self.thorough, self.primers, strict=True)
        return [sum(len(c.compress(p + b" " + data)) - n for p, n in primers) for c, primers in pairs]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin as a share of the second best size)."""
        if not self.langs or text is None or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        data = normal(text).encode()
        sizes = self.sizes(data, self.quick)
        if len(sizes) > 1:
            best, second = sorted(sizes)[:2]
            if second - best < self.close * second:
                sizes = self.growth(data) if len(data) < self.short else self.sizes(data, self.thorough)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[order[0]], 1.0, 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / max(second, 1)
        score = 1.0 / (1.0 + math.exp(-(second - best) / (2.0 + 0.01 * second)))
        return self.langs[order[0]], score, margin


def rejected(lang: str, margin: float, narrow: float) -> bool:
    return lang == UNDETERMINED or margin < narrow


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text and what else it holds) → doc_id, lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.narrow))

    def run(batches):
        import pyarrow as pa

        dictionaries, narrow = shared.value
        coder = Coder(dictionaries)
        for b in slices(batches):
            got = [coder.predict(t) for t in b.column(1).to_pylist()]
            lang, score, margin = zip(*got, strict=True)
            out = [rejected(x, m, narrow) for x, m in zip(lang, margin, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(out)],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    out = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.dictionaries, model.narrow))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        dictionaries, narrow = shared.value
        coder = Coder(dictionaries)
        for b in slices(batches):
            got = [coder.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([not rejected(x, m, narrow) for x, _, m in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
