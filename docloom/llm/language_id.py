"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a word of bits for each slot, one bit for each language; the AND
over an n-gram's slots is the set of all languages that contain it.  A text's n-grams are looked
up at once, each language's hits are counted and corrected for its false positives, and the
language with most hits is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_arrow, with_arrow_columns

UNDETERMINED = "und"
_N = 4  # bytes in an n-gram
_LETTERS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """The 4-byte n-grams of the lower-cased text, runs of other ASCII characters as one blank."""
    plain = b" %b " % b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split())
    b = np.frombuffer(plain, np.uint8).astype(np.uint32)
    if len(b) < _N:
        return np.empty(0, np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


@dataclass
class LanguageFilters:
    """``slots[plane, i]`` has bit l set if language 64 * plane + l posted an n-gram in slot i."""

    languages: list[str]  # the more frequent first, then by name; ties in hits go this way
    slots: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], languages: list[str], bits: int) -> LanguageFilters:
        planes = max(1, -(-len(languages) // 64))
        slots = np.zeros((planes, 1 << bits), np.uint64)
        for i, language in enumerate(languages):
            for at in cls.places(sets[language], bits):
                slots[i // 64, at] |= np.uint64(1 << i % 64)
        load = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        if len(languages) <= 8:
            slots = slots.astype(np.uint8)
        return cls(languages, slots, load**2)

    @staticmethod
    def places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint32(32 - bits)
        return (g * np.uint32(0x9E3779B1)) >> shift, ((g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> shift

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Hits of each language, less those that false positives explain."""
        first, second = self.places(g, int(self.slots.shape[1]).bit_length() - 1)
        found = [plane[first] & plane[second] for plane in self.slots]
        if self.slots.dtype == np.uint8:
            masks = np.bincount(found[0], minlength=256)
            raw = np.array([masks[np.arange(256) >> i & 1 == 1].sum() for i in range(len(self.languages))])
        else:
            raw = np.array([((found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum() for i in range(len(self.languages))])
        return np.maximum(raw - len(g) * self.false_positive, 0) / (1 - self.false_positive)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        g = grams(text)
        if not len(g):
            return self.languages[0], 0.0
        hits = self.hits(g)
        best = int(np.argmax(hits))
        return self.languages[best], min(1.0, float(hits[best]) / len(g))


def fit(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    language_col: str = "lang",
    docs_per_language: int = 1000,
    min_share: float = 2e-5,
    bits: int = 20,
) -> LanguageFilters:
    """Filters from labelled rows; rows with a null language or text teach nothing.

    At most about ``docs_per_language`` rows of a language are read for n-grams, those of the lowest
    id hashes (the bound of the sample).  An n-gram belongs to a language if it makes up ``min_share``
    of the language's n-grams, so a language has at most 1 / min_share of them.  No rows: no languages.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(language_col).cast("string").alias("language"))
    rows = rows.where("text IS NOT NULL AND language IS NOT NULL")
    counts = {r["language"]: r["count"] for r in rows.groupBy("language").count().collect()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return LanguageFilters([], np.zeros((1, 2), np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / counts[k]))])
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(uniform < share[F.col("language")]).select("language", "text")

    def count(batches):
        for batch in batches:
            by_language: dict[str, list] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(language, []).append(grams(text))
            for language, found in by_language.items():
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(values)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])

    counted = map_arrow(sample, count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("language").agg(F.sum("n").alias("total"))
    common = counted.join(totals, "language").where(F.col("n") >= F.col("total") * min_share).select("language", "gram")
    sets: dict[str, list[int]] = {k: [] for k in languages}
    for r in common.toLocalIterator():
        sets[r["language"]].append(r["gram"])
    return LanguageFilters.build({k: np.array(v, np.uint32) for k, v in sets.items()}, languages, bits)


def identify(documents: DataFrame, model: LanguageFilters, *, text_col: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``.

    A null text, one without a letter, or a model without languages gives 'und' and 0.  A text of
    which nothing is known gets the most frequent language and 0; of languages with equal hits the
    more frequent wins.  Rows are kept as they are, repeated ones too; input columns named like the
    two are replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        filters = sent.value

        def run(texts):
            found = [filters.predict(x.as_py()) for x in texts]
            return pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())

        return run

    return with_arrow_columns(documents, [text_col], make, "lang_pred string, score double")
