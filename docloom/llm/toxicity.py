"""Toxicity by multiple-instance learning.

A sentence's score is logistic in its hashed words; a document is toxic if any sentence is, so the
document's score is the noisy-or of its sentences'.  Only documents have labels: the gradient of
the document's likelihood reaches the words through the noisy-or, and the same model then points
at the offending sentences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordCodes, map_arrow, with_arrow_columns

_BITS = 18
_MASK = (1 << _BITS) - 1
_MARKS = "\"'()[]{}<>.,;:!?*_-–—…«»“”‘’¿¡|#$%&@+=~^/\\"
_PREFIX = 5


def _bucket(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode("utf-8", "replace")) % ((1 << _BITS) - 1)


def _code(word: str) -> int:
    """Bit 0: a sentence ends here; then the buckets (0: none) of the word and of how it begins."""
    ends = word == "\n" or word.endswith((".", "!", "?"))
    plain = word.strip(_MARKS).lower()
    if not plain or plain == "\n":
        return int(ends)
    begins = _bucket("^" + plain[:_PREFIX]) if len(plain) > _PREFIX else 0
    return ends | _bucket(plain) << 1 | begins << (1 + _BITS)


class Reader:
    """Text -> tokens -> (their codes, first token of each sentence)."""

    def __init__(self) -> None:
        self.codes = WordCodes(_code)

    def tokens(self, text: str) -> list[str]:
        for c in "\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return text.replace("\n", " \n ").split(" ")

    def sentences(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        starts = np.flatnonzero(codes[:-1] & 1) + 1
        return codes, np.concatenate((np.zeros(1, np.int64), starts))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by bucket; that of bucket 0 is 0
    bias: float

    def logits(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[codes >> 1 & _MASK] + self.weights[codes >> (1 + _BITS)], starts) + self.bias


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(logit))."""
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum()))


def fit(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    docs_per_class: int = 3000,
    min_docs: int = 4,
    l1: float = 1e-4,
    rounds: int = 300,
    rate: float = 0.08,
) -> ToxicityModel:
    """Fits on at most about ``docs_per_class`` labelled rows of each class, those of the lowest id
    hashes (the bound of the sample), weighted so that the classes keep their shares.

    Null texts and labels teach nothing.  Without rows of both classes the score is the share of
    label 1 everywhere (0 without rows).
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("text IS NOT NULL AND label IN (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    weights = np.zeros(1 << _BITS)
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
        return ToxicityModel(weights, float(np.log(share / (1 - share))))
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("label") == 1, min(1.0, docs_per_class / counts[1])).otherwise(min(1.0, docs_per_class / counts[0]))

    def read(batches):
        reader = Reader()
        for batch in batches:
            labels, found, firsts = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, starts = reader.sentences(reader.tokens(text))
                labels.append(label)
                found.append(codes.astype("<i8").tobytes())
                firsts.append(starts.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.binary()), pa.array(firsts, pa.binary())], names=["label", "codes", "starts"])

    sample = map_arrow(rows.where(uniform < share).select("label", "text"), read, "label int, codes binary, starts binary").collect()
    sample.sort(key=lambda r: (r["label"], bytes(r["codes"])))  # the order in which tasks end doesn't matter
    y = np.array([r["label"] for r in sample], float)
    docs = [np.frombuffer(r["codes"], "<i8") for r in sample]
    firsts = [np.frombuffer(r["starts"], "<i4").astype(np.int64) for r in sample]
    tokens = np.concatenate(docs)
    begin = np.cumsum([0, *map(len, docs)])[:-1]
    sentence_at = np.concatenate([f + b for f, b in zip(firsts, begin, strict=True)])
    doc_at = np.cumsum([0, *map(len, firsts)])[:-1]
    in_sentence = np.repeat(np.arange(len(sentence_at)), np.diff(np.r_[sentence_at, len(tokens)]))
    in_doc = np.repeat(np.arange(len(docs)), [len(f) for f in firsts])
    seen = np.zeros(1 << _BITS, int)
    for d in docs:
        seen[np.unique(np.r_[d >> 1 & _MASK, d >> (1 + _BITS)])] += 1
    used = np.flatnonzero(seen >= min_docs)
    used = used[used > 0]
    place = np.full(1 << _BITS, len(used))
    place[used] = np.arange(len(used))
    tokens = place[np.r_[tokens >> 1 & _MASK, tokens >> (1 + _BITS)]]
    in_sentence = np.r_[in_sentence, in_sentence]
    keep = tokens < len(used)
    tokens, in_sentence = tokens[keep], in_sentence[keep]
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    importance = np.where(y == 1, counts[1] / total / n1, counts[0] / total / n0)

    w, bias = np.zeros(len(used)), -3.0 - np.log(max(1.0, len(sentence_at) / len(docs)))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(in_sentence, w[tokens], len(sentence_at)) + bias, -40, 30)
        safe = np.logaddexp(0.0, z)
        s = np.maximum(np.add.reduceat(safe, doc_at), 1e-12)  # -log(1 - P)
        # d loss / d s: 1 where the label is 0, -(1 - P) / P where it is 1
        slope = importance * np.where(y == 1, -1.0 / np.expm1(np.minimum(s, 50.0)), 1.0)
        slope = np.clip(slope, -1e3, 1e3)
        dz = slope[in_doc] / (1 + np.exp(-z))
        g, gb = np.bincount(tokens, dz[in_sentence], len(used)), dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        scale = np.sqrt(v / c2) + 1e-8
        w = w - lr * (m / c1) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - lr * l1 / (scale + 1e-4), 0)
        bias -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights[used] = w
    return ToxicityModel(weights, float(bias))


def score(documents: DataFrame, model: ToxicityModel, *, text_col: str = "text", sentence_score: float = 0.5) -> DataFrame:
    """``documents`` with ``score`` and ``offending``: the sentences whose own score is at least
    ``sentence_score``, as (start, end, score), positions in characters.

    A null or empty text has one empty sentence, so its score is that of the bias alone.  Rows are
    kept as they are; input columns named like the two are replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        reader, toxic = Reader(), sent.value
        threshold = np.log(sentence_score / (1 - sentence_score))

        def one(text: str) -> tuple[float, list[dict]]:
            tokens = reader.tokens(text)
            codes, starts = reader.sentences(tokens)
            z = toxic.logits(codes, starts)
            spans = []
            if z.max() >= threshold:
                # "\n" was set between two blanks, which are not in the text
                size = np.fromiter((0 if t == "\n" else len(t) + 1 for t in tokens), np.int64, len(tokens))
                at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
                ends = np.r_[starts[1:], len(tokens)]
                for k in np.flatnonzero(z >= threshold):
                    start, end = int(at[starts[k]]), int(at[ends[k]]) - 1
                    raw = text[max(start, 0) : end]
                    start = max(start, 0) + len(raw) - len(raw.lstrip())
                    spans.append({"start": start, "end": start + len(raw.strip()), "score": float(1 / (1 + np.exp(-z[k])))})
            return noisy_or(z), spans

        def run(texts):
            found = [one(x.as_py() or "") for x in texts]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            return pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], kind)

        return run

    return with_arrow_columns(documents, [text_col], make, "score double, offending array<struct<start:bigint,end:bigint,score:double>>")
