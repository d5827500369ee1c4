"""Importance resampling with hashed n-gram generative models.

A target model (texts known to be good) and a raw model (all texts) are bags of hashed uni- and
bigrams.  A text's log weight is the difference of its log likelihoods; Gumbel noise added to it
turns the k largest keys into a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordCodes, map_arrow, stored, with_arrow_columns, words_of


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


class Features:
    """Counts of hashed uni- and bigrams of the lower-cased words."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.codes = buckets, WordCodes(_hash)

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text.lower()) if text else []
        h = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        return (np.concatenate((h, pairs >> np.uint64(20))) % np.uint64(self.buckets)).astype(np.int64)


@dataclass
class ResamplingModel:
    log_ratio: np.ndarray  # by bucket: log target probability - log raw probability


def fit(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, smoothing: float = 1.0) -> ResamplingModel:
    """Models from all ``documents`` (raw) and those whose id is in ``targets`` (one column of distinct ids).

    Counts cover every row; only the ``buckets`` sums reach the driver.  Without any target row the
    ratio is 0 everywhere.  Null texts count nothing.
    """
    flagged = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        targets.select(F.col(targets.columns[0]).alias("id"), F.lit(True).alias("target")), "id", "left"
    )

    def count(batches):
        features, raw, target = Features(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, flag in zip(batch.column(0), batch.column(1), strict=True):
                n = np.bincount(features.of(text.as_py()), minlength=buckets)
                raw += n
                if flag.as_py():
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = map_arrow(flagged.select("text", "target"), count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for r in sums.collect():  # at most one row a bucket
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if target.sum() == smoothing * buckets:
        return ResamplingModel(np.zeros(buckets))
    return ResamplingModel(np.log(target / target.sum()) - np.log(raw / raw.sum()))


def weigh(documents: DataFrame, model: ResamplingModel, *, text_col: str = "text") -> DataFrame:
    """``documents`` with ``log_weight``, 0 for a null or empty text, and ``n_features``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        ratio = sent.value.log_ratio
        features = Features(len(ratio))

        def run(texts):
            found = [features.of(x.as_py()) for x in texts]
            return pa.array([float(ratio[x].sum()) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int64())

        return run

    return with_arrow_columns(documents, [text_col], make, "log_weight double, n_features bigint")


def gumbel_top_k(weighted: DataFrame, share: float, *, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds ``gumbel_key`` and ``kept``: whether the row is among the ``round(share * rows)`` largest keys.

    The noise is a function of id, seed and weight, so a rerun keeps the same rows.  Rows whose keys
    equal the k-th (repeated rows) are all kept.
    The k-th key is found by counting leading bits, 16 at a time: nothing is sorted, and the driver sees
    65,536 counts at most.
    """
    mixed = F.xxhash64(F.col(id_col), F.lit(seed), F.col("log_weight"))
    uniform = (F.shiftrightunsigned(mixed, 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    # fixed point: 24 bits of fraction, clipped far beyond any likelihood ratio
    fixed = F.round(F.greatest(F.lit(-1e11), F.least(F.lit(1e11), F.col("gumbel_key"))) * float(1 << 24)).cast("long") + F.lit(1 << 62)
    keyed = stored(keyed.withColumn("__rank", fixed), "gumbel")
    total = keyed.count()
    k = round(share * total)
    if k >= total:
        return keyed.drop("__rank").withColumn("kept", F.lit(True))
    if k <= 0:
        return keyed.drop("__rank").withColumn("kept", F.lit(False))
    prefix, wanted = 0, k
    for shift in (48, 32, 16, 0):
        here = keyed.where(F.shiftright("__rank", shift + 16) == prefix) if shift < 48 else keyed
        counts = here.groupBy(F.shiftright("__rank", shift).alias("digit")).count().collect()
        for digit, n in sorted(((r["digit"], r["count"]) for r in counts), reverse=True):
            if n >= wanted:
                prefix = digit
                break
            wanted -= n
    return keyed.withColumn("kept", F.col("__rank") >= prefix).drop("__rank")
