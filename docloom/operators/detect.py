"""Whether a document has a text layer, judged from some of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampled_pages(n_pages: Column, sample: int = 5) -> Column:
    """Evenly spaced page numbers, first and last included, rounded half to even."""
    n = F.least(F.lit(max(1, sample)), n_pages.cast("int"))
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (n_pages - 1) / (n - 1), 0).cast("int"))
    return F.when(n_pages < 1, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(spaced)))


def digital_born(pages: DataFrame, *, key: str = "doc_id", sample: int = 5, ratio: float = 0.3, min_chars: int = 100) -> DataFrame:
    """``digital_born`` of each document from its pages (``page_idx, n_chars``).

    True if the share of sampled pages with ``min_chars`` characters is at least ``ratio``, or if the median is at
    least half of ``min_chars`` and one page has as many.
    """
    totals = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_idx", "n_chars"))).alias("pages"))
    chosen = F.transform(sampled_pages(F.size("pages"), sample), lambda i: F.get("pages", i)["n_chars"])
    sampled = totals.select(key, F.explode(chosen).alias("n_chars"))
    rich = F.col("n_chars") >= min_chars
    stats = sampled.groupBy(key).agg(F.avg(rich.cast("int")).alias("share"), F.median("n_chars").alias("median"), F.count_if(rich).alias("n_rich"), F.count(F.lit(1)).alias("n_sampled"))
    verdict = (F.col("share") >= ratio) | ((F.col("median") >= min_chars / 2) & (F.col("n_rich") > 0))
    return stats.withColumn("digital_born", verdict)
