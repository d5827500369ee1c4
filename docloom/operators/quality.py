"""Exact tallies of what extraction has given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.schema import BLOCK_TYPES


def tally(blocks: DataFrame, *, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counters of each document's blocks.  The text of formulas is counted in ``text_chars`` too."""
    kind, text = F.col("type"), F.coalesce(F.length("text"), F.lit(0)).cast("long")
    cells = F.coalesce(F.size("cells"), F.lit(0))
    cells = F.when(cells > 0, cells).otherwise(0).cast("long")
    filled = F.coalesce(F.size(F.filter("cells", lambda c: F.coalesce(c["text"], F.lit("")) != "")), F.lit(0))
    filled = F.when(filled > 0, filled).otherwise(0).cast("long")
    formula, table, reference = kind == "formula", kind == "table", kind == "reference"
    return blocks.groupBy(*key).agg(
        F.count(F.lit(1)).alias("blocks_total"),
        *[F.count_if(kind == t).alias(f"blocks_{t}") for t in BLOCK_TYPES],
        F.sum(text).alias("text_chars"),
        F.count_if("miss").alias("miss"),
        F.count_if(formula & (text > 0)).alias("formulas_with_text"),
        F.count_if(formula & (F.coalesce(F.col("image_path"), F.lit("")) != "")).alias("formulas_with_image"),
        F.sum(F.when(formula, text).otherwise(0)).alias("formula_latex_chars"),
        F.count_if(table & (cells > 0)).alias("tables_with_cells"),
        F.count_if(table & (cells == 0)).alias("tables_image_only"),
        F.sum(F.when(table, cells).otherwise(0)).alias("total_cells"),
        F.sum(F.when(table, filled).otherwise(0)).alias("cells_with_text"),
        F.sum(F.when(table, cells - filled).otherwise(0)).alias("cells_empty"),
        F.count_if(reference & F.col("reference").isNotNull()).alias("references_parsed"),
        F.count_if(reference).alias("references_total"),
    )


def top_labels(blocks: DataFrame, n: int = 10, *, order: str = "ord") -> DataFrame:
    """The ``n`` most frequent labels; of equally frequent ones that which comes first by ``order``."""
    counts = blocks.groupBy("label").agg(F.count(F.lit(1)).alias("blocks"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("blocks"), "first_seen").limit(n)


def previews(blocks: DataFrame, n: int = 5, width: int = 60) -> DataFrame:
    """The first ``n`` blocks of each document's first page, their texts on one line and cut to ``width``."""
    first = blocks.where("page_idx = 0").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")))
    return first.where(F.col("place") <= n).withColumn("preview", F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), 1, width))
