"""What surrounds the models: OCR acceptance, formula batches, table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.geometry import clamped, moved, polygon_box
from docloom.functions.text import non_empty, strip, with_miss_mark

#: Bucket, least area of the next bucket, most tokens.
BUCKETS = (("small", 2500.0, 192), ("medium", 15000.0, 512), ("large", float("inf"), 1536))


def accepted_ocr(lines: Column, scores: Column, min_score: float = 0.5) -> Column:
    """The recognised lines joined by blanks; null without lines, below the mean score, or if nothing is left.
    Without scores the lines are accepted."""
    mean = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / F.size(scores)
    joined = non_empty(strip(F.array_join(F.filter(lines, lambda x: x != ""), " ")))
    low = F.coalesce(F.size(scores), F.lit(0)) > 0
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, None).when(low & (mean < min_score), None).otherwise(joined)


def checked_buckets(small: float, medium: float, small_tokens: int, medium_tokens: int, large_tokens: int) -> tuple:
    """Buckets of those bounds; an error unless 0 < small < medium and every cap is positive."""
    if not 0 < small < medium:
        raise ValueError(f"thresholds must grow from above 0: {small}, {medium}")
    if min(small_tokens, medium_tokens, large_tokens) < 1:
        raise ValueError("token caps must be positive")
    return (("small", small, small_tokens), ("medium", medium, medium_tokens), ("large", float("inf"), large_tokens))


def bucketed(formulas: DataFrame, buckets: tuple = BUCKETS, area: str = "bbox_area") -> DataFrame:
    """Adds ``bucket``, ``bucket_no`` and ``max_tokens`` by area; a bound belongs to the next bucket."""
    names, numbers, caps = F.lit(buckets[-1][0]), F.lit(len(buckets) - 1), F.lit(buckets[-1][2])
    for i in reversed(range(len(buckets) - 1)):
        name, bound, cap = buckets[i]
        below = F.col(area) < bound
        names, numbers, caps = F.when(below, name).otherwise(names), F.when(below, i).otherwise(numbers), F.when(below, cap).otherwise(caps)
    return formulas.withColumns({"bucket": names, "bucket_no": numbers, "max_tokens": caps})


def batched(formulas: DataFrame, batch_size: int, *, document: str = "doc_id", order: tuple[str, ...] = ("page_idx", "block_idx"), area: str = "bbox_area") -> DataFrame:
    """Adds ``place`` in the document's bucket, by area and then order, and ``batch_no``."""
    if batch_size < 1:
        raise ValueError("a batch has at least one row")
    ranked = F.row_number().over(Window.partitionBy(document, "bucket_no").orderBy(area, *order)) - 1
    return formulas.withColumn("place", ranked).withColumn("batch_no", F.floor(F.col("place") / batch_size).cast("int"))


def with_truncation(results: DataFrame, *, tokens: str = "n_tokens", document: str = "doc_id") -> DataFrame:
    """``truncated``: whether any row of the batch has reached its cap; so it depends on the batches."""
    batch = Window.partitionBy(document, "bucket_no", "batch_no")
    return results.withColumn("truncated", F.max(tokens).over(batch) >= F.max("max_tokens").over(batch))


def finished_formulas(blocks: DataFrame, miss_images_for: tuple[str, ...]) -> DataFrame:
    """Formulas with ``latex`` become text without a picture; the others are missed, with a marked picture or none."""
    done = non_empty(F.col("latex"))
    missed = with_miss_mark(F.col("image_path")) if "formula" in miss_images_for else F.lit(None).cast("string")
    return blocks.withColumns({"text": done, "miss": done.isNull(), "image_path": F.when(done.isNull(), missed)})


def table_cells(tables: DataFrame) -> DataFrame:
    """One row a cell from ``polygons`` (flat lists of points) and ``logic`` (row and column bounds), in a table
    at ``bbox`` on a page of ``width_px`` and ``height_px``; ``cell_idx`` goes by row and column, ties by input."""
    box, w, h = F.col("bbox"), F.col("width_px"), F.col("height_px")
    cells = tables.select("*", F.posexplode(F.arrays_zip("polygons", "logic")).alias("position", "cell"))
    inner = polygon_box(F.col("cell.polygons"), box["x2"] - box["x1"], box["y2"] - box["y1"])
    placed = cells.withColumn("cell_bbox", clamped(moved(inner, box["x1"], box["y1"]), w, h))
    bounds = {n: F.get("cell.logic", i).cast("int") for i, n in enumerate(("row_start", "row_end", "col_start", "col_end"))}
    placed = placed.withColumns(bounds)
    key = [c for c in ("doc_id", "page_idx", "block_idx") if c in tables.columns]
    order = Window.partitionBy(*key).orderBy("row_start", "col_start", "position")
    return placed.withColumn("cell_idx", F.row_number().over(order) - 1).drop("cell", "polygons", "logic")


def table_shape(cells: Column) -> dict[str, Column]:
    """Rows and columns of an array of cells, and how many have text; a table of under two cells has none."""

    def extent(field: str) -> Column:
        return F.coalesce(F.array_max(F.transform(cells, lambda c: c[field])), F.lit(-1)) + 1

    filled = F.size(F.filter(cells, lambda c: F.coalesce(c["text"], F.lit("")) != ""))
    return {"n_rows": extent("row_end"), "n_cols": extent("col_end"), "cells_with_text": filled}


def structured(cells: Column) -> Column:
    """The cells, null if there are fewer than two."""
    return F.when(F.size(cells) >= 2, cells)
