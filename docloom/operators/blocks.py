"""Detections to blocks, splices and per-document counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.geometry import area
from docloom.functions.text import crop_name, non_empty, strip
from docloom.operators.routing import CROP_ONLY_ROUTES, TEXT_ROUTES, block_type, route
from docloom.schema import BLOCK_TYPES

PAGE_KEY = ["doc_id", "page_idx"]


def with_reading_order(detections: DataFrame, by: str | None = "order_seq") -> DataFrame:
    """``reading_order``: the rank from 0 on the page by ``by`` (nulls last), ties by ``det_idx``; by ``det_idx`` alone if ``by`` is None."""
    order = [F.col(by).asc_nulls_last(), "det_idx"] if by else ["det_idx"]
    return detections.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy(*order)) - 1)


def with_block_idx(detections: DataFrame) -> DataFrame:
    """``block_idx``: the place among those that stay once ignored detections are gone."""
    kept = detections.where(route(F.col("label")) != "ignore")
    return kept.withColumn("block_idx", F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy("reading_order", "det_idx")) - 1)


def build_blocks(detections: DataFrame, miss_images_for: tuple[str, ...] = BLOCK_TYPES, crop_format: str = "png") -> DataFrame:
    """Adds ``type, text, image_path, miss`` to detections with ``route``, ``text`` and page key.

    Pictures, formulas and tables get a picture and no text.  Texts and references get their text, or are
    missed if it is null or empty; missed ones get a marked picture if ``miss_images_for`` has their type.
    """
    crop_only, with_text = F.col("route").isin(*CROP_ONLY_ROUTES), F.col("route").isin(*TEXT_ROUTES)
    text = F.when(with_text, non_empty(F.col("text")))
    miss = with_text & text.isNull()
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_idx").cast("string"), F.col("det_idx").cast("string"))
    path = crop_name(F.col("page_idx") + 1, F.col("label"), miss, key, crop_format)
    shown = crop_only | (miss & F.col("route").isin(*(miss_images_for or ("",))))
    return detections.withColumns({"type": block_type(F.col("route")), "image_path": F.when(shown, path), "miss": miss, "text": text})


def spliced(blocks: DataFrame, results: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """``columns`` taken from ``results`` where it has the block's key, kept elsewhere."""
    key = key or [*PAGE_KEY, "block_idx"]
    new = results.select(*key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = blocks.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__new", *[f"__{c}" for c in columns])


def zipped(left: DataFrame, right: DataFrame, key: str, values: str, results: str) -> DataFrame:
    """The arrays ``values`` and ``results`` of each key by position: missing results are null, surplus ones dropped."""
    a = left.select(key, F.posexplode(values).alias("position", "value"))
    b = right.select(key, F.posexplode(results).alias("position", "result"))
    return a.join(b, [key, "position"], "left")


def zipped_strictly(a: Column, b: Column) -> Column:
    """arrays_zip, or an error if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(F.raise_error(F.lit("lengths differ")))


def summarize(blocks: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by type (all types), missed blocks, total and the missed share in percent."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in BLOCK_TYPES]
    out = blocks.groupBy(*key).agg(*counts, F.count_if("miss").alias("n_miss"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("miss_percent", 100.0 * F.col("n_miss") / F.greatest(F.lit(1), F.col("n_total")))


def formula_targets(blocks: DataFrame) -> DataFrame:
    """Formula blocks with a picture, and the area of their box."""
    return blocks.where((F.col("type") == "formula") & non_empty(F.col("image_path")).isNotNull()).withColumn("bbox_area", area(F.col("bbox")))


def table_targets(blocks: DataFrame, min_side: int = 120) -> DataFrame:
    """Table blocks with a picture, ``large_enough`` if neither side is under ``min_side``."""
    b = F.col("bbox")
    sides = (b["x2"] - b["x1"] >= min_side) & (b["y2"] - b["y1"] >= min_side)
    return blocks.where((F.col("type") == "table") & F.col("image_path").isNotNull()).withColumn("large_enough", sides)


def reference_targets(blocks: DataFrame, labels: tuple[str, ...] = ("reference", "reference_content")) -> DataFrame:
    """Blocks with one of the labels and a text that isn't blank; ``citation`` is the stripped text."""
    return blocks.where(F.col("label").isin(*(labels or ("",)))).withColumn("citation", non_empty(strip(F.col("text")))).where("citation IS NOT NULL")
