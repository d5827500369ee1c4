"""Documents as one plan: detections, blocks, stages, assembly; what models and services say is stored once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import __version__
from docloom.config import PipelineSettings
from docloom.functions.geometry import holds_centre, pdf_region
from docloom.functions.text import joined_spans
from docloom.models import OcrModel, cut_crops, recognize_text
from docloom.operators import assemble, blocks, citations, routing, stages
from docloom.storage import discard, stored


@dataclass
class Extracted:
    """The pipeline's tables: ``blocks`` after all stages, the ``summary``, the nested ``documents``, and ``crops``
    (``doc_id, image_path, image``) where pictures of the pages were given."""

    blocks: DataFrame
    summary: DataFrame
    documents: DataFrame
    rejected: DataFrame
    crops: DataFrame | None = None
    kept: list[DataFrame] = field(default_factory=list)

    def close(self, retain: bool = False) -> None:
        """Deletes what the stages stored, once the tables have been written; never raises.  ``retain`` leaves it
        until the driver ends."""
        if not retain:
            discard(*self.kept)
            self.kept.clear()


def scanned_texts(boxes: DataFrame, images: DataFrame, make_ocr: Callable[[], OcrModel], settings: PipelineSettings, by: tuple[str, ...] = ("det_idx",)) -> DataFrame:
    """``doc_id, page_idx, *by, text``: what is read in each box of the pages' pictures; null where too little is
    read for :func:`stages.accepted_ocr`, or the box or its page has no picture."""
    crops = cut_crops(boxes, images, by=by)
    read = recognize_text(crops, make_ocr, batch_size=settings.ocr_batch_size)
    return read.select("doc_id", "page_idx", *by, stages.accepted_ocr(F.col("lines"), F.col("scores"), settings.ocr_min_score).alias("text"))


def text_in_boxes(boxes: DataFrame, spans: DataFrame, pages: DataFrame, by: tuple[str, ...] = ("det_idx",)) -> DataFrame:
    """``text`` of each box: the spans of its page whose centre lies in it, in order, joined by single blanks.

    An equi-join on the page carries the range predicate; spans have ``span_idx, text, x, y, w, h`` in points, pages
    ``dpi, height_pt``.  ``by`` tells the boxes of a page apart.
    """
    key = ["doc_id", "page_idx"]
    placed = boxes.join(pages.select(*key, "dpi", "height_pt"), key)
    placed = placed.withColumn("region", pdf_region(F.col("bbox"), F.col("dpi"), F.col("height_pt")))
    inside = placed.select(*key, *by, "region").join(spans.withColumnRenamed("text", "span_text"), key).where(holds_centre(F.col("region"), F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    texts = inside.groupBy(*key, *by).agg(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "span_text"))), lambda s: s["span_text"]).alias("texts"))
    return boxes.drop("text").join(texts.select(*key, *by, joined_spans(F.col("texts")).alias("text")), [*key, *by], "left")


def extract(
    documents: DataFrame,
    pages: DataFrame,
    detections: DataFrame,
    settings: PipelineSettings | None = None,
    *,
    formulas: Callable[[DataFrame], DataFrame] | None = None,
    tables: Callable[[DataFrame], DataFrame] | None = None,
    make_citation_client: Callable[[], citations.CitationClient] | None = None,
    spans: DataFrame | None = None,
    images: DataFrame | None = None,
    make_ocr: Callable[[], OcrModel] | None = None,
) -> Extracted:
    """Runs the stages that ``settings`` switches on.

    ``documents``: doc_id, metadata, language, digital_born.  ``pages``: doc_id, page_idx, width_px, height_px.
    ``detections``: doc_id, page_idx, det_idx, label, confidence, bbox, text and optionally order_seq.
    ``formulas`` gets batched targets and gives ``latex`` by block; ``tables`` gets targets and gives
    ``polygons, logic`` by block.  With ``spans`` (and ``dpi, height_pt`` of pages) cells get the text that lies in
    them, and so do detections that come without ``text``.  With ``images`` (doc_id, page_idx, image) targets carry the
    cut ``image``, and ``make_ocr`` reads the texts and cells of scanned documents in place of the text layer.
    Stages that are off add nothing to the plan.  A model's or service's answers are written to the shared
    folder before they are spliced in, so each target is asked about once, whatever is read from the result.
    """
    settings = settings or PipelineSettings()
    accepted, rejected = routing.split_scanned(documents, settings.scanned_enabled)
    supported, unsupported = routing.split_by_language(accepted)
    rejected = rejected.unionByName(unsupported)
    ids = supported.select("doc_id")
    kept = detections.where(F.col("confidence") > settings.layout_confidence).join(ids, "doc_id", "left_semi")
    ordered = blocks.with_reading_order(kept, "order_seq" if "order_seq" in detections.columns else None)
    held: list[DataFrame] = []

    def once(answers: DataFrame, name: str) -> DataFrame:
        held.append(stored(answers, name))
        return held[-1]

    def scans_of(rows: DataFrame) -> DataFrame:
        return rows.join(supported.where(~F.coalesce(F.col("digital_born"), F.lit(False))).select("doc_id"), "doc_id", "left_semi")

    def with_scans(rows: DataFrame, asked: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """``text`` of scanned documents from their pictures, of the others as it is."""
        if images is None or make_ocr is None:
            return rows
        read = once(scanned_texts(scans_of(asked), images, make_ocr, settings, by), "ocr").withColumnRenamed("text", "__read")
        digital = supported.select("doc_id", F.coalesce(F.col("digital_born"), F.lit(False)).alias("__digital"))
        joined = rows.join(read, ["doc_id", "page_idx", *by], "left").join(digital, "doc_id")
        return joined.withColumn("text", F.when(F.col("__digital"), F.col("text")).otherwise(F.col("__read"))).drop("__read", "__digital")

    def pictured(targets: DataFrame) -> DataFrame:
        return targets if images is None else targets.join(cut_crops(targets, images), [*key, "block_idx"], "left")

    key = ["doc_id", "page_idx"]
    if "text" not in ordered.columns:
        ordered = ordered.withColumn("text", F.lit(None).cast("string")) if spans is None else text_in_boxes(ordered, spans, pages)
    ordered = routing.routed(ordered)
    ordered = with_scans(ordered, ordered.where(F.col("route").isin(*routing.TEXT_ROUTES)), ("det_idx",))
    built = blocks.build_blocks(blocks.with_block_idx(ordered), tuple(sorted(settings.bundle_miss_images_for)), settings.crop_format)
    built = built.withColumns({"cells": F.lit(None).cast(assemble.BLOCK["cells"].dataType), "reference": F.lit(None).cast(assemble.BLOCK["reference"].dataType), "n_rows": F.lit(None).cast("int"), "n_cols": F.lit(None).cast("int")})
    placed = [*key, "block_idx"]

    if settings.table_enabled and tables is not None:
        targets = blocks.table_targets(built, settings.table_min_side_px).where("large_enough")
        found = once(tables(pictured(targets)).drop("image"), "tables")
        sized = found.join(pages.select("doc_id", "page_idx", "width_px", "height_px"), ["doc_id", "page_idx"])
        cells = stages.table_cells(sized)
        bounds = ["row_start", "row_end", "col_start", "col_end"]
        cells = cells.select(*placed, "cell_idx", *bounds, F.col("cell_bbox").alias("bbox"))
        cells = text_in_boxes(cells, spans, pages, ("block_idx", "cell_idx")) if spans is not None else cells.withColumn("text", F.lit(None).cast("string"))
        cells = with_scans(cells, cells, ("block_idx", "cell_idx"))
        lists = assemble.nest_cells(found.select(*placed), cells).withColumn("cells", stages.structured(F.col("cells"))).where("cells IS NOT NULL")
        shape = stages.table_shape(F.col("cells"))
        built = blocks.spliced(built, lists.withColumns({"n_rows": shape["n_rows"], "n_cols": shape["n_cols"]}), ["cells", "n_rows", "n_cols"])

    if settings.formula_enabled and formulas is not None:
        buckets = stages.checked_buckets(
            settings.formula_bucket_small_threshold, settings.formula_bucket_medium_threshold, settings.formula_bucket_small_tokens, settings.formula_bucket_medium_tokens, settings.formula_max_new_tokens
        )
        buckets = buckets if settings.formula_bucketed else buckets[-1:]
        targets = stages.batched(stages.bucketed(blocks.formula_targets(built), buckets), settings.formula_batch_size)
        answers = once(formulas(pictured(targets)).select(*placed, "latex"), "formulas")
        done = stages.finished_formulas(targets.drop("latex").join(answers, placed, "left"), tuple(settings.bundle_miss_images_for))
        built = blocks.spliced(built, done, ["text", "miss", "image_path"])

    if settings.references_enabled and make_citation_client is not None:
        found = once(citations.references(blocks.reference_targets(built, settings.reference_labels), make_citation_client), "references")
        built = blocks.spliced(built, found, ["reference"])

    page_rows = assemble.nest_pages(pages.join(ids, "doc_id", "left_semi"), built)
    crops = None
    if images is not None:
        shown = built.where("image_path IS NOT NULL")
        cut = cut_crops(shown, images, image_format=settings.crop_format, jpeg_quality=settings.jpeg_quality)
        crops = shown.select(*placed, "image_path").join(cut, placed).select("doc_id", "image_path", "image").where("image IS NOT NULL")
    return Extracted(built, blocks.summarize(built), assemble.nest_documents(supported, page_rows, __version__), rejected, crops, held)
