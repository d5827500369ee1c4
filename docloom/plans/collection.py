"""From files to bundles: text layers, rendering, layout, extraction, JSON and pictures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import PipelineSettings
from docloom.functions.geometry import page_height
from docloom.functions.text import ink
from docloom.models import LayoutModel, OcrModel, detect
from docloom.operators import citations
from docloom.operators.assemble import json_text
from docloom.operators.detect import digital_born
from docloom.operators.routing import effective_dpi, split_by_language, split_scanned
from docloom.plans.document_pipeline import Extracted, extract
from docloom.sources.files import TextLayer, bundles, read_spans, render_pages, with_metadata
from docloom.storage import discard, stored


@dataclass
class Collected:
    """``bundles`` (doc_id, bundle), the tables of :class:`Extracted`, and ``names`` (doc_id, path, dpi)."""

    bundles: DataFrame
    extracted: Extracted
    names: DataFrame
    kept: list[DataFrame]

    def close(self, retain: bool = False) -> None:
        """Deletes all intermediate tables, unless ``retain``; never raises."""
        self.extracted.close(retain)
        if not retain:
            discard(*self.kept)
            self.kept.clear()


def collect_documents(
    files: DataFrame,
    make_reader: Callable[[], TextLayer],
    render: Callable[..., Iterator[tuple[int, int, bytes]]],
    make_layout: Callable[[], LayoutModel],
    settings: PipelineSettings | None = None,
    *,
    make_ocr: Callable[[], OcrModel] | None = None,
    formulas: Callable[[DataFrame], DataFrame] | None = None,
    tables: Callable[[DataFrame], DataFrame] | None = None,
    make_citation_client: Callable[[], citations.CitationClient] | None = None,
    read_info: Callable[[bytes], dict[str, str]] | None = None,
    prepare: Callable[[bytes], object] | None = None,
) -> Collected:
    """Bundles of ``files`` (path, filename, byte_size, content, and ``language``, en without it).

    Text layers tell scans from digital documents, which are rendered at their own resolutions; refused documents
    (language, scans where they are off) are not rendered.  Text layers, pictures and detections are stored once, in
    the shared folder, until :meth:`Collected.close`; :func:`extract` does the rest.
    """
    settings = settings or PipelineSettings()
    if "language" not in files.columns:
        files = files.withColumn("language", F.lit("en"))
    files = files.withColumn("doc_id", F.xxhash64("path"))
    layers = stored(read_spans(files, make_reader, "doc_id"), "layers")
    joined = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    born = digital_born(
        layers.select("doc_id", "page_idx", F.coalesce(ink(joined), F.lit(0)).alias("n_chars")),
        sample=settings.digital_born_sample_pages, ratio=settings.digital_born_text_ratio, min_chars=settings.digital_born_min_text_chars,
    )
    facts = with_metadata(files, read_info).select("doc_id", "path", "metadata", "language").join(born.select("doc_id", "digital_born"), "doc_id", "left")
    facts = facts.withColumn("digital_born", F.coalesce("digital_born", F.lit(False)))
    facts = stored(facts.withColumn("dpi", effective_dpi(F.col("digital_born"), settings.render_dpi, settings.render_dpi_digital_born)), "documents")
    wanted = split_by_language(split_scanned(facts, settings.scanned_enabled)[0])[0].select("doc_id", "dpi")
    rendered = stored(render_pages(files.select("doc_id", "content").join(wanted, "doc_id"), render, F.col("dpi"), key="doc_id", image_format=settings.page_format), "pages")
    found = stored(detect(rendered, make_layout, batch_size=settings.layout_batch_size, confidence=settings.layout_confidence, prepare=prepare), "layout")
    heights = layers.select("doc_id", "page_idx", page_height(F.col("media_box")).alias("height_pt"))
    pages = rendered.drop("image").join(wanted, "doc_id").join(heights, ["doc_id", "page_idx"], "left")
    spans = layers.select("doc_id", "page_idx", F.explode("spans").alias("s")).select("doc_id", "page_idx", "s.*")
    run = extract(
        facts.drop("path", "dpi"), pages, found.withColumnRenamed("reading_order", "order_seq"), settings,
        formulas=formulas, tables=tables, make_citation_client=make_citation_client, spans=spans, images=rendered.select("doc_id", "page_idx", "image"), make_ocr=make_ocr,
    )
    texts = run.documents.select("doc_id", json_text(F.col("document")).alias("json"))
    return Collected(bundles(texts, run.crops), run, facts.select("doc_id", "path", "dpi"), [layers, facts, rendered, found])
