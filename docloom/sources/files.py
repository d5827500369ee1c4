"""Document files: binary scans, metadata, bundles and sweep results."""

from __future__ import annotations

import inspect
import io
import json
import logging
import os
import tarfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import clean_metadata_map
from docloom.workers import logged, on_workers

# Names of the stages and of the quality counts in a sweep's columns.
_STAGES = ("render", "layout", "blocks", "table", "formula", "reference", "bundle")
_QUALITY = (
    "blocks_total", "blocks_text", "blocks_image", "blocks_reference", "blocks_formula", "blocks_table", "text_chars", "miss", "formulas_with_text",
    "formulas_with_image", "formula_latex_chars", "tables_with_cells", "tables_image_only", "total_cells", "cells_with_text", "references_parsed", "references_total",
)
#: Columns of a sweep's results; ``value`` mixes numbers, truth values and names.
SWEEP_SCHEMA = ", ".join(
    [
        "benchmark string, value string, pdf string, language string, status string, wall_s double",
        *[f"stage_{s}_s double" for s in _STAGES],
        *[f"{r}_{q} double" for r in ("cpu_pct", "rss_mb", "vram_mb") for q in ("min", "med", "p95", "max")],
        *[f"quality_{q} bigint" for q in _QUALITY],
        "error string",
    ]
)


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, filename, byte_size, content`` of each file; a missing path is an error of the reader, which passes over
    files of no bytes (:func:`with_missing` tells them)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("byte_size"), "content")


def with_missing(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted ``filename``s that were found, with the file's columns, and the others with a reason."""
    found = wanted.join(files, "filename")
    return found, wanted.join(files.select("filename"), "filename", "left_anti").withColumn("reason", F.lit("file not found"))


def with_metadata(files: DataFrame, read_info: Callable[[bytes], dict[str, str]] | None = None) -> DataFrame:
    """``metadata`` of each file.  ``read_info`` gives a PDF's information; where it raises, there is none."""
    info = F.create_map().cast("map<string,string>")
    if read_info is not None:
        on_workers(files.sparkSession)

        def read(contents: pd.Series) -> pd.Series:
            def one(content: bytes) -> dict[str, str]:
                try:
                    return {str(k): str(v) for k, v in read_info(content).items()}
                except Exception:
                    return {}

            return contents.map(one)

        info = clean_metadata_map(F.pandas_udf(read, T.MapType(T.StringType(), T.StringType()))("content"))
    metadata = F.struct("filename", F.sha2("content", 256).alias("sha256"), "byte_size", info.alias("pdf_info"))
    return files.withColumn("metadata", metadata)


class TextLayer(Protocol):
    """A reader of text layers; boxes are in points from the lower left corner."""

    def open(self, content: bytes) -> Any: ...

    def pages(self, document: Any) -> int: ...

    def spans(self, document: Any, page: int) -> tuple[list[float], list[tuple[str, float, float, float, float]]]:
        """The page's media box [x0, y0, x1, y1] and its spans (text, x, y, w, h) in order."""
        ...


_SPANS = pa.list_(pa.struct([("span_idx", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64()), ("h", pa.float64())]))


def read_spans(files: DataFrame, make_reader: Callable[[], TextLayer], key: str = "path") -> DataFrame:
    """One row a page: ``key, page_idx, media_box, spans``, from files with ``content``.

    A file that can't be opened has no pages; a page that can't be read has null instead of spans, is logged, and
    the others go on.  Pages follow one another in small batches, whatever a file's length.
    """
    on_workers(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, log = make_reader(), logging.getLogger("docloom")
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    document = reader.open(content.as_py())
                    n = reader.pages(document)
                except Exception:
                    log.warning("%s has no readable text layer", name.as_py(), exc_info=True)
                    continue
                for i in range(n):
                    try:
                        box, found = reader.spans(document, i)
                        spans = [dict(zip(("span_idx", "text", "x", "y", "w", "h"), (k, *x), strict=True)) for k, x in enumerate(found)]
                    except Exception:
                        log.warning("page %d of %s can't be read", i, name.as_py(), exc_info=True)
                        box, spans = None, None
                    columns = [pa.array([name.as_py()], batch.column(0).type), pa.array([i], pa.int32()), pa.array([box], pa.list_(pa.float64())), pa.array([spans], _SPANS)]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "page_idx", "media_box", "spans"])

    rows = files.select(key, "content")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, page_idx int, media_box array<double>, spans array<struct<span_idx:int,text:string,x:double,y:double,w:double,h:double>>")


def render_pages(files: DataFrame, render: Callable[..., Iterator[tuple[int, int, bytes]]], dpi: int | Column = 300, *, key: str = "path", image_format: str = "png") -> DataFrame:
    """One row a page: ``key, page_idx, width_px, height_px, image``.

    ``render(content, dpi)``, or ``render(content, dpi, image_format)``, yields (width, height, bytes) by page; ``dpi``
    may be a column.  An error of a file is logged and fails the task.  A page's picture is sent on at once.
    """
    if image_format not in ("jpeg", "png"):
        raise ValueError(f"unknown image format {image_format!r}")
    on_workers(files.sparkSession)
    more = (image_format,) if len(inspect.signature(render).parameters) > 2 else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, at in zip(*(batch.column(i) for i in range(3)), strict=True):
                with logged(f"rendering of {name.as_py()}"):
                    for i, (width, height, image) in enumerate(render(content.as_py(), at.as_py(), *more)):
                        columns = [pa.array([name.as_py()], batch.column(0).type), *(pa.array([x], pa.int32()) for x in (i, width, height)), pa.array([image], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=[key, "page_idx", "width_px", "height_px", "image"])

    rows = files.select(key, "content", (dpi if isinstance(dpi, Column) else F.lit(dpi)).cast("int").alias("dpi"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, page_idx int, width_px int, height_px int, image binary")


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SWEEP_SCHEMA).option("header", True).csv(path)


def bundle_bytes(document_json: str, images: list[tuple[str, bytes]]) -> bytes:
    """An uncompressed tar: document.json first, then the images by name."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, content in [("document.json", document_json.encode()), *sorted(images)]:
            entry = tarfile.TarInfo(name)
            entry.size = len(content)
            tar.addfile(entry, io.BytesIO(content))
    return out.getvalue()


def bundles(documents: DataFrame, crops: DataFrame) -> DataFrame:
    """``doc_id, bundle`` from ``doc_id, json`` and ``doc_id, image_path, image``; a document's pictures are
    gathered for its own bundle alone."""
    on_workers(documents.sparkSession)
    lists = crops.groupBy("doc_id").agg(F.collect_list(F.struct("image_path", "image")).alias("images"))
    joined = documents.select("doc_id", "json").join(lists, "doc_id", "left")

    @F.pandas_udf("binary")
    def pack(texts: pd.Series, images: pd.Series) -> pd.Series:
        def rows(found) -> list[tuple[str, bytes]]:
            return [] if found is None else [(x["image_path"], bytes(x["image"])) for x in found]

        return pd.Series([bundle_bytes(t, rows(i)) for t, i in zip(texts, images, strict=True)])

    return joined.select("doc_id", pack("json", "images").alias("bundle"))


def write_bundles(bundled: DataFrame, folder: str) -> None:
    """``<folder>/<doc_id>.tar`` for each row.  Every executor must see the folder as a file path; a file appears
    whole or not at all, and a task that runs again replaces it."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = f"{folder}/{row['doc_id']}.tar"
            with open(f"{target}.{uuid.uuid4().hex}", "wb") as f:
                f.write(row["bundle"])
            os.replace(f.name, target)

    bundled.select("doc_id", "bundle").foreachPartition(write)


def read_bundle_json(bundled: DataFrame) -> DataFrame:
    """``json`` and ``bundle_bytes, bundle_files`` of each bundle; null for what is no tar with a document."""

    on_workers(bundled.sparkSession)

    @F.pandas_udf("struct<json:string,bundle_bytes:bigint,bundle_files:int>")
    def unpack(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            try:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    text = tar.extractfile("document.json").read().decode()
                    json.loads(text)
                    out.append((text, len(content), len(tar.getnames())))
            except Exception:
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["json", "bundle_bytes", "bundle_files"])

    return bundled.withColumn("read", unpack("bundle")).select("doc_id", "read.*")
