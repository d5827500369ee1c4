"""Rows to nested documents and back, and the JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.json_text import indented
from docloom.schema import BLOCK, CELL, DOCUMENT

_BLOCK_FIELDS = [f.name for f in BLOCK]


def _gathered(order: str, fields: list[str]) -> Column:
    """The rows' ``fields`` as structs in the order of ``order``; rows without it are none."""
    rows = F.array_sort(F.collect_list(F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("__at"), F.struct(*fields).alias("__row")))))
    return F.transform(rows, lambda x: x["__row"])


def nest_cells(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` of each block, null for blocks without any."""
    key = ["doc_id", "page_idx", "block_idx"]
    lists = cells.groupBy(*key).agg(_gathered("cell_idx", [f.name for f in CELL]).alias("cells"))
    return blocks.drop("cells").join(lists, key, "left")


def nest_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, page`` with the page's blocks in order; pages without blocks stay."""
    key = ["doc_id", "page_idx"]
    have = [c for c in _BLOCK_FIELDS if c in blocks.columns]
    full = blocks.select(*key, "block_idx", *have, *[F.lit(None).cast(BLOCK[c].dataType).alias(c) for c in _BLOCK_FIELDS if c not in have])
    lists = full.groupBy(*key).agg(_gathered("block_idx", _BLOCK_FIELDS).alias("blocks"))
    page = F.struct(
        (F.col("page_idx") + 1).cast("int").alias("page_no"), "width_px", "height_px", F.coalesce("blocks", F.array().cast(lists.schema["blocks"].dataType)).alias("blocks")
    )
    return pages.join(lists, key, "left").select(*key, page.alias("page"))


def nest_documents(documents: DataFrame, pages: DataFrame, version: str) -> DataFrame:
    """``doc_id, document``; documents without pages have an empty list."""
    lists = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "page"))), lambda x: x["page"]).alias("pages"))
    joined = documents.join(lists, "doc_id", "left")
    none = F.array().cast(lists.schema["pages"].dataType)
    document = F.struct("metadata", "language", "digital_born", F.lit(version).alias("pipeline_version"), F.coalesce("pages", none).alias("pages"))
    return joined.select("doc_id", document.alias("document"))


def blocks_of(documents: DataFrame) -> DataFrame:
    """One row a block of nested documents."""
    pages = documents.select("doc_id", F.posexplode("document.pages").alias("page_idx", "page"))
    return pages.select("doc_id", "page_idx", F.posexplode("page.blocks").alias("block_idx", "block")).select("doc_id", "page_idx", "block_idx", "block.*")


def cells_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page_idx", "block_idx", F.posexplode("cells").alias("cell_idx", "cell")).select("doc_id", "page_idx", "block_idx", "cell_idx", "cell.*")


def json_text(document: Column) -> Column:
    """The document as JSON: nulls kept, boxes as lists rounded to two decimals, two blanks of indentation."""
    return indented(document, DOCUMENT)
