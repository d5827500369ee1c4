"""Fixed schemas of the document model, and the vocabularies that go with them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of blocks (fixed values).
BLOCK_TYPES = ("text", "image", "reference", "formula", "table")

_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def struct(fields: str) -> T.StructType:
    """From "name type, ..." of simple types; needs no session, so workers can import this module."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in fields.split(","))])


BBOX = struct("x1 double, y1 double, x2 double, y2 double")
CELL = T.StructType(
    [*struct("row_start int, row_end int, col_start int, col_end int"), T.StructField("bbox", BBOX), T.StructField("text", T.StringType())]
)
AUTHOR = struct("name string, surname string, forename string")
REFERENCE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(AUTHOR, False)),
        *[T.StructField(c, T.StringType()) for c in ("year", "venue", "volume", "issue", "pages", "publisher", "doi", "url", "pmid", "arxiv")],
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("reading_order", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("miss", T.BooleanType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("n_cols", T.IntegerType()),
        T.StructField("cells", T.ArrayType(CELL)),
        T.StructField("reference", REFERENCE),
    ]
)
PAGE = T.StructType([*struct("page_no int, width_px int, height_px int"), T.StructField("blocks", T.ArrayType(BLOCK))])
METADATA = T.StructType([*struct("filename string, sha256 string, byte_size bigint"), T.StructField("pdf_info", T.MapType(T.StringType(), T.StringType()))])
DOCUMENT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("language", T.StringType()),
        T.StructField("digital_born", T.BooleanType()),
        T.StructField("pipeline_version", T.StringType()),
        T.StructField("pages", T.ArrayType(PAGE)),
    ]
)
DETECTION = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("label_id", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", BBOX), T.StructField("reading_order", T.IntegerType())]
)
