"""Text as column expressions, with Python's idea of white space and of truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.schema import BLOCK_TYPES

#: Unicode white space and the four separators U+001C to U+001F.
_SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    # a run of blanks that ends in the middle is passed over once: it can't be entered behind its first blank
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}+", ""), rf"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$", "")


def non_empty(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none around it; null if nothing is left."""
    return non_empty(strip(F.regexp_replace(text, f"{_SPACE}+", " ")))


def joined_spans(texts: Column) -> Column:
    return squeezed(F.array_join(texts, " "))


def ink(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.coalesce(F.length(F.regexp_replace(text, _SPACE, "")), F.lit(0)).cast("long")


def with_miss_mark(path: Column) -> Column:
    """``a-b-id.png`` -> ``a-b-MISS-id.png``; marked names stay as they are."""
    return F.when(path.contains("-MISS-"), path).otherwise(F.regexp_replace(path, r"-([^-]*)(\.[^.]*)$", "-MISS-$1$2"))


def crop_name(page_no: Column, label: Column, miss: Column, key: Column, extension: str) -> Column:
    """``images/0003-table-MISS-<32 hex>.png``; the id is a digest of ``key``, the same at each run."""
    digest = F.substring(F.sha2(key.cast("string"), 256), 1, 32)
    return F.format_string(f"images/%04d-%s-%s%s.{extension}", page_no, label, F.when(miss, F.lit("MISS-")).otherwise(""), digest)


def page_name(page_idx: Column, image_format: str) -> Column:
    """Name of a rendered page, counted from 0."""
    if image_format not in ("jpeg", "png"):
        raise ValueError(f"unknown image format {image_format!r}")
    return F.format_string(f"page-%04d.{'jpg' if image_format == 'jpeg' else 'png'}", page_idx)


def safe_file_name(text: Column) -> Column:
    """At most 64 characters, '/', ':' and blanks as '_'."""
    return F.left(F.translate(text, "/: ", "___"), F.lit(64))


def clean_metadata(value: Column) -> Column:
    """A metadata string without NULs and byte order marks; UTF-16 read as Latin-1 is decoded."""
    raw = F.encode(value, "ISO-8859-1")
    rest = F.substring(raw, 3, 1 << 30)
    decoded = (
        F.when(value.startswith("þÿ"), F.decode(rest, "UTF-16BE")).when(value.startswith("ÿþ"), F.decode(rest, "UTF-16LE")).otherwise(value)
    )
    return F.translate(decoded, "\u0000﻿", "")


def clean_metadata_list(values: Column) -> Column:
    """The cleaned values that aren't empty, joined by '; '."""
    return F.array_join(F.filter(F.transform(values, clean_metadata), lambda x: x != ""), "; ")


def clean_metadata_map(values: Column) -> Column:
    """Cleans each value of a map and drops the empty ones."""
    return F.map_filter(F.transform_values(values, lambda _, v: clean_metadata(v)), lambda _, v: F.coalesce(v, F.lit("")) != "")


def shown_label(value: Column) -> Column:
    """The last part of a path without the endings of models and files."""
    short = F.element_at(F.split(value, "/"), -1)
    for ending in ("_safetensors", ".pdf", ".onnx"):
        short = F.when(short.endswith(ending), F.left(short, F.length(short) - len(ending))).otherwise(short)
    return short


def shown_number(value: Column) -> Column:
    """12,345 as 12.3k, 2,500,000 as 2.5M."""
    return (
        F.when(F.abs(value) >= 1_000_000, F.format_string("%.1fM", value / 1_000_000))
        .when(F.abs(value) >= 1_000, F.format_string("%.1fk", value / 1_000))
        .otherwise(F.format_string("%.0f", value))
    )


def parsed_bool(text: Column) -> Column:
    """Blanks around a word make it another one, which is false."""
    return F.lower(text).isin("1", "true", "yes", "on")


def parsed_list(text: Column) -> Column:
    """The parts between commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def parsed_block_types(text: Column) -> Column:
    """The distinct parts between commas, stripped and lower-cased; an unknown type is an error."""
    names = F.array_distinct(F.transform(parsed_list(text), F.lower))
    unknown = F.array_except(names, F.array(*map(F.lit, BLOCK_TYPES)))
    said = F.concat(F.lit("unknown block types: "), F.array_join(F.array_sort(unknown), ", "))
    return F.when(F.size(unknown) == 0, names).otherwise(F.raise_error(said).cast("array<string>"))
