"""Where each detected label goes, and which script a language is written in."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels by route.
TEXT_LABELS = ("abstract", "aside_text", "content", "doc_title", "figure_title", "footnote", "formula_number", "paragraph_title", "text", "vertical_text", "vision_footnote")
IMAGE_LABELS = ("algorithm", "chart", "image")
TABLE_LABELS = ("table",)
FORMULA_LABELS = ("display_formula", "formula", "inline_formula")
REFERENCE_LABELS = ("reference", "reference_content")
IGNORE_LABELS = ("footer", "footer_image", "header", "header_image", "number", "seal")
ROUTES = {"text": TEXT_LABELS, "image": IMAGE_LABELS, "table": TABLE_LABELS, "formula": FORMULA_LABELS, "reference": REFERENCE_LABELS, "ignore": IGNORE_LABELS}
#: Routes whose blocks are cut out as pictures, and routes whose blocks get text.
CROP_ONLY_ROUTES = ("image", "formula", "table")
TEXT_ROUTES = ("text", "reference")

# Languages by script family.
SCRIPTS = {
    "latin": ("tr", "de", "fr", "es", "it", "pl", "ku", "az", "cs", "ro", "nl", "sl", "bs", "zza", "ms", "id", "uz", "hu", "pt", "sq", "lv", "no"),
    "en": ("en",),
    "arabic": ("ar", "fa"),
    "cyrillic": ("ru", "bg", "mk", "ady", "ky", "kk", "uk", "mn", "sr"),
    "ch": ("zh",),
    "japan": ("ja",),
    "el": ("el",),
    "korean": ("ko",),
    "th": ("th",),
    "devanagari": ("hi",),
}


def _lookup(groups: dict[str, tuple[str, ...]], key: Column) -> Column:
    pairs = chain.from_iterable((F.lit(member), F.lit(name)) for name, members in groups.items() for member in members)
    return F.try_element_at(F.create_map(*pairs), key)


def known_route(label: Column) -> Column:
    """The label's route, null if the label isn't listed."""
    return _lookup(ROUTES, label)


def route(label: Column) -> Column:
    """The label's route; unlisted and null labels are images."""
    return F.coalesce(known_route(label), F.lit("image"))


def block_type(route_: Column) -> Column:
    """A block's type is its route; ignored detections have none."""
    return F.when(route_ != "ignore", route_)


def script(language: Column) -> Column:
    """The script family, null for a language that isn't supported."""
    return _lookup(SCRIPTS, language)


def unknown_labels(detections: DataFrame) -> DataFrame:
    """Each label that isn't listed, once, with its number of detections."""
    return detections.where(F.col("label").isNotNull() & known_route(F.col("label")).isNull()).groupBy("label").agg(F.count(F.lit(1)).alias("detections"))


def routed(detections: DataFrame) -> DataFrame:
    """Adds ``route``."""
    return detections.withColumn("route", route(F.col("label")))


def admitted(detections: DataFrame, confidence: float) -> DataFrame:
    """Detections above the threshold (an equal confidence isn't enough) that aren't ignored."""
    return routed(detections.where(F.col("confidence") > confidence)).where("route <> 'ignore'")


def split_by_language(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents in a supported language, and the others with a reason."""
    supported = script(F.col("language")).isNotNull()
    return documents.where(supported), documents.where(~supported | F.col("language").isNull()).withColumn("reason", F.lit("language not supported"))


def split_scanned(documents: DataFrame, scanned_enabled: bool) -> tuple[DataFrame, DataFrame]:
    """Accepted documents, and scanned ones with a reason where scans are switched off."""
    refused = F.lit(not scanned_enabled) & ~F.coalesce(F.col("digital_born"), F.lit(False))
    return documents.where(~refused), documents.where(refused).withColumn("reason", F.lit("scanned documents are switched off"))


def effective_dpi(digital_born: Column, dpi: int, dpi_digital_born: int) -> Column:
    return F.when(digital_born, dpi_digital_born).otherwise(dpi)
