"""Boxes as column expressions: pixels (origin top left) and PDF points (origin bottom left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(x1, y1, x2, y2) -> Column:
    """struct<x1,y1,x2,y2> of doubles."""
    named = zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for n, c in named])


def pdf_region(box: Column, dpi: Column, page_height: Column) -> Column:
    """The box in points from the lower left corner, as struct<x,y,w,h>."""
    k = F.lit(72.0) / dpi
    return F.struct(
        (box["x1"] * k).alias("x"), (page_height - box["y2"] * k).alias("y"), ((box["x2"] - box["x1"]) * k).alias("w"), ((box["y2"] - box["y1"]) * k).alias("h")
    )


def page_height(media_box: Column) -> Column:
    """Upper less lower edge of a media box [x0, y0, x1, y1]."""
    return F.get(media_box, 3) - F.get(media_box, 1)


def clamped(box: Column, width: Column, height: Column) -> Column:
    """The box cut to 0..width and 0..height."""

    def inside(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(most.cast("double"), v))

    return bbox(inside(box["x1"], width), inside(box["y1"], height), inside(box["x2"], width), inside(box["y2"], height))


def crop_window(box: Column, width: Column, height: Column) -> Column:
    """The whole pixels to cut out, rounded half to even and cut to the page; null if the box is inverted
    or nothing of it is on the page."""

    def pixel(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(most.cast("int"), F.bround(v, 0).cast("int")))

    window = F.struct(pixel(box["x1"], width).alias("x1"), pixel(box["y1"], height).alias("y1"), pixel(box["x2"], width).alias("x2"), pixel(box["y2"], height).alias("y2"))
    upright = (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])
    return F.when(upright & (window["x2"] > window["x1"]) & (window["y2"] > window["y1"]), window)


def crop_window_strict(box: Column, width: Column, height: Column) -> Column:
    """:func:`crop_window`, or an error where it is null."""
    window = crop_window(box, width, height)
    return F.when(window.isNotNull(), window).otherwise(F.raise_error(F.lit("the box is empty or not on the page")).cast("struct<x1:int,y1:int,x2:int,y2:int>"))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), (box["x2"] - box["x1"]) * (box["y2"] - box["y1"]))


def rounded(box: Column) -> Column:
    """To two decimals, half to even, as in the JSON form."""
    return bbox(*[F.bround(box[c], 2) for c in ("x1", "y1", "x2", "y2")])


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """The box around a flat list x, y, x, y, ..., cut to width and height."""
    xs, ys = F.filter(points, lambda v, i: i % 2 == 0), F.filter(points, lambda v, i: i % 2 == 1)
    return clamped(bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), width, height)


def moved(box: Column, dx: Column, dy: Column) -> Column:
    return bbox(box["x1"] + dx, box["y1"] + dy, box["x2"] + dx, box["y2"] + dy)


def holds_centre(region: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether the centre of the box x, y, w, h lies in the region (struct<x,y,w,h>), edges included."""
    cx, cy = x + w / 2, y + h / 2
    return cx.between(region["x"], region["x"] + region["w"]) & cy.between(region["y"], region["y"] + region["h"])
