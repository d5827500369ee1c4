"""Models as plug-ins: what they give, how they run on executors, and deterministic stand-ins.

A factory makes a model once in each Python worker and is called there; models never travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import PipelineSettings
from docloom.functions import pictures
from docloom.schema import DETECTION
from docloom.workers import ahead, logged, on_workers


@runtime_checkable
class LayoutModel(Protocol):
    """Detections (dicts of the detection schema) for each picture; equal lengths."""

    def analyze(self, images: list[bytes], confidence: float) -> list[list[dict]]: ...

    def close(self) -> None: ...


class OcrModel(Protocol):
    """(lines, scores) for each crop."""

    def read(self, crops: list[bytes]) -> list[tuple[list[str], list[float]]]: ...


class FormulaModel(Protocol):
    """(LaTeX or None, tokens) for each crop, at most ``max_tokens`` tokens."""

    def recognize(self, crops: list[bytes], max_tokens: int) -> list[tuple[str | None, int]]: ...


class TableModel(Protocol):
    """(polygons, logic) for each crop."""

    def structure(self, crops: list[bytes]) -> list[tuple[list[list[float]], list[list[int]]]]: ...


_made: dict[bytes, object] = {}


def resident(factory: Callable[[], object]) -> object:
    """The worker's model of this factory, made at first use."""
    key = cloudpickle.dumps(factory)  # lambdas and partials too are told apart, by what they hold
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def layout_factory(settings: PipelineSettings, make: Callable[..., LayoutModel]) -> Callable[[], LayoutModel]:
    """``make(device=, fp16=, fast_preproc=)`` bound to the settings, for :func:`detect`."""
    return partial(make, device=settings.layout_device, fp16=settings.layout_fp16, fast_preproc=settings.layout_fast_preproc)


def formula_factory(settings: PipelineSettings, make: Callable[..., FormulaModel]) -> Callable[[], FormulaModel]:
    """``make(model_id=, device=, dtype=, compiled=)`` bound to the settings."""
    return partial(make, model_id=settings.formula_model_id, device=settings.formula_device, dtype=settings.formula_dtype, compiled=settings.formula_torch_compile)


def formula_results(answer: str | list[str], n_tokens: int, n_crops: int) -> list[tuple[str | None, int]]:
    """What a generator says of a batch, as :class:`FormulaModel` gives it: one text for each crop, a lone text
    counts as a list of one, an empty text as none.  All rows of a batch stop together, so all have its tokens."""
    texts = [answer] if isinstance(answer, str) else list(answer)
    if len(texts) != n_crops:
        raise ValueError(f"{len(texts)} texts for {n_crops} crops")
    return [(x or None, n_tokens) for x in texts]


def detect(
    pages: DataFrame, factory: Callable[[], LayoutModel], *, batch_size: int = 8, confidence: float = 0.5, prepare: Callable[[bytes], object] | None = None
) -> DataFrame:
    """``doc_id, page_idx, det_idx`` and the detection's fields from pages with ``image``.

    ``prepare`` (such as :func:`prepared`) makes the model's input from a picture; a thread does it for the next
    batches while the model works on one.
    """

    on_workers(pages.sparkSession)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list]]:
        for rows in batches:
            for at in range(0, len(rows), batch_size):
                part = rows.iloc[at : at + batch_size]
                yield part, [prepare(x) if prepare else x for x in part["image"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = resident(factory)
        with logged("layout"):
            for part, images in ahead(parts(batches)) if prepare else parts(batches):
                found = model.analyze(images, confidence)
                if len(found) != len(part):
                    raise ValueError("a layout model gave another number of results than pages")
                out = [
                    {"doc_id": d, "page_idx": p, "det_idx": i, **x} for d, p, xs in zip(part["doc_id"], part["page_idx"], found, strict=True) for i, x in enumerate(xs)
                ]
                if out:
                    yield pd.DataFrame(out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DETECTION)
    return pages.select("doc_id", "page_idx", "image").mapInPandas(run, f"doc_id long, page_idx int, det_idx int, {fields}")


def recognize_formulas(targets: DataFrame, factory: Callable[[], FormulaModel]) -> DataFrame:
    """``latex, n_tokens`` of targets with ``image, bucket_no, batch_no, max_tokens``, a batch at a time.

    A missing picture is a miss for its row; a model that raises, for its batch; the others go on.
    """
    on_workers(targets.sparkSession)
    group = ["doc_id", "bucket_no", "batch_no"]
    kept = [f for f in targets.schema if f.name != "image"]
    names, made = [f.name for f in kept], []

    def answers(images: list[bytes | None], max_tokens: int) -> list[tuple[str | None, int]]:
        readable = [x for x in images if x is not None]
        try:
            if readable and not made:
                made.append(resident(factory))
            found = iter(made[0].recognize(readable, max_tokens) if readable else [])
            return [next(found) if x is not None else (None, 0) for x in images]
        except Exception:  # the model's, or too few answers
            return [(None, 0)] * len(images)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a group that may go on
        for batch in chain(batches, [None]):
            rows = pa.Table.from_batches(held + ([batch] if batch is not None else [])) if held or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            keys = list(zip(*(rows.column(c).to_pylist() for c in group), strict=True))
            starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
            last = rows.num_rows if batch is None else starts[-1]
            images, caps = rows.column("image"), rows.column("max_tokens").to_pylist()
            out: list[tuple[str | None, int]] = []
            for first, end in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                if first < last:
                    out += answers([x.as_py() for x in images[first:end]], max(caps[first:end]))
            done, held = rows.slice(0, last), rows.slice(last).to_batches()
            columns = [done.column(c).combine_chunks() for c in names]
            columns += [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())]
            yield from pa.Table.from_arrays(columns, names=[*names, "latex", "n_tokens"]).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", latex string, n_tokens bigint"
    # a document's batches lie side by side in one task, and a group that an Arrow batch cuts goes on in the next
    return targets.repartition("doc_id").sortWithinPartitions(*group, "place").mapInArrow(run, schema)


def recognize_text(crops: DataFrame, factory: Callable[[], OcrModel], *, batch_size: int = 64) -> DataFrame:
    """Adds ``lines, scores`` to crops with ``image``; a missing picture has none."""
    on_workers(crops.sparkSession)

    @F.pandas_udf("struct<lines:array<string>,scores:array<double>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = resident(factory)
        for images in batches:
            out: list[tuple[list[str], list[float]]] = []
            for at in range(0, len(images), batch_size):
                part = images.iloc[at : at + batch_size]
                found = iter(model.read([x for x in part if x is not None]))
                out += [next(found) if x is not None else ([], []) for x in part]
            yield pd.DataFrame(out, columns=["lines", "scores"])

    return crops.withColumn("__ocr", read("image")).withColumns({"lines": F.col("__ocr.lines"), "scores": F.col("__ocr.scores")}).drop("__ocr")


def structure_tables(targets: DataFrame, factory: Callable[[], TableModel], *, batch_size: int = 8) -> DataFrame:
    """Adds ``polygons, logic`` to targets with ``image``; null for a missing picture and for a batch in which the model raises."""
    on_workers(targets.sparkSession)

    @F.pandas_udf("struct<polygons:array<array<double>>,logic:array<array<int>>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = resident(factory)
        for images in batches:
            out: list[tuple] = []
            for at in range(0, len(images), batch_size):
                part = list(images.iloc[at : at + batch_size])
                try:
                    found = iter(model.structure([x for x in part if x is not None]))
                    out += [next(found) if x is not None else (None, None) for x in part]
                except Exception:
                    out += [(None, None)] * len(part)
            yield pd.DataFrame(out, columns=["polygons", "logic"])

    return targets.withColumn("__t", find("image")).withColumns({"polygons": F.col("__t.polygons"), "logic": F.col("__t.logic")}).drop("__t")


def prepared(content: bytes) -> tuple[tuple[int, int], np.ndarray]:
    """(height, width) of a picture and its :func:`pictures.planes`."""
    picture = pictures.decode(content)
    return picture.shape[:2], pictures.planes(picture)


#: Most boxes of a page that are cut from one copy of its picture.
_BOXES = 256


def cut_crops(
    boxes: DataFrame, images: DataFrame, *, by: tuple[str, ...] = ("block_idx",), image_format: str = "png", jpeg_quality: int = 95, read: Callable[[bytes], np.ndarray] = pictures.decode
) -> DataFrame:
    """``doc_id, page_idx, *by, image``: each ``bbox`` cut out of its page's picture and encoded.

    ``images`` has ``doc_id, page_idx, image``; ``by`` are whole numbers that tell a page's boxes apart.  A box that is
    empty or not on the page, and one whose page is missing or unreadable, has a null picture.  Boxes travel to the
    pictures in lists of at most 256, so that a picture is sent and decoded once for them.
    """
    if image_format not in ("jpeg", "png"):
        raise ValueError(f"unknown image format {image_format!r}")
    on_workers(boxes.sparkSession)
    key = ["doc_id", "page_idx"]
    rows = boxes.select(*key, *by, "bbox")
    some = [F.col(c).alias(f"__{c}") for c in by[:-1]] + [F.floor(F.col(by[-1]) / _BOXES).alias("__block")]
    lists = rows.groupBy(*key, *some).agg(F.collect_list(F.struct(*by, "bbox")).alias("boxes")).select(*key, "boxes")
    fields = [rows.schema[c] for c in (*key, *by)]
    names = [*key, *by, "image"]

    def crop(picture: np.ndarray | None, box: dict | None) -> bytes | None:
        corners = [box[c] for c in ("x1", "y1", "x2", "y2")] if box else [None]
        if picture is None or None in corners:
            return None
        try:
            part = pictures.cut(picture, corners)
        except ValueError:  # nothing is in the box
            return None
        return pictures.encode(part, image_format, jpeg_quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in key] + [batch.schema.field("boxes").type.value_type.field(c).type for c in by] + [pa.binary()]
            for i in range(batch.num_rows):
                doc_id, page_idx, found, image = (batch.column(c)[i].as_py() for c in (*key, "boxes", "image"))
                try:
                    picture = read(image)
                except OSError:
                    picture = None
                values = [[doc_id] * len(found), [page_idx] * len(found), *([x[c] for x in found] for c in by), [crop(picture, x["bbox"]) for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", image binary"
    return lists.join(images.select(*key, "image"), key, "left").mapInArrow(run, schema)


def converted(images: DataFrame, convert: Callable[[bytes, str], bytes], *, column: str = "image", image_format: str = "png") -> DataFrame:
    """Pictures decoded, cut or encoded by ``convert(content, format)``; formats are jpeg and png."""
    if image_format not in ("jpeg", "png"):
        raise ValueError(f"unknown image format {image_format!r}")
    on_workers(images.sparkSession)

    @F.pandas_udf("binary")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else convert(bytes(x), image_format))

    return images.withColumn(column, run(column))


def _digest(content: bytes) -> int:
    return int.from_bytes(hashlib.sha256(bytes(content)).digest()[:8], "big")


class FakeLayout:
    """One text box and, on every other picture, a formula; by the picture's digest."""

    def analyze(self, images: list[bytes], confidence: float) -> list[list[dict]]:
        box = {"x1": 10.0, "y1": 10.0, "x2": 110.0, "y2": 40.0}
        text = {"label": "text", "label_id": 1, "confidence": 0.9, "bbox": box, "reading_order": 0}
        formula = {"label": "formula", "label_id": 2, "confidence": 0.8, "bbox": {**box, "y2": 90.0}, "reading_order": 1}
        return [[x for x in ([text, formula] if _digest(i) % 2 else [text]) if x["confidence"] > confidence] for i in images]

    def close(self) -> None:
        pass


class FakeFormula:
    """``x_{n}`` with n from the crop's digest; empty crops give nothing."""

    def recognize(self, crops: list[bytes], max_tokens: int) -> list[tuple[str | None, int]]:
        return [(f"x_{{{_digest(c) % 1000}}}", min(max_tokens, 1 + _digest(c) % 300)) if len(c) else (None, 0) for c in crops]


class FakeOcr:
    def read(self, crops: list[bytes]) -> list[tuple[list[str], list[float]]]:
        return [([f"line {_digest(c) % 1000}"], [0.9]) if len(c) else ([], []) for c in crops]


class FakeTable:
    """A grid of two by two."""

    def structure(self, crops: list[bytes]) -> list[tuple[list[list[float]], list[list[int]]]]:
        grid = [(0, 0), (0, 1), (1, 0), (1, 1)]
        polygons = [[c * 40.0 + 10, r * 40.0 + 10, c * 40.0 + 50, r * 40.0 + 10, c * 40.0 + 50, r * 40.0 + 50, c * 40.0 + 10, r * 40.0 + 50] for r, c in grid]
        return [(polygons, [[r, r, c, c] for r, c in grid]) if len(x) else ([], []) for x in crops]


class FakeCitations:
    """The citation's first line as title."""

    def parse(self, citations: list[str]) -> list[dict | None]:
        names = ("year", "venue", "volume", "issue", "pages", "publisher", "doi", "url", "pmid", "arxiv")
        return [{"title": x.split("\n")[0], "authors": [], **dict.fromkeys(names)} if x.strip() else None for x in citations]


class FakeTextLayer:
    """Pages of a plain text, parted by form feeds; each line is a span, from the top down, ten points high."""

    HEIGHT = 800.0

    def open(self, content: bytes) -> list[str]:
        return bytes(content).decode().split("\f")

    def pages(self, document: list[str]) -> int:
        return len(document)

    def spans(self, document: list[str], page: int) -> tuple[list[float], list[tuple[str, float, float, float, float]]]:
        lines = document[page].split("\n")
        return [0.0, 0.0, 600.0, self.HEIGHT], [(x, 5.0, self.HEIGHT - 12.0 * (i + 1), 5.0 * len(x), 10.0) for i, x in enumerate(lines) if x]


def fake_render(content: bytes, dpi: int, image_format: str) -> Iterator[tuple[int, int, bytes]]:
    """A picture of 120 x 160 for each page of :class:`FakeTextLayer`, shaded by the page's digest and the resolution."""
    for page in FakeTextLayer().open(content):
        shades = (np.arange(160 * 120 * 3) * (1 + _digest(page.encode()) % 7) + dpi).astype(np.uint8)
        yield 120, 160, pictures.encode(shades.reshape(160, 120, 3), image_format)
