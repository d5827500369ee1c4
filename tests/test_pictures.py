"""The picture codec, crops, and files to bundles with stand-in models."""

import io
import json
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import PipelineSettings
from docloom.functions import pictures
from docloom.functions.geometry import bbox
from docloom.models import FakeCitations, FakeFormula, FakeLayout, FakeOcr, FakeTable, FakeTextLayer, cut_crops, detect, fake_render, formula_results, layout_factory, prepared, recognize_formulas, structure_tables
from docloom.plans.collection import collect_documents
from docloom.sources import files, reports
from docloom.streaming import landing
from docloom.workers import ahead, logged


def drawn(height, width, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def png(pixels, colour, filters, palette=b""):
    """A PNG with the given filter for each row, filtered here pixel by pixel."""
    height, width, step = pixels.shape
    raw = b""
    for y in range(height):
        raw += bytes([filters[y % len(filters)]])
        for x in range(width):
            for c in range(step):
                a = int(pixels[y, x - 1, c]) if x else 0
                b = int(pixels[y - 1, x, c]) if y else 0
                k = int(pixels[y - 1, x - 1, c]) if x and y else 0
                p = a + b - k
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - k) else b if abs(p - b) <= abs(p - k) else k
                raw += bytes([(int(pixels[y, x, c]) - [0, a, b, (a + b) // 2, paeth][filters[y % len(filters)]]) & 255])

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
    return out + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png():
    for height, width in ((1, 1), (7, 5), (40, 33)):
        assert (pictures.decode(pictures.encode(drawn(height, width))) == drawn(height, width)).all()
    pixels = drawn(9, 6)
    assert (pictures.decode(png(pixels, 2, [0, 1, 2, 3, 4])) == pixels).all()
    assert (pictures.decode(png(np.dstack([pixels, pixels[:, :, :1]]), 6, [4, 3, 1])) == pixels).all()
    assert (pictures.decode(png(pixels[:, :, :1], 0, [3])) == pixels[:, :, :1]).all()
    assert (pictures.decode(png(pixels[:, :, :1] % 4, 3, [2], bytes(range(12)))) == (pixels[:, :, :1] % 4) * 3 + np.arange(3)).all()
    good = pictures.encode(pixels)
    for bad in (None, b"", b"no picture", good[:40], good[:30] + b"\x00" + good[31:], good[:8]):
        with pytest.raises(OSError):
            pictures.decode(bad)
    with pytest.raises(ValueError, match="gif"):
        pictures.encode(pixels, "gif")


def test_jpeg_is_read_by_another_reader(spark):
    jvm = spark._jvm
    y, x = np.mgrid[:37, :53]
    smooth = np.dstack([2 * x, 3 * y, x + y]).astype(np.uint8)
    for picture, quality, most in ((smooth, 95, 2), (smooth, 20, 12), (drawn(20, 20), 100, 3), (np.zeros((9, 9, 3), np.uint8), 95, 1)):
        found = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(pictures.encode(picture, "jpeg", quality)))
        assert (found.getHeight(), found.getWidth()) == picture.shape[:2]
        values = [(v := found.getRGB(i, j)) and [v >> 16 & 255, v >> 8 & 255, v & 255] for j in range(picture.shape[0]) for i in range(picture.shape[1])]
        assert np.abs(np.reshape(values, picture.shape) - picture.astype(int)).mean() <= most
    assert len(pictures.encode(smooth, "jpeg", 20)) < len(pictures.encode(smooth, "jpeg", 95))


def test_cut_and_planes():
    picture = drawn(10, 20)
    assert (pictures.cut(picture, (0.5, 1.5, 4.5, 30)) == picture[2:10, 0:4]).all()
    for bad in ((5, 5, 5, 9), (6, 5, 5, 9), (30, 0, 40, 5), (-9, 0, -1, 5), (0, 12, 5, 20), (1.1, 1, 1.2, 3)):
        with pytest.raises(ValueError):
            pictures.cut(picture, bad)
    assert (pictures.planes(picture[:, :10], 10) == (picture[:, :10] / 255).astype(np.float32).transpose(2, 0, 1)).all()
    assert pictures.planes(np.full((3, 5, 3), 200, np.uint8)).shape == (3, 800, 800)
    assert np.allclose(pictures.planes(np.full((3, 5, 3), 200, np.uint8), 8), 200 / 255)


def test_crops(spark):
    page = drawn(30, 40)
    images = spark.createDataFrame([(1, 0, bytearray(pictures.encode(page))), (1, 1, bytearray(b"broken")), (1, 2, None)], "doc_id long, page_idx int, image binary")
    rows = [(1, 0, i, float(i), 2.0, i + 3.0, 9.0) for i in range(600)] + [(1, p, 0, 0.0, 0.0, 5.0, 5.0) for p in (1, 2, 3)]
    boxes = spark.createDataFrame(rows, "doc_id long, page_idx int, block_idx int, a double, b double, c double, d double").withColumn("bbox", bbox(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    boxes = boxes.unionByName(boxes.where("page_idx = 3").withColumns({"page_idx": F.lit(0), "block_idx": F.lit(-1), "bbox": F.lit(None).cast(boxes.schema["bbox"].dataType)}))
    got = {(r.page_idx, r.block_idx): r.image for r in cut_crops(boxes, images).collect()}
    assert len(got) == 604
    assert all((pictures.decode(got[0, i]) == page[2:9, i : i + 3]).all() for i in range(40))
    assert not any(v for k, v in got.items() if k[0] or not 0 <= k[1] < 40)
    assert cut_crops(boxes.limit(0), images).collect() == []
    two = cut_crops(boxes.where("page_idx = 0 AND block_idx < 2").withColumn("cell_idx", F.lit(7)), images, by=("block_idx", "cell_idx"), image_format="jpeg")
    assert {(r.block_idx, r.cell_idx, r.image is None) for r in two.collect()} == {(-1, 7, True), (0, 7, False), (1, 7, False)}
    with pytest.raises(ValueError):
        cut_crops(boxes, images, image_format="gif")


def test_working_ahead(caplog):
    made = []

    def items():
        for i in range(50):
            made.append(i)
            yield i
        raise KeyError("late")

    got = []
    with pytest.raises(KeyError, match="late"):
        for x in ahead(items()):
            got.append(x)
            assert len(made) <= len(got) + 3
    assert got == list(range(50))
    made.clear()
    assert next(ahead(items())) == 0 and len(made) < 6
    with pytest.raises(ZeroDivisionError), logged("division"):
        1 / 0
    assert "division failed" in caplog.text


def test_factories(spark):
    made = layout_factory(PipelineSettings(layout_fp16=True, layout_device="cpu"), lambda **given: given)()
    assert made == {"device": "cpu", "fp16": True, "fast_preproc": False}
    assert formula_results(["x", ""], 7, 2) == [("x", 7), (None, 7)] and formula_results("y", 3, 1) == [("y", 3)]
    with pytest.raises(ValueError):
        formula_results(["x"], 7, 2)

    class Planes:
        def analyze(self, images, confidence):
            assert all(size == (4, 6) and p.shape == (3, 800, 800) for size, p in images)
            return FakeLayout().analyze([b"x"] * len(images), confidence)

        def close(self):
            pass

    rows = spark.createDataFrame([(1, i, bytearray(pictures.encode(drawn(4, 6, i)))) for i in range(5)], "doc_id long, page_idx int, image binary")
    assert {r.page_idx for r in detect(rows, Planes, batch_size=2, prepare=prepared).collect()} == set(range(5))


def test_text_layers(spark):
    class Flawed(FakeTextLayer):
        def spans(self, document, page):
            if document[page] == "bad":
                raise RuntimeError
            return super().spans(document, page)

        def pages(self, document):
            return 1 // (document != ["closed"]) * len(document)

    rows = spark.createDataFrame([("a", bytearray(b"one\ntwo\fbad\f")), ("b", bytearray(b"closed"))], "path string, content binary")
    got = {(r.path, r.page_idx): r.spans and [s.text for s in r.spans] for r in files.read_spans(rows, Flawed).collect()}
    assert got == {("a", 0): ["one", "two"], ("a", 1): None, ("a", 2): []}
    with pytest.raises(ValueError):
        files.render_pages(rows, fake_render, image_format="gif")


def test_files_to_bundles(spark, tmp_path):
    born = "\f".join("\n".join(f"line {i} of a page with enough text" for i in range(64)) for _ in range(2))
    for name, text in (("a", born), ("b", "x"), ("c", "y")):
        (tmp_path / f"{name}.pdf").write_bytes(text.encode())
    found = files.scan_documents(spark, str(tmp_path))
    asked = found.withColumn("language", F.when(F.col("filename") == "c.pdf", "hy").otherwise("en"))
    settings = PipelineSettings(table_enabled=True, references_enabled=True, render_dpi=72, render_dpi_digital_born=72, crop_format="jpeg")
    run = collect_documents(
        asked, FakeTextLayer, fake_render, FakeLayout, settings, make_ocr=FakeOcr, make_citation_client=FakeCitations,
        formulas=lambda t: recognize_formulas(t.select("doc_id", "page_idx", "block_idx", "bucket_no", "batch_no", "place", "max_tokens", "image"), FakeFormula),
        tables=lambda t: structure_tables(t, FakeTable),
    )
    names = {r.doc_id: r.path[-5] for r in run.names.collect()}
    bundles = {names[r.doc_id]: r.bundle for r in run.bundles.collect()}
    assert set(bundles) == {"a", "b"}
    assert [r.reason for r in run.extracted.rejected.collect()] == ["language not supported"]
    for name, pages in (("a", 2), ("b", 1)):
        with tarfile.open(fileobj=io.BytesIO(bundles[name])) as tar:
            document = json.loads(tar.extractfile("document.json").read())
            inside = {n: tar.extractfile(n).read() for n in tar.getnames()[1:]}
        assert document["digital_born"] == (name == "a") and len(document["pages"]) == pages
        rows = [b for p in document["pages"] for b in p["blocks"]]
        first = rows[0]
        # the box from 10 to 40 holds the centres of lines 1 and 2, which are 19 and 31 points from the top
        born_text = " ".join(f"line {i} of a page with enough text" for i in (1, 2))
        assert first["text"] == born_text if name == "a" else first["text"].startswith("line ")
        assert set(inside) == {b["image_path"] for b in rows if b["image_path"]}
        assert all(x.startswith(b"\xff\xd8") for x in inside.values())
        assert all(b["text"].startswith("x_{") for b in rows if b["type"] == "formula")
    run.close()
    run.close()
    with pytest.raises(Exception):
        run.extracted.documents.collect()


def test_run_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    run = landing.process_arrivals(landing.landing(spark, str(tmp_path / "in")), lambda b: b.select("length"), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "log"))
    run.awaitTermination(60)
    assert [r.processing_s > 0 for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [True]


def test_sweep_files(tmp_path):
    log = reports.SweepLog(str(tmp_path / "deep" / "s.csv"))
    log.add({"value": "8", "status": "ok", "wall_s": 2.0})
    log.add({"value": "16", "status": "ok"})
    assert (tmp_path / "deep" / "s.csv").read_text().split() == ["value,status,wall_s", "8,ok,2.0", "16,ok,"]
    assert [x.name for x in (tmp_path / "deep").iterdir()] == ["s.csv"]
    with pytest.raises(ValueError, match="bogus"):
        log.add({"bogus": 1})
    rows = [{"value": v, "status": "ok", "wall_s": w, "stage_render_s": w / 2, "cpu_pct_min": 1.0, "cpu_pct_med": 2.0, "cpu_pct_p95": 3.0, "cpu_pct_max": 4.4, "quality_miss": 0} for v, w in (("8", 4.0), ("16", 1.0), ("32", 2.0))]
    page = reports.sweep_page([*rows, {"value": "64", "status": "error", "wall_s": 0.5, "error": "y" * 300}], name="batches", knob="b", pdf="a.pdf", description="Why.", stages=["render", "table"])
    for line in (
        "# batches", "Why.", "- **Runs:** 4 (3 ok, 1 failed)", "- **Fastest:** `16` @ 1.00s -- **Slowest:** `8` @ 4.00s (**4.00x** spread)", "| value | status | wall (s) | render (s) | table (s) |",
        "| 8 | ok | 4.00 | 2.00 | -- |", "| 8 | 1 / 2 / 3 / 4 | -- | -- |", "| 64 | -- | -- | -- |", "| 8 |  |  | 0 |", f"- `64` -- **error** -- `{'y' * 200}`",
        "- Wall time across 3 successful runs: min=1.00s, median=2.00s, max=4.00s.",
    ):
        assert line in page.splitlines()
    few = reports.sweep_page(rows[:1], name="x", knob="b", pdf="a.pdf")
    assert "spread" not in few and "Notes" not in few and "Failures" not in few
