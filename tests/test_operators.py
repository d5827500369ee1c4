"""Facts on small inputs: rounding, white space, routing, stages, parsing."""

import random
import tarfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as X
from docloom.operators import blocks, citations, detect, metrics, routing, stages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("label", "expected"),
    [("text", "text"), ("formula_number", "text"), ("chart", "image"), ("table", "table"), ("inline_formula", "formula"), ("reference", "reference"), ("seal", "ignore"), ("never seen", "image"), (None, "image")],
)
def test_route(spark, label, expected):
    assert one(spark, routing.route(F.lit(label).cast("string"))) == expected


def test_route_sets_are_disjoint():
    labels = [x for group in routing.ROUTES.values() for x in group]
    assert len(labels) == len(set(labels)) == 26


def test_languages():
    codes = [x for group in routing.SCRIPTS.values() for x in group]
    assert len(codes) == len(set(codes)) == 40


@pytest.mark.parametrize(
    ("box", "dpi", "expected"),
    [((0, 0, 595, 842), 72, (0, 0, 595, 842)), ((0, 0, 1190, 1684), 144, (0, 0, 595, 842)), ((0, 0, 100, 50), 72, (0, 792, 100, 50)), ((0, 800, 100, 842), 72, (0, 0, 100, 42))],
)
def test_pdf_region(spark, box, dpi, expected):
    r = one(spark, G.pdf_region(G.bbox(*box), F.lit(dpi), F.lit(842.0)))
    assert (r.x, r.y, r.w, r.h) == pytest.approx(expected)


def test_crop_window(spark):
    cut = lambda *b: one(spark, G.crop_window(G.bbox(*b), F.lit(400), F.lit(600)))
    assert tuple(cut(-50, -50, 450, 700)) == (0, 0, 400, 600)
    assert tuple(cut(0.5, 1.5, 2.5, 3.5)) == (0, 2, 2, 4)
    assert cut(100, 100, 50, 50) is None
    assert cut(500, 0, 600, 10) is None


def test_white_space_is_unicode(spark):
    raw = "\x1c a  b\x85\n　c "
    assert one(spark, X.squeezed(F.lit(raw))) == "a b c"
    assert one(spark, X.squeezed(F.lit("  "))) is None
    assert one(spark, X.ink(F.lit(raw))) == 3


def test_half_even_on_random_boxes(spark):
    rng = random.Random(7)
    values = [rng.randrange(0, 80000) / 8 for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(F.bround("v", 0).cast("long").alias("r"), F.bround("v", 2).alias("d")).collect()
    assert [r.r for r in rows] == [round(v) for v in values]
    assert [r.d for r in rows] == [round(v, 2) for v in values]


@pytest.mark.parametrize(
    ("counts", "args", "expected"),
    [
        ([500, 0, 0, 0, 0], {"ratio": 0.5}, False),
        ([500, 0, 0, 0, 0], {"ratio": 0.1}, True),
        ([200, 60, 60, 60, 60], {"ratio": 0.5}, True),
        ([200, 0, 0, 0, 0], {"ratio": 0.5}, False),
        ([0, 0, 0], {"sample": 50}, False),
    ],
)
def test_digital_born(spark, counts, args, expected):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(counts)], "doc_id long, page_idx long, n_chars long")
    assert detect.digital_born(rows, **args).first()["digital_born"] is expected


def test_sampled_pages(spark):
    for pages in (0, 1, 2, 3, 10, 11, 77):
        for k in (0, 1, 2, 3, 5, 7, 20):
            n = min(max(1, k), pages)
            wanted = [] if n < 1 else [0] if n == 1 else sorted({round(i * (pages - 1) / (n - 1)) for i in range(n)})
            assert one(spark, detect.sampled_pages(F.lit(pages), k)) == wanted


def test_metadata_values(spark):
    clean = lambda v: one(spark, X.clean_metadata(F.lit(v)))
    assert clean("þÿ\x00H\x00i") == "Hi"
    assert clean("ÿþH\x00i\x00") == "Hi"
    assert clean("Hello\x00World") == "HelloWorld"
    assert clean("﻿Plain") == "Plain"
    assert clean("naïve ünïcode") == "naïve ünïcode"
    assert one(spark, X.clean_metadata_list(F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a; b"


def test_miss_mark(spark):
    mark = lambda v: one(spark, X.with_miss_mark(F.lit(v)))
    assert mark("images/0001-display_formula-ab12.png") == "images/0001-display_formula-MISS-ab12.png"
    assert mark("images/0001-table-MISS-ab12.png") == "images/0001-table-MISS-ab12.png"


@pytest.mark.parametrize(
    ("lines", "scores", "expected"),
    [([], [], None), (["a"], [0.4], None), (["a", "", " b "], [0.9, 0.9, 0.3], "a  b"), (["a"], [], "a"), (["a"], None, "a"), (["", " "], [0.9], None), (["a"], [0.5], "a")],
)
def test_ocr_acceptance(spark, lines, scores, expected):
    rows = spark.createDataFrame([(lines, scores)], "lines array<string>, scores array<double>")
    assert rows.select(stages.accepted_ocr(F.col("lines"), F.col("scores")).alias("x")).first()["x"] == expected


def test_blocks_miss_and_pictures(spark):
    rows = spark.createDataFrame([(1, 0, i, label, text) for i, (label, text) in enumerate([("text", "t"), ("text", ""), ("reference", None), ("chart", None), ("seal", "x")])], "doc_id long, page_idx int, det_idx int, label string, text string")
    built = blocks.build_blocks(blocks.with_block_idx(blocks.with_reading_order(routing.routed(rows), None)), ("text",)).orderBy("block_idx").collect()
    assert [(r.type, r.text, r.miss, bool(r.image_path)) for r in built] == [("text", "t", False, False), ("text", None, True, True), ("reference", None, True, False), ("image", None, False, True)]
    assert "-MISS-" in built[1].image_path and built[3].image_path.startswith("images/0001-chart-")


def test_splice_and_zip(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "k long, v array<string>")
    right = spark.createDataFrame([(1, ["x"]), (2, ["y", "surplus"])], "k long, r array<string>")

    assert {(r.k, r.value, r.result) for r in blocks.zipped(left, right, "k", "v", "r").collect()} == {(1, "a", "x"), (1, "b", None), (1, "c", None), (2, "d", "y")}


def test_buckets_and_batches(spark):
    rows = spark.createDataFrame([(1, 0, i, a) for i, a in enumerate([100000.0, 100.0, 5000.0, 2500.0, 15000.0])], "doc_id long, page_idx int, block_idx int, bbox_area double")
    got = {r.block_idx: (r.bucket, r.max_tokens, r.batch_no) for r in stages.batched(stages.bucketed(rows), 1).collect()}
    assert got == {0: ("large", 1536, 1), 1: ("small", 192, 0), 2: ("medium", 512, 1), 3: ("medium", 512, 0), 4: ("large", 1536, 0)}
    for bad in ((30000, 2500, 1, 1, 1), (0, 2500, 1, 1, 1), (1, 2, 0, 1, 1)):
        with pytest.raises(ValueError):
            stages.checked_buckets(*bad)
    with pytest.raises(ValueError):
        stages.batched(rows, 0)


def test_table_cells(spark):
    from docloom.models import FakeTable

    polygons, logic = FakeTable().structure([b"x"])[0]
    rows = spark.createDataFrame([(1, 0, 0, polygons[::-1], logic[::-1])], "doc_id long, page_idx int, block_idx int, polygons array<array<double>>, logic array<array<int>>")
    rows = rows.select("*", G.bbox(200, 300, 400, 500).alias("bbox"), F.lit(1240).alias("width_px"), F.lit(1754).alias("height_px"))
    got = stages.table_cells(rows).orderBy("cell_idx").collect()
    assert [(r.row_start, r.col_start) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert tuple(got[0].cell_bbox) == (210.0, 310.0, 250.0, 350.0)


BIBL = """<biblStruct><analytic><title level="a">T <hi>x</hi> y</title><author><persName><forename>Ada</forename><forename>B</forename><surname>Lovelace</surname></persName></author><author><note/></author>
<idno type="DOI">10.1/x</idno></analytic><monogr><title level="j">Journal</title><imprint><biblScope unit="volume">3</biblScope><biblScope unit="issue">4</biblScope><biblScope unit="page" from="12" to="30"/>
<date when="2020-05">May</date><publisher>P</publisher></imprint></monogr><idno type="arXiv">2001.1</idno><ptr target="http://u"/></biblStruct>"""


def test_citation_fields():
    r = citations.parse_references(BIBL)[0]
    assert (r["title"], r["venue"], r["year"], r["volume"], r["issue"], r["pages"], r["publisher"]) == ("T x y", "Journal", "2020", "3", "4", "12-30", "P")
    assert (r["doi"], r["arxiv"], r["url"]) == ("10.1/x", "2001.1", "http://u")
    assert r["authors"] == [{"name": "Ada B Lovelace", "surname": "Lovelace", "forename": "Ada B"}]


def test_citation_shapes():
    tei = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><listBibl>{BIBL}<biblStruct/></listBibl></TEI>'
    found = citations.parse_references(tei, 3)
    assert found[0]["title"] == "T x y" and found[1:] == [None, None]
    assert citations.parse_references("  ") == [] == citations.parse_references("<TEI><listBibl/></TEI>")
    assert citations.parse_references("<biblStruct><monogr><title level='m'>Book</title></monogr></biblStruct>")[0]["venue"] == "Book"
    assert citations.parse_references("<biblStruct><monogr><title>no level</title><imprint><biblScope unit='volume'>1</biblScope></imprint></monogr></biblStruct>") == [None]
    with pytest.raises(citations.CitationError):
        citations.parse_references("<broken")


def test_reference_stage_survives_a_failing_client(spark):
    class Broken:
        def parse(self, _):
            raise RuntimeError

    rows = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b")], "doc_id long, page_idx int, block_idx int, citation string")
    assert [r.reference for r in citations.references(rows, Broken).collect()] == [None, None]


def test_service_probe_never_raises():
    assert citations.is_alive("http://127.0.0.1:9", 0.2) is False


def test_stats_edges(spark):
    rows = spark.createDataFrame([("a", 1.23456), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 10.0), ("c", None)], "k string, v double")
    got = {r.k: (r.min, r.median, r.p95, r.max, r.samples) for r in metrics.stats(rows, "v", "k").collect()}
    assert got == {"a": (1.23456,) * 4 + (1,), "b": (1.0, 2.5, 8.95, 10.0, 4), "c": (0.0, 0.0, 0.0, 0.0, 0)}


def test_bundle(tmp_path, spark):
    from docloom.sources.files import bundles, read_bundle_json, write_bundles

    docs = spark.createDataFrame([(1, '{"a": "é"}'), (2, "{}")], "doc_id long, json string")
    crops = spark.createDataFrame([(1, "images/b.png", bytearray(b"B")), (1, "images/a.png", bytearray(b"A"))], "doc_id long, image_path string, image binary")
    made = bundles(docs, crops).cache()
    write_bundles(made, str(tmp_path))
    with tarfile.open(tmp_path / "1.tar") as tar:
        assert tar.getnames() == ["document.json", "images/a.png", "images/b.png"]
    back = {r.doc_id: (r.json, r.bundle_files) for r in read_bundle_json(made).collect()}
    assert back == {1: ('{"a": "é"}', 3), 2: ("{}", 1)}
