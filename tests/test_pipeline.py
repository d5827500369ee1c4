"""The whole document plan with stand-in models, settings, logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.config import PipelineSettings, as_bool, load_settings
from docloom.functions.geometry import bbox
from docloom.models import FakeCitations, FakeFormula, FakeTable, recognize_formulas
from docloom.operators.assemble import json_text
from docloom.plans.document_pipeline import extract
from docloom.sources import files, logs
from docloom.streaming import landing


def inputs(spark):
    documents = spark.createDataFrame([(1, "en", True), (2, "tr", False), (3, "hy", True)], "doc_id long, language string, digital_born boolean")
    documents = documents.withColumn("metadata", F.lit(None).cast("struct<filename:string,sha256:string,byte_size:bigint,pdf_info:map<string,string>>"))
    pages = spark.createDataFrame([(d, p, 1240, 1754) for d in (1, 2, 3) for p in (0, 1)], "doc_id long, page_idx int, width_px int, height_px int")
    labels = [("text", "hello"), ("formula", None), ("table", None), ("reference", "Ref one\nx"), ("header", "no"), ("text", "  ")]
    rows = [(1, 0, i, label, 0.9, text, 10.0 * i) for i, (label, text) in enumerate(labels)] + [(1, 0, 9, "text", 0.5, "too weak", 0.0), (2, 0, 0, "text", 0.9, "scan", 0.0)]
    detections = spark.createDataFrame(rows, "doc_id long, page_idx int, det_idx int, label string, confidence double, text string, top double")
    return documents, pages, detections.withColumn("bbox", bbox(10, F.col("top"), 210, F.col("top") + 150.129)).drop("top")


def formulas(targets):
    return recognize_formulas(targets.withColumn("image", F.lit("crop").cast("binary")), FakeFormula)


def tables(targets):
    polygons, logic = FakeTable().structure([b"x"])[0]
    pol = F.array(*[F.array(*map(F.lit, p)) for p in polygons])
    return targets.withColumns({"polygons": pol, "logic": F.array(*[F.array(*map(F.lit, x)) for x in logic])})


def test_extract(spark):
    settings = PipelineSettings(scanned_enabled=False, table_enabled=True, references_enabled=True)
    got = extract(*inputs(spark), settings, formulas=formulas, tables=tables, make_citation_client=FakeCitations)
    rows = got.blocks.orderBy("block_idx").collect()
    assert [r.type for r in rows] == ["text", "formula", "table", "reference", "text"]
    assert rows[1].text.startswith("x_{") and rows[1].image_path is None and not rows[1].miss
    assert (rows[2].n_rows, rows[2].n_cols, len(rows[2].cells)) == (2, 2, 4)
    assert rows[3].reference.title == "Ref one"
    assert {r.doc_id: r.reason for r in got.rejected.collect()} == {2: "scanned documents are switched off", 3: "language not supported"}
    document = got.documents.select(json_text(F.col("document")).alias("j")).collect()
    assert len(document) == 1
    back = json.loads(document[0].j)
    assert [p["page_no"] for p in back["pages"]] == [1, 2] and back["pages"][1]["blocks"] == []
    first = back["pages"][0]["blocks"][0]
    assert first["bbox"] == [10.0, 0.0, 210.0, 150.13] and first["image_path"] is None and "reference" in first


def test_settings(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("DOCLOOM_CONFIG", raising=False)
    assert load_settings().pipeline == PipelineSettings()
    (tmp_path / "docloom.toml").write_text('[pipeline]\nrender_dpi = 200\nbundle_miss_images_for = ["text"]\n')
    assert load_settings().pipeline.render_dpi == 200
    (tmp_path / "docloom.toml").write_text("[pipeline]\nbogus = 1\n")
    with pytest.raises(ValueError, match="bogus"):
        load_settings()
    with pytest.raises(FileNotFoundError):
        load_settings(tmp_path / "none.toml")
    env = {"DOCLOOM_RENDER_DPI": "72", "DOCLOOM_SCANNED_ENABLED": "off", "DOCLOOM_REFERENCE_LABELS": "a, ,b", "DOCLOOM_JPEG_QUALITY": "", "DOCLOOM_BUNDLE_MISS_IMAGES_FOR": " , "}
    got = PipelineSettings.from_env(env)
    assert (got.render_dpi, got.scanned_enabled, got.reference_labels, got.jpeg_quality, got.bundle_miss_images_for) == (72, False, ("a", "b"), 95, frozenset())
    with pytest.raises(ValueError):
        PipelineSettings(bundle_miss_images_for={"bogus"})
    assert as_bool(" Yes ") and not as_bool("2")


def test_logs(spark):
    lines = spark.createDataFrame([("stage blocks: pdf=a.pdf text=3 elapsed_s=1.25",), ("stage formula: pdf=a.pdf truncated=2 elapsed_s=4.00",), ("stage table: skipped",), ("ROW:{\"a\": 1}",), ("ROW:{oops",)], "line string")
    assert {(r.stage, r.pdf, r.elapsed, r.truncated) for r in logs.stage_lines(lines).collect()} == {("blocks", "a.pdf", 1.25, None), ("formula", "a.pdf", 4.0, 2)}
    assert [r.a for r in logs.row_protocol(lines, "a int").collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-a")
    (tmp_path / "b.txt").write_bytes(b"no")
    found = files.with_metadata(files.scan_documents(spark, str(tmp_path)), lambda c: {"title": "x\x00y", "none": ""})
    row = found.select("metadata.*").first()
    assert (row.filename, row.byte_size, row.pdf_info) == ("a.pdf", 6, {"title": "xy"})
    pages = files.render_pages(files.scan_documents(spark, str(tmp_path)), lambda content, dpi: iter([(dpi, 2, content)] * 3))
    assert [(r.page_idx, r.width_px) for r in pages.orderBy("page_idx").collect()] == [(0, 300), (1, 300), (2, 300)]


def test_sweep_columns(spark, tmp_path):
    (tmp_path / "s.csv").write_text("benchmark,value,pdf,language,status,wall_s\nx,true,a.pdf,en,ok,1.5\n")
    names = [x.split()[0] for x in files.SWEEP_SCHEMA.split(", ")]
    assert len(names) == 43 and names[-1] == "error"


def test_landing(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.pdf").write_bytes(b"x" * (i + 1))
    stream = landing.landing(spark, str(tmp_path / "in"))
    run = landing.process_arrivals(stream, lambda b: b.select("length"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.length for r in got.collect()) == [1, 2, 3]
    assert got.select("batch").distinct().count() == 3


def test_reports(spark):
    from docloom.sources.reports import flattened, markdown, scaled

    rows = spark.createDataFrame(
        [("a", 0, "8", "ok", 2.0, {"blocks": 1.23456}, (1.0, 2.0, 3.0, 4.0)), ("a", 1, "16", "ok", 1.0, {}, (1.0, 2.0, 3.0, 4.0)), ("a", 2, "32", "error", 9.0, None, None)],
        "benchmark string, ord int, value string, status string, wall_s double, stages map<string,double>, cpu_pct struct<min:double,median:double,p95:double,max:double>",
    )
    flat = flattened(rows, ["blocks"], ["cpu_pct"]).orderBy("ord").collect()
    assert (flat[0].stage_blocks_s, flat[0].cpu_pct_med, flat[1].stage_blocks_s) == (1.235, 2.0, None)
    assert "| a | 16 | 1.00 | 8 | 2.00 | 2.00 |" in markdown(rows) and "Failed: a (1)" in markdown(rows)
    with pytest.raises(ValueError, match="nope"):
        scaled(rows, ["nope"], 0.01)


def test_models_survive_missing_pictures(spark):
    from docloom.models import FakeLayout, FakeOcr, converted, detect, recognize_text, structure_tables

    rows = spark.createDataFrame([(1, 0, bytearray(b"a")), (1, 1, None)], "doc_id long, page_idx int, image binary")
    got = recognize_text(rows, FakeOcr).orderBy("page_idx").collect()
    assert len(got[0].lines) == 1 and got[1].lines == []
    assert [r.polygons is None for r in structure_tables(rows, FakeTable).orderBy("page_idx").collect()] == [False, True]

    class Broken:
        def structure(self, _):
            raise RuntimeError

    assert all(r.polygons is None for r in structure_tables(rows, Broken).collect())
    found = detect(rows.where("page_idx = 0"), FakeLayout).collect()
    assert found[0].label == "text" and found[0].det_idx == 0
    assert converted(rows, lambda c, f: c + f.encode()).orderBy("page_idx").first().image == b"apng"
    with pytest.raises(ValueError):
        converted(rows, lambda c, f: c, image_format="gif")


def test_a_report_tells_what_it_leaves_out(spark):
    from docloom.sources.reports import markdown

    rows = [(f"s{i:03d}", i, f"v{i}", 1.0 + i, "ok") for i in range(60)] + [(f"s{i:03d}", 100 + i, "v", 0.0, "error") for i in range(7)]
    text = markdown(spark.createDataFrame(rows[::-1], "benchmark string, ord int, value string, wall_s double, status string"), most=5)
    assert [x[2:6] for x in text.splitlines() if x.startswith("| s0")] == [f"s{i:03d}" for i in range(5)]
    assert "Left out: 55 more sweeps" in text and text.endswith("s004 (1) and 2 more")


def test_each_target_is_asked_about_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(targets):
        def run(batches):
            for rows in batches:
                asked.add(len(rows))
                yield rows.assign(latex="x")

        kept = targets.select("doc_id", "page_idx", "block_idx")
        return kept.mapInPandas(run, "doc_id long, page_idx int, block_idx int, latex string")

    settings = PipelineSettings(scanned_enabled=False, table_enabled=True, references_enabled=True)
    got = extract(*inputs(spark), settings, formulas=counted, tables=tables, make_citation_client=FakeCitations)
    assert got.blocks.where("type = 'formula' AND text = 'x'").count() == 1
    assert got.summary.count() == 1 == got.documents.count()
    assert asked.value == 1


def test_flags_types_and_logging(monkeypatch):
    import logging

    from docloom.config import LoggingSettings, as_block_types

    got = PipelineSettings.from_env({"DOCLOOM_TABLE_ENABLED": " yes", "DOCLOOM_LAYOUT_FP16": "YES", "DOCLOOM_BUNDLE_MISS_IMAGES_FOR": "TEXT, Table"})
    assert not got.table_enabled and got.layout_fp16 and got.bundle_miss_images_for == {"text", "table"} == as_block_types("Text,tAble,")
    root = logging.getLogger()
    monkeypatch.setattr(root, "handlers", list(root.handlers))
    level = root.level
    try:
        LoggingSettings(level="ERROR").apply()
        assert (root.level, logging.getLogger("docloom").level, logging.getLogger("pdf_oxide").level) == (logging.ERROR, logging.ERROR, logging.WARNING)
    finally:
        root.setLevel(level)


def test_json_is_as_python_writes_it(spark):
    box = {"x1": 1.005, "y1": 1e16, "x2": 0.00001, "y2": 2.0}
    block = {"reading_order": 0, "label": 'a "b" \\ é\n\x0b\u2028', "type": "text", "bbox": box, "confidence": 1e-05, "text": None, "image_path": "", "miss": False, "n_rows": None, "n_cols": None, "cells": [], "reference": None}
    value = {"metadata": {"filename": "日本", "sha256": None, "byte_size": 3, "pdf_info": {"k": "v"}}, "language": "en", "digital_born": True, "pipeline_version": "1", "pages": [{"page_no": 1, "width_px": 2, "height_px": 3, "blocks": [block]}, {"page_no": 2, "width_px": 2, "height_px": 3, "blocks": []}]}
    from docloom.schema import DOCUMENT

    rows = spark.createDataFrame([(value,), (None,)], f"document {DOCUMENT.simpleString()}")
    got = [r.j for r in rows.select(json_text(F.col("document")).alias("j")).collect()]
    block["bbox"] = [round(box[c], 2) for c in ("x1", "y1", "x2", "y2")]
    assert got == [json.dumps(value, indent=2, ensure_ascii=False), None]


def test_running_sums_by_ranges(spark):
    from docloom.operators.metrics import cumulative, level_summary, numbered

    rows = spark.createDataFrame([(a, i * 3, float(i)) for a in "ab" for i in range(50)], "arm string, event long, wall double")
    placed = numbered(rows, key="arm", index="event", span=7)
    got = {(r.arm, r.idx): r.total for r in cumulative(placed, span=4).collect()}
    assert got == {(a, i + 1): float(sum(range(i + 1))) for a in "ab" for i in range(50)}
    calls = spark.createDataFrame([(1, False, 1.0, 1.0, 0.0)], "level long, ok boolean, client_s double, server_s double, wall_s double")
    row = level_summary(calls).first()
    assert (row.median_s, row.client_median_s, row.per_minute, row.status, row.error) == (0.0, 0.0, 0.0, "error", "all clients failed")


def test_formula_batches_across_arrow_batches(spark):
    class Strict:
        """Raises for a batch with a crop 'bad'; says how many crops and which cap it was given."""

        def recognize(self, crops, max_tokens):
            if any(bytes(c) == b"bad" for c in crops):
                raise RuntimeError
            return [(f"{bytes(c).decode()}/{len(crops)}/{max_tokens}", 1) for c in crops]

    rows = [(d, b, p // 3, p, 10 * (p + 1), bytearray(b"bad" if (d, b, p) == (1, 0, 4) else f"{p}".encode()) if p % 5 else None) for d in (1, 2) for b in (0, 1) for p in range(8)]
    targets = spark.createDataFrame(rows, "doc_id long, bucket_no int, batch_no int, place int, max_tokens int, image binary")
    wanted = {}
    for d, b, n, p, _, image in rows:
        batch = [r for r in rows if r[:3] == (d, b, n)]
        readable = [r for r in batch if r[5] is not None]
        broken = any(r[5] == b"bad" for r in readable)
        wanted[d, b, p] = None if image is None or broken else f"{p}/{len(readable)}/{max(r[4] for r in batch)}"
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (2, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = recognize_formulas(targets, Strict).collect()
            assert {(r.doc_id, r.bucket_no, r.place): r.latex for r in got} == wanted and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert recognize_formulas(targets.limit(0), Strict).collect() == []


def test_json_is_written_in_bounded_slices(spark, monkeypatch):
    """Values of all kinds as Python writes them, whatever the size of the slices; boxes whose sides can't be null too."""
    from docloom.functions import geometry as G
    from docloom.functions import json_text as module

    kind = "struct<s:string,n:bigint,b:boolean,f:double,box:struct<x1:double,y1:double,x2:double,y2:double>,xs:array<struct<t:string,ys:array<double>>>,m:map<string,string>>"
    box = {"x1": 2.675, "y1": -0.001, "x2": 1e16, "y2": None}
    values = [
        {"s": 'a "q" \\ \n\x01é ', "n": -3, "b": True, "f": 1e-7, "box": box, "xs": [{"t": "", "ys": [0.1, None, float("inf")]}, None, {"t": None, "ys": []}], "m": {"k": 'v\n"'}},
        None,
        {"s": None, "n": None, "b": None, "f": 1e22, "box": None, "xs": [], "m": {}},
        {"s": "x", "n": 2**60, "b": False, "f": -0.0, "box": {k: 0.125 for k in box}, "xs": None, "m": None},
    ] * 25
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)

    def plain(v):
        return v and {**v, "box": v["box"] and [None if x is None else round(x, 2) for x in v["box"].values()]}

    wanted = [v and json.dumps(plain(v), indent=2, ensure_ascii=False) for v in values]
    for most in (1, 500, 2 << 20):
        monkeypatch.setattr(module, "SLICE_BYTES", most)
        assert [r.j for r in rows.select("i", module.indented(F.col("v"), rows.schema["v"].dataType).alias("j")).orderBy("i").collect()] == wanted
    sure = spark.range(1).select(F.struct(G.bbox(1.005, 2, 3, 4).alias("box")).alias("v"))
    assert json.loads(sure.select(module.indented(F.col("v"), sure.schema["v"].dataType)).first()[0]) == {"box": [1.0, 2.0, 3.0, 4.0]}
