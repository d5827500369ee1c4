"""Language ID: filters, corrections, held-out accuracy on the given tables."""

import numpy as np

from docloom.llm.common import in_fold
from docloom.llm.language_id import LanguageFilters, fit, grams, identify

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def test_filters_give_every_posted_gram():
    rng = np.random.default_rng(1)
    names = [f"l{i:02d}" for i in range(70)]  # more than one plane
    sets = {n: rng.integers(0, 1 << 32, 200, dtype=np.uint32) for n in names}
    filters = LanguageFilters.build(sets, names, 16)
    for n in names:
        hits = filters.hits(sets[n])
        assert np.argmax(hits) == names.index(n) and hits.max() >= 199
    few = LanguageFilters.build({n: sets[n] for n in names[:3]}, names[:3], 16)
    assert few.slots.dtype == np.uint8 and np.argmax(few.hits(sets["l01"])) == 1


def test_false_positives_are_corrected():
    rng = np.random.default_rng(2)
    filters = LanguageFilters.build({"a": rng.integers(0, 1 << 32, 3000, dtype=np.uint32), "b": rng.integers(0, 1 << 32, 30, dtype=np.uint32)}, ["a", "b"], 12)
    unknown = rng.integers(0, 1 << 32, 20000, dtype=np.uint32)
    assert filters.hits(unknown)[0] < 0.05 * len(unknown) < filters.false_positive[0] * len(unknown)


def test_grams():
    assert len(grams("ab")) == 1 and len(grams("1 2 3")) == 0
    assert grams("Ab, cD!").tolist() == grams("ab  cd").tolist()


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    held = in_fold("doc_id", 4, 2)
    got = identify(documents.where(held), fit(documents.where(~held), docs_per_language=100)).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x", "y"), (2, "der hund und die katze", "de", "x", "y"), (3, None, "en", "x", "y"), (4, "only text", None, "x", "y"), (4, "only text", None, "x", "y"), (None, "", "en", "x", "y"), (6, "12 !? 34", "de", "x", "y"), (7, "日本語 " * 3000, "en", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = fit(frame.where("doc_id < 3"), min_share=0.0)
    got = identify(frame, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = sorted((str(r.doc_id), r.lang_pred) for r in got.collect())

    assert dict(found)["3"] == dict(found)["6"] == dict(found)["None"] == "und" and dict(found)["2"] == "de"
    assert identify(frame.where("false"), model).collect() == []
    assert {r.lang_pred for r in identify(frame, fit(frame.where("false"))).collect()} == {"und"}
