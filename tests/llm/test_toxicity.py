"""Toxicity: held-out ranking, located sentences."""

from docloom.llm.common import in_fold
from docloom.llm.toxicity import ToxicityModel, fit, noisy_or, score

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, toxic int, score string, offending string"


def auc(pairs):
    ordered = sorted(pairs)
    ranks = [i for i, (_, y) in enumerate(ordered, 1) if y]
    n1, n0 = len(ranks), len(ordered) - len(ranks)
    return (sum(ranks) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_ranking(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic")
    held = in_fold("doc_id", 5, 0)
    model = fit(rows.where(~held), rounds=120)
    got = score(rows.where(held), model).select("score", "toxic").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.93
    assert all(0 <= r.score <= 1 for r in got)


def small(spark):
    fine = "The day was fine. We went home\nand had tea. Nothing else happened here."
    rows = [(i, fine + f" Note {i}.", 0, "a", "b") for i in range(60)]
    rows += [(100 + i, fine + f" You are a scoundrel. Note {i}.", 1, "a", "b") for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_the_offending_sentence_is_located(spark):
    frame = small(spark)
    got = score(frame, fit(frame, l1=0.0)).collect()
    for r in got:
        assert (r.score >= 0.5) == bool(r.toxic)
        spans = [r.text[s["start"] : s["end"]] for s in r.offending]
        assert spans == (["You are a scoundrel."] if r.toxic else [])


def test_edges(spark):
    frame = small(spark)
    model = fit(frame, l1=0.0)
    rows = [(1, None, 0, "a", "b"), (2, "", 0, "a", "b"), (None, "word " * 50000, None, "a", "b"), (2, "", 0, "a", "b")]
    got = score(spark.createDataFrame(rows, SCHEMA), model)
    assert got.columns == ["doc_id", "text", "toxic", "score", "offending"]
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values()) and got.count() == 4
    assert score(frame.where("false"), model).collect() == []
    one_class = fit(frame.where("toxic = 0"))
    assert isinstance(one_class, ToxicityModel) and score(frame, one_class).first().score < 0.5
    assert fit(frame.where("false")).bias < 0


def test_noisy_or():
    import numpy as np

    z = np.array([-1.0, 0.5, -3.0])
    p = 1 / (1 + np.exp(-z))
    assert abs(noisy_or(z) - (1 - np.prod(1 - p))) < 1e-12
