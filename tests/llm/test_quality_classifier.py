"""Importance resampling: weights, exact top k."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm.quality_classifier import Features, fit, gumbel_top_k, weigh

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, log_weight string, kept string, gumbel_key string"


def test_weights_are_log_ratios(spark):
    rows = [(1, "a b a", "x", "y", "z"), (2, "c d", "x", "y", "z"), (3, None, "x", "y", "z"), (None, "", "x", "y", "z"), (1, "a b a", "x", "y", "z")]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = fit(frame, spark.createDataFrame([(1,)], "doc_id long"), buckets=500)
    features = Features(500)
    raw, target = np.ones(500), np.ones(500)
    for i, text, *_ in rows:
        for b in features.of(text):
            raw[b] += 1
            target[b] += i == 1
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model.log_ratio, ratio)
    got = weigh(frame, model)
    assert got.columns == ["doc_id", "text", "kept", "gumbel_key", "log_weight", "n_features"]
    assert all(np.isclose(r.log_weight, ratio[features.of(r.text)].sum()) for r in got.collect())
    assert weigh(frame.where("false"), model).collect() == []
    assert not fit(frame, spark.createDataFrame([], "doc_id long")).log_ratio.any()


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    weights = [(i, float(w)) for i, w in enumerate(np.r_[rng.normal(0, 3, 3000), rng.normal(0, 1e-6, 500), [1e9, -1e9, 0.0]])]
    frame = spark.createDataFrame(weights, "doc_id long, log_weight double")
    for share in (0.0, 0.001, 0.3, 0.9, 1.0):
        got = gumbel_top_k(frame, share).collect()
        kept = [r.gumbel_key for r in got if r.kept]
        assert len(kept) == round(share * len(got))
        assert not kept or len(kept) == len(got) or min(kept) >= max(r.gumbel_key for r in got if not r.kept) - 1e-6
    again = {r.doc_id: r.kept for r in gumbel_top_k(frame.repartition(5), 0.3).collect()}
    assert again == {r.doc_id: r.kept for r in gumbel_top_k(frame, 0.3).collect()}


def test_ties_stay_together(spark):
    frame = spark.createDataFrame([(1, 0.5)] * 6 + [(2, 9.0)], "doc_id long, log_weight double")
    got = [(r.doc_id, r.kept) for r in gumbel_top_k(frame, 0.5).collect()]
    assert len(got) == 7 and len({k for i, k in got if i == 1}) == 1
    assert gumbel_top_k(frame.where("false"), 0.5).collect() == []


def test_noise_is_gumbel(spark):
    frame = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("log_weight"))
    key = np.array([r.gumbel_key for r in gumbel_top_k(frame, 0.5).collect()])
    assert abs(key.mean() - 0.5772) < 0.03 and abs(key.std() - 1.2825) < 0.03


def test_good_texts_are_kept(spark):
    from docloom.llm.queries import op4_importance_resampling

    got = op4_importance_resampling(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97
    above = sum(g.log_weight > b.log_weight for g in good for b in bad)
    assert above / (len(good) * len(bad)) > 0.95
