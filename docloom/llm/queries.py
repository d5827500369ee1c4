"""The queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    from docloom.llm.packing import pack

    pieces = pack(documents, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "seed_doc_id",
    )


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}


def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.common import in_fold
    from docloom.llm.language_id import fit, identify

    documents = table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 4, 2)
    model = fit(documents.where(~held_out))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.common import fits_broadcast, in_fold
    from docloom.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 5, 0)
    labels = table(spark, sf_dir, "labels").where(~held_out & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if fits_broadcast(labels, 64, 32 << 20):
        labels = F.broadcast(labels)
    model = fit(documents.select("doc_id", "text").join(labels, "doc_id"))
    found = score(documents.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending"
    )


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.common import fits_broadcast
    from docloom.llm.quality_classifier import fit, gumbel_top_k, weigh

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    targets = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    if fits_broadcast(targets, 64, 32 << 20):
        targets = F.broadcast(targets)
    weighted = weigh(documents, fit(documents, targets))
    return gumbel_top_k(weighted.select("doc_id", "log_weight", "n_features"), 0.9)


#: Fixed by the task: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.url_filter import judge

    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "url_score")


def op6_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.sharding import shard

    placed, _ = shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.secret_scan import joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["strong"])
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op8_benchmark_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontamination import find_leaks, read_items

    items = read_items(table(spark, sf_dir, "benchmark"))
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return found.select("doc_id", F.inline("leaks"))
