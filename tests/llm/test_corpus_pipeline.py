"""The corpus pipeline on planted documents, and the registered queries' columns."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_ten_queries_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    first = documents.orderBy("doc_id").limit(40).collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()
    clean = next(r for r in first if len(r.text) > 1500 and r.lang == "en")
    rows = [
        (900001, clean.text, "en", "s", 1),  # an exact copy
        (900002, clean.text + " Added.", "en", "s", 1),  # a near copy
        (900003, "The the and of " * 30 + items[3].text + " and that of the in " * 20, items[3].text and "en", "s", 1),
        (900004, 'The thing of the and that. password = "hunter2abc" The and in that of.', "en", "s", 1),
        (900005, None, None, None, None),
        (900006, "12345 !!! 678", "en", "s", 1),
        (900007, "The thing and the other that of in.", None, None, None),
    ]
    schema = documents.select("doc_id", "text", "lang", "source", "n_chars").schema
    documents.select(schema.names).unionByName(spark.createDataFrame(rows, schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    stages, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = stages[name] = spark.read.parquet(f"{folder}/{name}")
    return folder, clean, stages


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, planted):
    folder, clean, stages = planted
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before = ids(spark.read.parquet(f"{folder}/documents.parquet"))
    assert before - ids(stages["language_id"]) == {900005, 900006}
    dropped = ids(stages["language_id"]) - ids(stages["near_duplicates"])
    assert {900001, 900002} <= dropped and clean.doc_id not in dropped
    leaked = ids(stages["near_duplicates"]) - ids(stages["decontamination"])
    assert 900003 in leaked and 900004 not in leaked
    assert ids(stages["secrets"]) == ids(stages["decontamination"])
    row = stages["secrets"].where("doc_id = 900004").first()
    assert "hunter2abc" not in row.text and row.text.startswith("The thing") and row.n_chars == len(row.text)
    assert 900007 in ids(stages["secrets"])


def test_packed_whole(spark, planted):
    _, _, stages = planted
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sums = {}
    for r in stages["packing"].collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    wanted = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages["secrets"].collect()}
    assert sums == wanted


def test_run_is_the_stages(spark, planted):
    folder, _, stages = planted
    assert ids(corpus_pipeline.run(spark, folder)) == ids(stages["packing"])
