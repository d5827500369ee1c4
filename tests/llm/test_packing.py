"""Packing: an exact round trip of all ids."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm.packing import TokenIds, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, sequence_id string"


def texts():
    rng = random.Random(3)
    syllables = ["the", "ing", "ation", "é", "ß", "o'clock", "x1", "ÜBER", "don't", "…", "日本", "ΣΑΣ", "İ", "á", "<|endoftext|>", " ", "\x1c", "12,5", "!?", "word.", "e.g.,"]
    made = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    return [None, "", " ", "\n\n\t", "one", *made, "long " * 9000, made[0], made[0]]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_words_give_the_tokenizers_ids(tokenizer):
    fast = TokenIds(open(PATH, encoding="utf-8").read())
    assert fast.by_piece
    for text in filter(None, texts()):
        assert np.frombuffer(fast.text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("window", "shard"), [(4096, 1024), (64, 8)])
def test_round_trip(spark, tokenizer, window, shard):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts())] + [(None, "no id", "", "")]
    found = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, window=window, shard_docs=shard).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text, *_ in rows:
        wanted = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        got = []
        for p in pieces:
            assert p.start == len(got) and p.doc_tokens == len(wanted)
            got += np.frombuffer(p.ids, "<u4").tolist()
        assert got == wanted
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding


def test_neighbours_share_words(spark):
    def text(topic, k):
        return " ".join(f"{topic}{j}" for j in range(k, k + 20))

    rows = [(i, text("alpha" if i % 2 else "omega", i % 3)) for i in range(40)]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, window=256, shard_docs=64).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r.doc_id % 2)
    same = [max(s.count(0), s.count(1)) / len(s) for s in sequences.values() if len(s) > 2]
    assert sum(same) / len(same) > 0.8


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
