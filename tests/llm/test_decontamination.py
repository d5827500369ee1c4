"""Decontamination: block-max WAND against all scores, leaks against containment."""

import random

import numpy as np
import pytest

from docloom.llm.decontamination import Item, ItemIndex, find_leaks, halves, read_items

SCHEMA = "doc_id long, text string, leaks string, item_id string, score string"


def items(seed=1, n=300):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(2000)]
    out = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(rng.choice([3, 15, 20, 40, 60]))]
        out.append((i, words))
    return out


def test_wand_is_exact():
    made = items()
    index = ItemIndex.build([Item(i, *halves(w)) for i, w in made], shard_items=100)
    rng = random.Random(2)
    for _ in range(60):
        _, words = rng.choice(made)
        query = words + rng.choice(made)[1] + [f"c{rng.randrange(30)}" for _ in range(20)]
        terms = np.array([index.vocabulary.get(w, -1) for w in query])
        for shard in index.shards:
            scores: dict[int, float] = {}
            for t in set(terms.tolist()) - {-1}:
                for i, x in zip(shard.items.get(t, []), shard.impacts.get(t, []), strict=True):
                    scores[i] = scores.get(i, 0.0) + x
            for threshold in (0.05, 0.2, 0.5, 0.9):
                assert {i for i, _ in shard.search(terms, threshold)} == {i for i, s in scores.items() if s >= threshold - 1e-6}


def test_no_window_above_the_threshold_is_skipped():
    made = items(3)
    index = ItemIndex.build([Item(i, *halves(w)) for i, w in made])
    rng = random.Random(4)
    for _ in range(20):
        text = [f"r{rng.randrange(4000)}" if rng.random() < 0.5 else f"c{rng.randrange(30)}" for _ in range(500)]
        at = rng.randrange(400)
        text[at:at] = rng.choice(made)[1]
        terms = np.array([index.vocabulary.get(w, -1) for w in text])
        for shard in index.shards:
            searched = {first for first, _ in shard.passages(terms, 0.5)}
            for k in range(0, len(terms), shard.longest):
                if shard.search(terms[k : k + 2 * shard.longest], 0.5):
                    assert k in searched or k - shard.longest in searched


def test_leaks(spark):
    made = items(5, 120)
    rng = random.Random(6)
    noise = lambda n: [f"n{rng.randrange(5000)}" for _ in range(n)]
    rows, wanted = [], set()
    for d in range(150):
        words = noise(rng.choice([0, 5, 300, 3000]))
        if d % 3 == 0:
            item, own = rng.choice([x for x in made if len(x[1]) >= 15])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ".", ","]) for w in own]
            wanted.add((d, item))
        elif d % 3 == 1:
            own = rng.choice(made)[1]
            words += own[: len(own) // 3]  # a part of the question is no leak
        rows.append((d, rng.choice([" ", "\n", "\t"]).join(words), "a", "b", "c"))
    rows += [(1000, None, "a", "b", "c"), (1001, "", "a", "b", "c"), (None, " ".join(made[1][1]), "a", "b", "c"), (7, "x", "a", "b", "c")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in made] + [(900, None), (901, "?!")], "item_id long, text string")
    got = find_leaks(spark.createDataFrame(rows, SCHEMA), read_items(bench))
    assert got.columns == ["doc_id", "text", "item_id", "score", "leaks"]
    found = {(r.doc_id, x["item_id"]) for r in got.collect() for x in r.leaks if len(dict(made)[x["item_id"]]) >= 15}
    assert {x for x in found if x[0] is not None} == wanted
    assert got.count() == len(rows)


def test_short_items(spark):
    made = [(n, [f"s{n}w{j}" for j in range(n)]) for n in range(1, 6)]
    rows = [(i, f"before it {' '.join(w)} after it") for i, w in made] + [(100, " ".join(f"z{j}" for j in range(40)))]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), [Item(i, *halves(w)) for i, w in made]).collect()
    assert {(r.doc_id, x["item_id"]) for r in got for x in r.leaks} == {(i, i) for i, _ in made}
    answers = [(1, "what is the capital of france", "Paris"), (2, "who wrote of the white whale", "Herman Melville"), (3, "why", "because the old river runs low")]
    bench = spark.createDataFrame(answers, "item_id long, text string, answer string")
    rows = [(i, f"asked {q}? {a}. so it went") for i, q, a in answers] + [(100 + i, f"asked {q}? so it went") for i, q, _ in answers[:2]]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), read_items(bench, answer_col="answer")).collect()
    assert {(r.doc_id, x["item_id"]) for r in got for x in r.leaks} == {(i, i) for i, *_ in answers}


@pytest.mark.parametrize("space", ["\x0b", "\x0c", "\r", "\t", "\n"])
def test_all_white_space_parts_words(spark, space):
    words = [f"p{j}" for j in range(20)]
    rows = spark.createDataFrame([(1, "so" + space + space.join(words) + space + "on")], "doc_id long, text string")
    assert [x["item_id"] for x in find_leaks(rows, [Item(7, *halves(words))]).first().leaks] == [7]


def test_edges(spark):
    frame = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(frame, read_items(none)).first().leaks == []
    assert find_leaks(frame.where("false"), [Item(1, ["a"], ["b"])]).collect() == []
    with pytest.raises(ValueError, match="bytes"):
        read_items(spark.createDataFrame([(1, "x" * 100)], "item_id long, text string"), max_bytes=10)
    answers = spark.createDataFrame([(1, "what is it", "a thing")], "item_id long, text string, answer string")
    assert read_items(answers, answer_col="answer") == [Item(1, ["what", "is", "it"], ["a", "thing"])]


def test_parts_find_the_same(spark):
    made = [Item(i, *halves(w)) for i, w in items(8, 200)]
    rng = random.Random(9)
    rows = [(d, " ".join(w for x in rng.sample(made, 3) for w in x.question + x.answer), "leaks of before") for d in range(60)] + [(60, None, None), (61, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    whole = find_leaks(frame, made)
    parted = find_leaks(frame, [*made, made[5]], part_words=700)
    assert len(list(ItemIndex.parts(made, part_words=700))) == 3  # length classes of 4 to 6 bits, shorter items with the first
    ids = [{(r.doc_id, x["item_id"]) for r in t.collect() for x in r.leaks} for t in (whole, find_leaks(frame, made, part_words=700), parted)]
    assert ids[0] == ids[1] and len(ids[0]) > 100 and ids[2] >= {x for x in ids[0] if x[1] == 5}
    scores = [sorted((r.doc_id, x["item_id"], x["score"], x["first_word"]) for r in t.collect() for x in r.leaks) for t in (whole, find_leaks(frame, made, part_words=700))]
    assert scores[0] == scores[1]
    assert [r.leaks for r in whole.where("doc_id >= 60").collect()] == [[], []]


def test_an_index_grows_with_its_postings():
    import pickle

    few, many = ([Item(i, [f"w{i}x{j}" for j in range(20)], [f"v{i}x{j}" for j in range(20)]) for i in range(n)] for n in (500, 4000))
    sizes = [len(pickle.dumps(ItemIndex.build(x))) / len(x) for x in (few, many)]
    assert sizes[1] < 1.5 * sizes[0] and sizes[1] < 16_000
