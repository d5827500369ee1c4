"""Near duplicates against all pairs compared."""

import random

import pytest

from docloom.llm.near_dedup import components, near_duplicates, without_near_duplicates

SCHEMA = "doc_id long, text string, label string, component_id string, digest string"


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, n, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, families=8, size=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, license_line = [], " ".join(f"license{i}" for i in range(25))
    for _ in range(families):
        base = rng.choices(words, k=rng.choice([5, 12, 40, 150, 400]))
        for _ in range(size):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.04, 0.06, 0.1]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy) + (" " + license_line if rng.random() < 0.4 else ""))
    rows += rows[:5] + ["", None, "  \n", "ONE", "one", "One Two", "one\x0btwo", "é É", "É é"] + [rows[0]] * 30
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "n"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, n):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, words=n, percent=80).collect()}
    assert got == brute(rows, n, 80)


def test_a_large_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(400)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    rows = [(None, "same text here"), (None, "same text here"), (5, "same text here"), (5, "same text here"), (5, "quite another one"), (6, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(frame).collect())
    assert got == [(False, 5, 5, True)] * 3 + [(False, 6, 6, True)] + [(True, 0, None, True)] * 2
    kept = without_near_duplicates(frame).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "6", "None", "None"]


def test_components_of_a_long_chain(spark):
    name = lambda i: bytearray(f"{i * 7 % 101:04d}".encode())
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(60)] + [(bytearray(b"x"), bytearray(b"y"))], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in components(edges).collect()}
    least = min(bytes(name(i)) for i in range(61))
    assert got == {bytes(name(i)): least for i in range(61)} | {b"x": b"x", b"y": b"x"}


def test_a_family_that_is_only_partly_linked(spark, monkeypatch):
    """Members too far from the center meet the others in blocks; small groups make several of each."""
    from docloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_GROUP", 64)
    monkeypatch.setattr(near_dedup, "_ASKERS", 32)
    monkeypatch.setattr(near_dedup, "_BLOCK_SHINGLES", 1000)
    asked, rng = [], random.Random(3)
    monkeypatch.setattr(near_dedup, "asked", lambda *a, f=near_dedup.asked: asked.append(1) or f(*a))
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(260):
        copy = list(base)
        for k in range(rng.randrange(8)):
            copy[rng.randrange(100)] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == brute(rows, 4, 80) and asked
    assert len({c for _, c in got.values()}) > 50


def test_texts_of_one_id_are_told_apart(spark):
    rows = [(5, "same text here"), (5, "same text here"), (5, "quite another one"), (6, "quite another one"), (7, "a third text"), (None, "a third text"), (8, None), (8, "")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, __id string, digest string")
    kept = without_near_duplicates(frame, texts_apart=True)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in [rows[0], rows[2], rows[4], rows[5], rows[6], rows[7]])
    assert without_near_duplicates(frame.limit(0), texts_apart=True).collect() == []
