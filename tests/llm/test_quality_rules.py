"""Measures against plain Python; thresholds that follow their group."""

import random
import re
from collections import Counter

from docloom.llm.quality_rules import judge, measured

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, g1 string"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times, covered, seen, repeats = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), repeats, len(covered)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "x", "y", "z") for i, t, lang, src in rows], SCHEMA)


def test_measures(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        vocabulary = [f"w{j}" for j in range(rng.choice([2, 5, 20, 400]))] + ["é#", "|", "日本", "<b>"]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n", "\n \n"]) for w in rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 10, 300, 900])))
        rows.append((i, text, "en", "s"))
    rows += [(900, None, None, None), (901, "", "en", None), (902, "a b c a b c", None, "s"), (902, "a b c a b c", None, "s"), (903, "same line\n" * 3000, "en", "s"), (904, " ".join(f"u{i % 7000}" for i in range(20000)), "en", "s")]
    got = measured(frame(spark, rows).drop("n_words", "kept", "g1")).collect()
    found = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == sorted((i, *brute(t)) for i, t, *_ in rows)


def test_thresholds_follow_the_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(3, 8)))
    prose = lambda: " ".join(word() for _ in range(80))
    code = lambda: " ".join(word() + ("#" if rng.random() < 0.5 else "") for _ in range(80))
    rows = [(i, prose(), "en", "news") for i in range(100)] + [(1000 + i, code(), "en", "code") for i in range(100)]
    rows += [(5000, code(), "en", "news"), (5001, "short text", "en", "news"), (5002, code(), "en", "tiny"), (5003, prose(), None, None), (5004, None, None, None)]
    got = {r.doc_id: r for r in judge(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept for i in range(100)) == 100 and sum(got[1000 + i].kept for i in range(100)) == 100
    assert not got[5000].kept and list(got[5000].failed_rules) == ["symbols"]
    assert got[5001].base_failed and got[5004].base_failed and got[5003].kept


def test_repeats_beyond_a_clean_group(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    lines = lambda n: [" ".join(word() for _ in range(10)) for _ in range(n)]
    half = lambda: (lambda x: "\n".join([*x, *x[:3]]))(lines(9))
    chant = lambda: " ".join([*(word() for _ in range(70)), *("la li lu".split() * 5)])
    rows = [(i, "\n".join(lines(9)), "en", "news") for i in range(100)]
    rows += [(1000 + i, half(), "en", "songs") for i in range(40)] + [(1100 + i, "\n".join(lines(9)), "en", "songs") for i in range(60)]
    rows += [(5000, half(), "en", "news"), (5001, chant(), "en", "news")]
    got = {r.doc_id: r for r in judge(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(100)) and all(got[i].kept for i in (*range(1000, 1040), *range(1100, 1160)))
    assert "duplicate_lines" in got[5000].failed_rules and list(got[5001].failed_rules) == ["repeated_words"]


def test_empty_table(spark):
    assert judge(frame(spark, [])).collect() == []
