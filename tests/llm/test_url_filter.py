"""URL filters: parts, rules, models."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.llm.queries import URL_RULES
from docloom.llm.url_filter import fit, judge, matched_rule, score, url_host, url_path

CASES = {
    "http://WWW.Example.org/en/1?x": ("www.example.org", "/en/1", "example.org/en/1", "block"),
    "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://a.b.example.org/es/x#y": ("a.b.example.org", "/es/x", "example.org/es/", "block"),
    "ftp://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "ftp://x.com/FR/": ("x.com", "/FR/", None, None),
    "http://x.com?/fr/": ("x.com", "", None, None),
    "http://É.COM/de/": ("É.com", "/de/", "com/de/", "block"),
    "http://a://b/c": ("a:", "//b/c", None, None),
    "no scheme.com/fr/": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "http://org": ("org", "", None, None),
    "http://org/": ("org", "/", "org/", "allow"),
}


def test_parts_and_rules(spark):
    rows = spark.createDataFrame([(u,) for u in CASES], "url string")
    host, path = F.coalesce(url_host(F.col("url")), F.lit("")), F.coalesce(url_path(F.col("url")), F.lit(""))
    for r in rows.select("url", host.alias("h"), path.alias("p"), matched_rule(host, path, URL_RULES).alias("m")).collect():
        assert (r.h, r.p, r.m and r.m.rule, r.m and r.m.verdict) == CASES[r.url]


def urls(n, seed=1):
    rng = random.Random(seed)
    good = ["http://news.org/" + "".join(rng.choices("aeioustr", k=10)) + f"/{i}" for i in range(n)]
    bad = [f"http://win-{rng.randint(0, 99)}-casino.com/de/bonus-{''.join(rng.choices('xqzw$-', k=10))}{i}" for i in range(n)]
    return good, bad


def test_models_tell_urls_apart(spark):
    good, bad = urls(300)
    rules = [("org", "/", "allow"), ("com", "/de/", "block")]
    more_good, more_bad = (["http://paper.net/" + u.split("/", 3)[3] for u in urls(80, 2)[0]], [u.replace(".com/de/", ".net/en/") for u in urls(80, 3)[1]])
    rows = [(i, u, "c", "d", "e") for i, u in enumerate(good + bad + more_good + more_bad)]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string, url_score string"), rules).collect()}
    verdicts = [got[i] for i in range(len(rows))]
    assert verdicts[:300] == ["allow"] * 300 and verdicts[300:600] == ["block"] * 300
    assert verdicts[600:680].count("allow") >= 76 and verdicts[680:].count("block") >= 76


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "http://x.net/" + "a" * 100_000), (3, "http://y.org/"), (3, "http://y.org/")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got) == [("1", "", "allow"), ("2", "", "allow"), ("3", "y.org", "allow"), ("3", "y.org", "allow"), ("None", "x.net", "allow")]
    assert judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []


def test_probabilities_sum_to_one():
    from docloom.llm.url_filter import _log_probabilities, _substrings

    counts: dict[str, int] = {}
    for text in ("\x02abab\x03", "\x02abc\x03", "\x02ba\x03"):
        for g in _substrings(text, 2):
            counts[g] = counts.get(g, 0) + 1
    alphabet = sorted({g for g in counts if len(g) == 1})
    grams = list(counts) + [c + x for c in ("a", "b") for x in alphabet if c + x not in counts]
    p = _log_probabilities(counts, len(alphabet), 2, grams)
    assert sum(p[x] for x in alphabet) == pytest.approx(1)
    assert sum(p["a" + x] for x in alphabet) == pytest.approx(1)


def test_one_side_only(spark):
    rows = spark.createDataFrame([("http://a.org/", "allow")], "url string, verdict string")
    assert score(rows, fit(rows)).first().url_score == 0.0


def test_a_model_too_large_to_send_is_whole(spark):
    good, bad = urls(60)
    rows = [(u, "allow") for u in good] + [(u, "block") for u in bad] + [("http://É-日本.org/x", "allow")]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    asked = spark.createDataFrame([(u, 0.0) for u, _ in rows] + [(None, 0.0), ("", 0.0), ("no scheme", 0.0), ("ftp://Ω.net/ÄÖ?q://r", 0.0), (good[0], 0.0)], "url string, url_score double")
    small, large = fit(labelled), fit(labelled, max_grams=50)
    assert large.table.count() == len(small.delta) > 50
    assert {r.gram: r.delta for r in large.table.collect()} == pytest.approx(small.delta, abs=1e-12)
    assert large.threshold == pytest.approx(small.threshold, abs=1e-12)
    key = lambda r: (str(r.url), r.url_score)
    got, wanted = sorted(score(asked, large).collect(), key=key), sorted(score(asked, small).collect(), key=key)
    assert [r.url for r in got] == [r.url for r in wanted]
    assert [r.url_score for r in got] == pytest.approx([r.url_score for r in wanted], abs=1e-12)


def recursed(text, counts, alphabet, order):
    """Log likelihood of each character after the first, by the recursion."""
    import math

    def p(context, c):
        after = {g[-1]: n for g, n in counts.items() if g[:-1] == context}
        shorter = p(context[1:], c) if context else 1 / alphabet
        n, t = sum(after.values()), len(after)
        return (after.get(c, 0) + t * shorter) / (n + t) if n else shorter

    return sum(math.log(p(text[max(0, i - order) : i], text[i])) for i in range(1, len(text)))


def test_scores_are_log_likelihood_differences(spark):
    from collections import Counter

    from docloom.llm.url_filter import _spelled, _substrings

    good, bad = urls(25)
    labelled = spark.createDataFrame([(u, "allow") for u in good] + [(u, "block") for u in bad], "url string, verdict string")
    trained = {(r.url, r.verdict) for r in labelled.where(F.pmod(F.xxhash64("url"), F.lit(5)) != 0).collect()}
    counts = {v: Counter(g for u, x in trained if x == v for g in _substrings(_spelled(u), 3)) for v in ("allow", "block")}
    alphabet = len({g for c in counts.values() for g in c if len(g) == 1}) + 1
    texts = [good[0], bad[1], "http://news.org/Ωq$-casino", "ftp://win-aeiou.net/de/", "", "a://news.news.news", "x://bonus-xqz"]
    wanted = {u: (recursed(_spelled(u), counts["allow"], alphabet, 3) - recursed(_spelled(u), counts["block"], alphabet, 3)) / (len(_spelled(u)) - 1) for u in texts}
    asked = spark.createDataFrame([(u,) for u in texts], "url string")
    for model in (fit(labelled, order=3), fit(labelled, order=3, max_grams=10)):
        assert {r.url: r.url_score for r in score(asked, model).collect()} == pytest.approx(wanted, abs=1e-9)
