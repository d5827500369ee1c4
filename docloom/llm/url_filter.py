"""URL filtering by the ratio of two character language models.

Smoothed variable-order Markov models are trained on accepted and on rejected URLs.  A URL's score
is the difference of its log likelihoods for each character; the threshold is calibrated on
accepted URLs that the models were not trained on.  Listed rules come first.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_arrow, stored, with_arrow_columns

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (host, path, verdict) that fits, as struct<rule, verdict>; else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.  Of equally
    long rules the first listed wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _spelled(url: str | None) -> str:
    """The URL without scheme, lower-cased host and all, with a start and an end mark."""
    rest = (url or "").partition("://")
    return "\x02" + (rest[2] if rest[1] else rest[0]).translate(_ASCII_LOWER) + "\x03"


def _substrings(text: str, order: int) -> list[str]:
    return [text[max(0, i - k) : i + 1] for i in range(1, len(text)) for k in range(min(i, order) + 1)]


@dataclass
class UrlModel:
    """``delta`` maps a context and the character after it to log P_accepted - log P_rejected, ``back`` a context to
    the same difference of what the two models pass on to the next shorter context.

    A model too large to be sent has them in ``table`` (gram, delta) and ``contexts`` (context, back) instead.
    """

    order: int
    delta: dict[str, float]
    back: dict[str, float]
    threshold: float
    table: DataFrame | None = None
    contexts: DataFrame | None = None

    def score(self, url: str | None) -> float:
        """Length-normalised log likelihood difference: each character by the longest context that it is known in, and
        what longer contexts pass on."""
        text, total, delta, back = _spelled(url), 0.0, self.delta, self.back
        for i in range(1, len(text)):
            for k in range(min(i, self.order), -1, -1):
                found = delta.get(text[i - k : i + 1])
                if found is not None:
                    total += found
                    break
                total += back.get(text[i - k : i], 0.0)
        return total / (len(text) - 1)


def _seen(counts: dict[str, int]) -> tuple[Counter, Counter]:
    """How often each context occurs, and with how many different characters after it."""
    seen, kinds = Counter(), Counter()
    for gram, n in counts.items():
        seen[gram[:-1]] += n
        kinds[gram[:-1]] += 1
    return seen, kinds


def _log_probabilities(counts: dict[str, int], alphabet: int, order: int, grams: list[str]) -> dict[str, float]:
    """Witten-Bell: P(c | ctx) = (n(ctx c) + t(ctx) P(c | shorter ctx)) / (n(ctx) + t(ctx)); P(c | shorter ctx) after an unseen one."""
    seen, kinds = _seen(counts)
    out: dict[str, float] = {}
    for gram in sorted(grams, key=len):
        context, shorter = gram[:-1], out.get(gram[1:], 1.0 / alphabet) if len(gram) > 1 else 1.0 / alphabet
        n, t = seen.get(context, 0), kinds.get(context, 0)
        out[gram] = (counts.get(gram, 0) + t * shorter) / (n + t) if n else shorter
    return out


def _in_memory(counted: list[tuple[str, int, int]], alphabet: int, order: int) -> tuple[dict[str, float], dict[str, float]]:
    """``delta`` and ``back`` of (gram, a, r)."""
    sides = [{x[0]: x[i] for x in counted if x[i]} for i in (1, 2)]
    p, q = (_log_probabilities(side, alphabet, order, [x[0] for x in counted]) for side in sides)
    back: dict[str, float] = {}
    for sign, side in zip((1, -1), sides, strict=True):
        seen, kinds = _seen(side)
        for context, n in seen.items():
            back[context] = back.get(context, 0.0) + sign * float(np.log(kinds[context] / (n + kinds[context])))
    return {g: float(np.log(p[g]) - np.log(q[g])) for g in p}, back


def _as_tables(counted: DataFrame, alphabet: int, order: int) -> tuple[DataFrame, DataFrame]:
    """(gram, delta) and (context, back) of all ``counted`` (gram, a, r): :func:`_in_memory` as joins, from short to long."""
    size = F.length("gram")
    rows = counted.select("gram", "a", "r", size.alias("k"), F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), F.expr("substring(gram, 2)").alias("shorter"))
    totals = stored(rows.groupBy("context").agg(F.sum("a").alias("n_a"), F.count_if(F.col("a") > 0).alias("t_a"), F.sum("r").alias("n_r"), F.count_if(F.col("r") > 0).alias("t_r")), "totals")
    rows = stored(rows.join(totals, "context"), "contexts")
    shares = [F.when(F.col(f"n_{s}") > 0, F.log(F.col(f"t_{s}") / (F.col(f"n_{s}") + F.col(f"t_{s}")))).otherwise(0.0) for s in ("a", "r")]
    levels, shorter = [], None
    for k in range(1, order + 2):
        level = rows.where(F.col("k") == k)
        if shorter is None:
            level = level.withColumns({"p_a": F.lit(1.0 / alphabet), "p_r": F.lit(1.0 / alphabet)})
        else:
            level = level.join(shorter.select(F.col("gram").alias("shorter"), F.col("q_a").alias("p_a"), F.col("q_r").alias("p_r")), "shorter")
        smoothed = [F.when(F.col(f"n_{s}") > 0, (F.col(s) + F.col(f"t_{s}") * F.col(f"p_{s}")) / (F.col(f"n_{s}") + F.col(f"t_{s}"))).otherwise(F.col(f"p_{s}")).alias(f"q_{s}") for s in ("a", "r")]
        shorter = stored(level.select("gram", *smoothed), "probabilities")
        levels.append(shorter.select("gram", (F.log("q_a") - F.log("q_r")).alias("delta")))
    return reduce(DataFrame.unionByName, levels), totals.select("context", (shares[0] - shares[1]).alias("back"))


def fit(labelled: DataFrame, *, url_col: str = "url", verdict_col: str = "verdict", order: int = 5, max_grams: int = 400_000, false_blocks: float = 0.01) -> UrlModel:
    """Models from every row whose verdict is allow or block; others teach nothing.

    Each distinct URL counts once.  Four fifths of the URLs (by hash) train, the rest calibrate: the
    threshold is the score below which at most ``false_blocks`` of the held-out accepted URLs lie.
    Counts are summed by Spark, and every substring stays in the model: up to ``max_grams`` of them
    are gathered and sent to tasks, more stay a table that URLs are joined to.  If either side
    has no URL, nothing is blocked.
    """
    rows = labelled.where(F.col(verdict_col).isin("allow", "block") & F.col(url_col).isNotNull())
    rows = rows.select(F.col(url_col).alias("url"), (F.col(verdict_col) == "allow").alias("accepted")).distinct()
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0

    def count(batches):
        sums = {True: Counter(), False: Counter()}

        def flush():
            for accepted, found in sums.items():
                if found:
                    grams, n = zip(*found.items(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array([accepted] * len(n)), pa.array(n, pa.int64())], names=["gram", "accepted", "n"])
                    found.clear()

        for batch in batches:
            for url, accepted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[accepted].update(_substrings(_spelled(url), order))
            if sum(map(len, sums.values())) > 500_000:
                yield from flush()
        yield from flush()

    counted = map_arrow(rows.where(~held), count, "gram string, accepted boolean, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r")
    )
    counted = stored(counted, "substrings")
    size = counted.agg(F.count(F.lit(1)).alias("grams"), F.sum("a").alias("a"), F.sum("r").alias("r"), F.count_if(F.length("gram") == 1).alias("letters")).first()
    if not size["a"] or not size["r"]:
        return UrlModel(order, {}, {}, -1.0)
    alphabet = size["letters"] + 1
    if size["grams"] > max_grams:
        deltas, backs = _as_tables(counted, alphabet, order)
        model = UrlModel(order, {}, {}, -1.0, stored(deltas, "model"), stored(backs, "contexts"))
    else:
        model = UrlModel(order, *_in_memory([(r["gram"], r["a"], r["r"]) for r in counted.collect()], alphabet, order), -1.0)
    scored = score(rows.where(held & F.col("accepted")), model)
    low = scored.agg(F.expr(f"percentile_approx(url_score, {false_blocks}, 100000)").alias("low")).first()["low"]
    model.threshold = min(0.0, low) if low is not None else 0.0
    return model


def _joined_score(urls: DataFrame, model: UrlModel, url_col: str) -> DataFrame:
    """The scores of :meth:`UrlModel.score` by joins: each distinct run of up to ``order`` + 1 characters is
    looked up once, with all its ends and their contexts, and every distinct URL adds up its runs in their order."""
    order, url = model.order, F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    rows = urls.withColumn("__text", F.concat(F.lit("\x02"), F.translate(rest, _UPPER, _LOWER), F.lit("\x03")))
    kept = [F.col(f"`{c}`") for c in urls.columns if c != "url_score"]
    texts = stored(rows.select("__text").distinct().select(F.monotonically_increasing_id().alias("id"), F.col("__text").alias("text")), "texts")

    def cut(batches):
        names = ["id", "at", "run"]
        for batch in batches:
            ids, places, runs = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(1, len(text)):
                    ids.append(i)
                    places.append(k)
                    runs.append(text[max(0, k - order) : k + 1])
                    if len(ids) >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(runs)], names=names)
                        ids, places, runs = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(runs, pa.string())], names=names)

    pieces = map_arrow(texts, cut, "id long, at int, run string")
    size = F.length("run")
    ends = pieces.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), size)).alias("k"))
    ends = ends.select("run", (size - F.col("k")).alias("length"), F.expr("substring(run, k)").alias("gram"), F.expr("substring(run, k, length(run) - k)").alias("context"))
    # at most order + 1 ends of a run; the character after its longest known context, and what longer ones pass on
    looked_up = ends.join(model.table, "gram", "left").join(model.contexts, "context", "left")
    sums = looked_up.groupBy("run").agg(
        F.max(F.when(F.col("delta").isNotNull(), F.struct("length", "delta"))).alias("known"),
        F.array_sort(F.collect_list(F.when(F.col("back").isNotNull(), F.struct("length", "back")))).alias("backs"),
    )
    longer = F.filter("backs", lambda x: x["length"] > F.coalesce(F.col("known.length"), F.lit(-1)))
    found = sums.select("run", F.aggregate(longer, F.coalesce(F.col("known.delta"), F.lit(0.0)), lambda total, x: total + x["back"]).alias("delta"))
    parts = F.array_sort(F.collect_list(F.struct("at", "delta")))
    sums = pieces.join(found, "run").groupBy("id").agg(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["delta"]).alias("total"))
    scores = texts.join(sums, "id", "left").select(F.col("text").alias("__text"), (F.coalesce("total", F.lit(0.0)) / (F.length("text") - 1)).alias("__score"))
    return rows.join(scores, "__text", "left").select(*kept, F.col("__score").alias("url_score"))


def score(urls: DataFrame, model: UrlModel, *, url_col: str = "url") -> DataFrame:
    """``urls`` with ``url_score``; a null or empty URL has the score of its end mark alone."""
    if model.table is not None:
        return _joined_score(urls, model, url_col)
    sent = urls.sparkSession.sparkContext.broadcast(model)

    def make():
        known = sent.value
        return lambda column: (pa.array([known.score(x) for x in column.to_pylist()], pa.float64()),)

    return with_arrow_columns(urls, [url_col], make, "url_score double")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], *, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict, url_score``.

    The longest fitting rule decides; elsewhere the models, trained on the URLs that rules cover,
    block scores below the calibrated threshold.  Null URLs and those without '://' have empty host
    and path and fit no rule.  Rows are kept as they are; input columns of those names are replaced.
    """
    kept = urls.drop("host", "path", "rule", "verdict", "url_score") if url_col not in ("host", "path", "rule", "verdict", "url_score") else urls
    named = kept.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    ruled = named.withColumn("__rule", matched_rule(F.col("host"), F.col("path"), rules))
    model = fit(ruled.select(F.col(url_col).alias("url"), F.col("__rule.verdict").alias("verdict")))
    method = F.when(F.col("url_score") < model.threshold, "block").otherwise("allow")
    return (
        score(ruled, model, url_col=url_col)
        .withColumn("rule", F.col("__rule.rule"))
        .withColumn("verdict", F.coalesce(F.col("__rule.verdict"), method))
        .drop("__rule")
    )
