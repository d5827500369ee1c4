"""Quality rules with adaptive thresholds.

Every text is measured in its own row.  Mergeable quantile sketches (KLL) of the measures are built
for each language and source, for each language and for all; fences by the middle half and the upper
tail of a group replace fixed cutoffs.  Small groups borrow from the next larger one.  The fences are joined
to the measures, never to the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stored

#: Symbols that are counted (fixed by the task).
SYMBOLS = "#*$%&|<>"
_SPACES = "\t\n\x0b\x0c\r"
_FEW = 48


@dataclass(frozen=True)
class Rule:
    """Rejects ``measure`` beyond ``width`` times the group's spread, at least ``floor``, above its middle half
    (and below it if ``both``).

    The spread is that of the middle half or, if greater, that from the median up to the quantile ``tail``: most
    texts have nothing of what some rules count, and their middle half is 0.  The floor lets a single
    symbol, repeated line in ten or repeated window pass in a short text of a group without any.
    """

    name: str
    measure: str
    width: float
    floor: float
    both: bool = False
    tail: float = 0.75


RULES = (
    Rule("word_length", "try_divide(word_chars, n_words)", 6.0, 0.25, True),
    Rule("symbols", "try_divide(n_symbols, n_words)", 4.0, 0.005),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", 4.0, 0.025, tail=0.9),
    Rule("repeated_words", "try_divide(n_repeat_words, n_words)", 4.0, 0.03, tail=0.9),
)


def measured(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``documents`` without the text, with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Repeated windows are found by sorting the hashes of the text's 3-word windows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in documents.columns if c != text_col]
    plain = F.translate(text, _SPACES, " " * len(_SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, _SPACES, " " * len(_SPACES))) != "")
    a = documents.select(
        *kept,
        F.filter(F.split(plain, " "), lambda x: x != "").alias("__words"),
        F.length(F.translate(plain, " ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    w = F.col("__words")
    b = a.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
    )
    done = [*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "__windows"]
    c = b.select(*done, F.sort_array("__windows").alias("__sorted"))
    n = F.size("__sorted") - 1
    twice = F.zip_with(F.slice("__sorted", 1, n), F.slice("__sorted", 2, n), lambda x, y: F.when(x == y, x))
    d = c.select(*done, F.when(n > 0, F.array_distinct(F.array_compact(twice))).otherwise(F.array().cast("array<bigint>")).alias("__twice"))
    many = F.size("__twice") > _FEW
    ordered = F.when(many, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    e = d.select(*done, "__twice", ordered.alias("__ordered"))
    s = F.col("__ordered")
    by_list = F.array_compact(F.transform("__windows", lambda h, i: F.when(F.array_contains("__twice", h), i)))
    by_sort = F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))
    at = F.when(F.size("__twice") == 0, F.array().cast("array<int>")).when(many, by_sort).otherwise(by_list)
    f = e.select(*done, at.alias("__at"))
    p = F.col("__at")
    steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(F.lit(3), y - x))
    covered = F.when(F.size(p) == 0, 0).when(F.size(p) == 1, 3).otherwise(F.aggregate(steps, F.lit(3), lambda acc, x: acc + x))
    return f.select(*done[:-1], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Too short, or more than half of it repeated (fixed by the task)."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(measures: DataFrame, *, group: list[str], rules: tuple[Rule, ...] = RULES, least_rows: int = 50, k: int = 200) -> DataFrame:
    """One row a (language, source): ``low_<rule>``, ``high_<rule>``.

    A group of under ``least_rows`` rows takes its language's fences, a language of as few those of all rows.
    """
    first, second = group
    sketched = measures.where("n_words > 0").select(
        F.coalesce(F.col(first).cast("string"), F.lit("")).alias("g1"), F.coalesce(F.col(second).cast("string"), F.lit("")).alias("g2"), *[F.expr(r.measure).cast("double").alias(r.name) for r in rules]
    )
    sums = [F.count(F.lit(1)).alias("rows"), *[F.kll_sketch_agg_double(r.name, k).alias(r.name) for r in rules]]

    def bounds(df: DataFrame, suffix: str) -> DataFrame:
        out = []
        for r in rules:
            low, middle, high, tail = (F.kll_sketch_get_quantile_double(r.name, F.lit(q)) for q in (0.25, 0.5, 0.75, r.tail))
            width = r.width * F.greatest(high - low, tail - middle, F.lit(r.floor))
            out += [(low - width if r.both else F.lit(float("-inf"))).alias(f"low_{r.name}{suffix}"), (high + width).alias(f"high_{r.name}{suffix}")]
        return df.select(*[c for c in ("g1", "g2") if c in df.columns], F.col("rows").alias(f"rows{suffix}"), *out)

    sketches = stored(sketched.groupBy("g1", "g2").agg(*sums), "sketches")
    merged = [F.sum("rows").alias("rows"), *[F.kll_merge_agg_double(r.name, F.lit(k)).alias(r.name) for r in rules]]
    both = bounds(sketches, "_2")
    language = bounds(sketches.groupBy("g1").agg(*merged), "_1")
    total = bounds(sketches.groupBy().agg(*merged), "_0").first()
    names = [f"{side}_{r.name}" for r in rules for side in ("low", "high")]

    def best(name: str) -> Column:
        last = F.lit(float(total[f"{name}_0"]) if total["rows_0"] else 0.0)
        return F.when(F.col("rows_2") >= least_rows, F.col(f"{name}_2")).when(F.col("rows_1") >= least_rows, F.col(f"{name}_1")).otherwise(last).alias(name)

    return both.join(language, "g1").select("g1", "g2", *[best(x) for x in names])


def judge(documents: DataFrame, *, text_col: str = "text", language_col: str = "lang", source_col: str = "source", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of ``documents`` but the text, the measures, ``base_failed``, ``failed_rules`` and ``kept``.

    Null and empty texts have no words and fail the base rule; null languages and sources are groups of
    their own; repeated rows count as often as they occur; an empty table gives no rows; input columns
    named like a measure are replaced.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept", "g1", "g2"]
    rows = stored(measured(documents.drop(*own), text_col=text_col), "measures")
    if rows.isEmpty():
        limits = None
    else:
        limits = fences(rows.where(~base_failed()), group=[language_col, source_col], rules=rules)
    keyed = rows.withColumn("g1", F.coalesce(F.col(language_col).cast("string"), F.lit(""))).withColumn("g2", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    keyed = keyed.withColumn("base_failed", base_failed())
    if limits is None:
        return keyed.withColumn("failed_rules", F.array().cast("array<string>")).withColumn("kept", ~F.col("base_failed")).drop("g1", "g2")
    joined = keyed.join(limits, ["g1", "g2"], "left")
    failed = [F.when(~F.expr(f"coalesce({r.measure} BETWEEN low_{r.name} AND high_{r.name}, true)"), F.lit(r.name)) for r in rules]
    out = joined.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("g1", "g2", *[f"{side}_{r.name}" for r in rules for side in ("low", "high")])
