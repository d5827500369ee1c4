"""Exact statistics of runs, sweeps and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(values: DataFrame, value: str, *key: str) -> DataFrame:
    """min, median, p95, max to two decimals (half to even) and the number of samples; percentiles interpolate."""
    v = F.col(value)
    found = (("min", F.min(v)), ("median", F.median(v)), ("p95", F.percentile(v, 0.95)), ("max", F.max(v)))
    out = values.groupBy(*key).agg(*[F.coalesce(c, F.lit(0.0)).alias(f"raw_{n}") for n, c in found], F.count(v).alias("samples"))
    alone = F.col("samples") == 1  # a single sample stays as it is
    return out.select(*key, *[F.when(alone, F.col(f"raw_{n}")).otherwise(F.bround(f"raw_{n}", 2)).alias(n) for n, _ in found], "samples")


def spread_summary(values: DataFrame, value: str, *key: str) -> DataFrame:
    """min, max and median to one decimal."""
    v = F.col(value)
    return values.groupBy(*key).agg(F.bround(F.min(v), 1).alias("min"), F.bround(F.max(v), 1).alias("max"), F.bround(F.median(v), 1).alias("median"))


def last_per_stage(log: DataFrame) -> DataFrame:
    """``elapsed`` of each (pdf, stage): that of the last line counts."""
    return log.groupBy("pdf", "stage").agg(F.max_by("elapsed", "seq").alias("elapsed"))


def _ranges(rows: DataFrame, key: str, index: str, what: Column, span: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``__range`` of their index and ``__before``: the sum of ``what`` over the key's earlier ranges.

    A key's rows so lie in many tasks, and only one row a range is put in order.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(index) / span))
    by = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "__range").agg(what.alias("__sum"))
    return ranged.join(sums.select(key, "__range", F.sum("__sum").over(by).alias("__before")), [key, "__range"]), [key, "__range"]


def numbered(rows: DataFrame, *, key: str, index: str, out: str = "idx", span: int = 1 << 16) -> DataFrame:
    """``out``: the row's place from 1 in its key by the numeric ``index``."""
    ranged, group = _ranges(rows, key, index, F.count(F.lit(1)), span)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(index)).cast("long")
    return ranged.withColumn(out, F.coalesce("__before", F.lit(0)) + place).drop("__range", "__before")


def cumulative(runs: DataFrame, *, arm: str = "arm", index: str = "idx", value: str = "wall", out: str = "total", span: int = 1 << 16) -> DataFrame:
    """Running sum along each arm, by ranges of the index."""
    ranged, group = _ranges(runs, arm, index, F.sum(value), span)
    window = Window.partitionBy(*group).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn(out, F.coalesce("__before", F.lit(0)) + F.sum(value).over(window)).drop("__range", "__before")


def crossover(runs: DataFrame, challenger: str, base: str, *, arm: str = "arm", index: str = "idx", value: str = "wall") -> DataFrame:
    """The first index at which the challenger's running sum is below the base's; null if it never is."""
    sums = cumulative(runs, arm=arm, index=index, value=value)
    a = sums.where(F.col(arm) == challenger).select(index, F.col("total").alias("a"))
    b = sums.where(F.col(arm) == base).select(index, F.col("total").alias("b"))
    return a.join(b, index).agg(F.min(F.when(F.col("a") < F.col("b"), F.col(index))).alias("crossover"))


def extremes(runs: DataFrame, *, key: str, value: str, order: str) -> DataFrame:
    """Fastest and slowest row of each key, the first in ``order`` of equal ones, and their ratio."""
    fast, slow = F.min_by(F.struct(order, value), F.struct(F.col(value), F.col(order))), F.max_by(F.struct(order, value), F.struct(F.col(value), -F.col(order)))
    out = runs.groupBy(key).agg(fast.alias("f"), slow.alias("s"))
    return out.select(
        key,
        F.col("f")[order].alias("fastest"),
        F.col("f")[value].alias("fastest_value"),
        F.col("s")[order].alias("slowest"),
        F.col("s")[value].alias("slowest_value"),
        (F.col("s")[value] / F.greatest(F.col("f")[value], F.lit(1e-9))).alias("spread"),
    )


def speedup(runs: DataFrame, *, key: str, value: str) -> DataFrame:
    """Each row's factor over the slowest of its key."""
    return runs.withColumn("speedup", F.max(value).over(Window.partitionBy(key)) / F.col(value))


def level_summary(calls: DataFrame) -> DataFrame:
    """Calls (``level, ok, client_s, server_s, wall_s``) by level, to three decimals: the server's time and its percentiles,
    the client's median, what a call waits beside the server's work, good calls a minute.  A level without good calls has zeros."""
    good = F.col("ok")
    server, client = F.when(good, F.col("server_s")), F.when(good, F.col("client_s"))
    wait = F.when(good, F.greatest(F.col("client_s") - F.col("server_s"), F.lit(0.0)))
    said = {
        "median_s": F.median(server),
        "p95_s": F.percentile(server, 0.95),
        "p99_s": F.percentile(server, 0.99),
        "client_median_s": F.median(client),
        "queue_wait_s": F.median(wait),
        "wall_s": F.max("wall_s"),
    }
    out = calls.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_clients"), F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"), *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in said.items()]
    )
    out = out.withColumn("per_minute", F.when(F.col("wall_s") > 0, F.col("n_ok") / F.col("wall_s") * 60).otherwise(0.0))
    failed = F.col("n_ok") == 0
    return out.withColumns({n: F.bround(n, 3) for n in (*said, "per_minute")}).withColumns({"status": F.when(failed, "error").otherwise("ok"), "error": F.when(failed, "all clients failed").otherwise("")})


def cost_each(runs: DataFrame, *, size: str = "size", wall: str = "wall_s", parsed: Column | None = None) -> DataFrame:
    """By size: milliseconds an entry of the median run, and the entries that were parsed."""
    ms = F.when(F.col(size) > 0, F.col(wall) / F.col(size) * 1000)
    return runs.groupBy(size).agg(F.median(ms).alias("ms_each"), F.count_if(F.lit(True) if parsed is None else parsed).alias("parsed"), F.count(F.lit(1)).alias("runs"))


def arms(runs: DataFrame, arm: str = "arm") -> DataFrame:
    """The distinct arms with their place in sorted order, from 0."""
    names = runs.select(arm).where(F.col(arm).isNotNull()).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(arm)) - 1)  # one row an arm


def by_arm(runs: DataFrame, *, arm: str = "arm", index: str = "idx", block: int = 1000) -> DataFrame:
    """Each arm's indexes in lists by ranges of ``block``: no list grows with the input."""
    rows = runs.groupBy(F.col(arm).alias("arm"), F.floor(F.col(index) / block).alias("block"))
    return rows.agg(F.array_sort(F.collect_list(index)).alias("indexes"))


def first_last(runs: DataFrame, *, arm: str, index: str, value: str) -> DataFrame:
    """First and last value along each arm and their difference."""
    out = runs.groupBy(arm).agg(F.min_by(value, index).alias("first"), F.max_by(value, index).alias("last"))
    return out.withColumn("delta", F.col("last") - F.col("first"))


def with_total(rows: DataFrame, *, name: str, value: str, last: list[str], order: str) -> DataFrame:
    """Adds a row 'total': the sum of ``value``, the last value of ``last``."""
    total = rows.agg(F.lit("total").alias(name), F.sum(value).alias(value), *[F.max_by(c, order).alias(c) for c in last])
    return rows.drop(order).unionByName(total, allowMissingColumns=True)


def stacked(stages: DataFrame, *, key: str, name: str, value: str, order: str) -> DataFrame:
    """Running total over the stages of each key, without stages that are 0 everywhere."""
    kept = stages.join(stages.groupBy(name).agg(F.max(value).alias("__most")).where("`__most` > 0").select(name), name, "left_semi")
    return kept.withColumn("base", F.coalesce(F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def flatness(values: DataFrame, value: str, *key: str) -> DataFrame:
    """Range over the mean's size; infinite if the mean is 0."""
    v = F.col(value)
    out = values.groupBy(*key).agg(F.max(v).alias("hi"), F.min(v).alias("lo"), F.avg(v).alias("mean"))
    return out.select(*key, F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise((F.col("hi") - F.col("lo")) / F.abs("mean")).alias("flatness"))


def ordered_values(sweep: DataFrame, value: str, *key: str) -> DataFrame:
    """``place`` of each value of a knob: by number if all values of the key are numbers, else by input order ``ord``."""
    number = F.expr(f"try_cast({value} AS double)")
    numeric = F.every(number.isNotNull()).over(Window.partitionBy(*key))
    with_type = sweep.withColumn("numeric", numeric)
    order = Window.partitionBy(*key).orderBy(F.when(F.col("numeric"), number), "ord")
    return with_type.withColumn("place", F.row_number().over(order))


def out_of_memory(error: Column) -> Column:
    """Whether an error's text says that memory ran out."""
    hints = ("CUDA out of memory", "out of memory", "CUBLAS_STATUS_ALLOC_FAILED")  # fixed values
    said = F.coalesce(error, F.lit(""))
    return F.array_contains(F.array(*[said.contains(h) for h in hints]), True)


def statuses(runs: DataFrame, *key: str) -> DataFrame:
    return runs.groupBy(*key, "status").agg(F.count(F.lit(1)).alias("runs"))


def ok_and_failed(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return runs.where("status = 'ok'"), runs.where("status IS NULL OR status <> 'ok'")


#: Presets of several knobs (fixed values): areas and token caps of the formula buckets; render resolution and areas.
BUCKET_PRESETS = {
    "default": (2500, 15000, 192, 512),
    "wider_small": (5000, 15000, 256, 512),
    "wider_medium": (2500, 30000, 192, 768),
    "tighter": (1500, 8000, 128, 384),
    "scaled_2x": (5000, 30000, 192, 512),
}
DPI_PRESETS = {"150_default": (150, 2500, 15000), "300_default": (300, 2500, 15000), "150_scaled_4x": (150, 10000, 60000), "300_scaled_4x": (300, 10000, 60000)}
_BUCKET_KNOBS = ("formula_bucket_small_threshold", "formula_bucket_medium_threshold", "formula_bucket_small_tokens", "formula_bucket_medium_tokens")


def preset(knob: str, value: str) -> dict[str, object]:
    """The settings that a named value of a sweep stands for; an unknown name is a KeyError."""
    formulas = {"formula_enabled": True, "formula_bucketed": True}
    if knob == "formula_bucket_thresholds":
        return formulas | dict(zip(_BUCKET_KNOBS, BUCKET_PRESETS[value], strict=True))
    if knob == "dpi_bucket_interaction":
        return formulas | dict(zip(("render_dpi_digital_born", *_BUCKET_KNOBS[:2]), DPI_PRESETS[value], strict=True))
    if knob == "stages":
        return dict.fromkeys(("formula_enabled", "table_enabled", "references_enabled"), True) if value == "all_on" else {}
    raise KeyError(knob)


def sweep_grid(base: DataFrame, values: DataFrame, most: int = 10_000) -> DataFrame:
    """Every value of the grid on every base configuration; a grid of over ``most`` rows is an error."""
    if values.limit(most + 1).count() > most:
        raise ValueError(f"a sweep has at most {most} values")
    return base.crossJoin(F.broadcast(values))


def exit_code(runs: DataFrame) -> int:
    """0 if no run failed, else 2."""
    return 0 if runs.where("status = 'failed'").isEmpty() else 2


def overridden(overrides: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(overrides, key), default)


def unknown_keys(given: Column, valid: Column) -> Column:
    return F.array_sort(F.array_except(given, valid))


def referenced(main: Column, overrides: Column) -> Column:
    return F.array_sort(F.array_union(main, F.map_values(overrides)))


def first_available(df: DataFrame, preferences: list[str]) -> str | None:
    """The first preferred column that ``df`` has."""
    return next((c for c in preferences if c in df.columns), None)
