"""Runs of sources: the good runs before each, drift against them, and the state a run ends in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.operators.quality import BASELINE_RUNS, ERRORS_HIGH, ERRORS_WARN, SEVERITIES, SWING_HIGH, SWING_WARN, _median

KEYS = ("source_id", "dataset")


def _beside(a: DataFrame, b: DataFrame, names, how: str) -> DataFrame:
    """a joined with b where the named columns are equal, NULLs too; b's own go."""
    right = b.select([F.col(c).alias(f"__right_{c}" if c in names else c) for c in b.columns])
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__right_{n}")) for n in names])
    return a.join(right, on, how).drop(*[f"__right_{n}" for n in names])


def placed(runs: DataFrame, keys=KEYS) -> DataFrame:
    """runs with place, the number of good runs of the same keys before each, by started_at and then run_id.

    Counted within each day and added to the days before, so that a source of many runs is many groups. A run
    without a start comes first.
    """
    rows = runs.withColumn("__day", F.to_date("started_at"))
    good = (F.col("status") == "ok").cast("int")
    within = Window.partitionBy(*keys, "__day").orderBy(F.col("started_at").asc_nulls_first(), "run_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(good).over(within), F.lit(0)))
    days = runs.groupBy(*keys, F.to_date("started_at").alias("__day")).agg(F.sum(good).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(F.col("__day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return _beside(rows, days, [*keys, "__day"], "inner").select(*runs.columns, (F.col("__own") + F.col("__before")).alias("place"))


def with_baseline(runs: DataFrame, keys=KEYS, size: int = BASELINE_RUNS) -> DataFrame:
    """runs(keys, run_id, started_at, status, n_rows, total, columns, ...) with the baseline of each.

    base_runs, base_n, base_total and base_columns: how many good runs (status ok) the baseline holds, the last ones
    before the run and size at most; the median of their rows and of the totals that are known; and the columns of the newest
    of them that has any. A bad run is never part of a baseline, however many follow each other. Each good run is dealt to
    the places after it, so that no group holds more than size runs.
    """
    rows = placed(runs, keys)
    good = rows.where("status = 'ok'")
    slots = good.select(*keys, F.col("place").alias("__at"), "n_rows", "total", "columns", F.explode(F.sequence(F.col("place") + 1, F.col("place") + size)).alias("place"))
    base = slots.groupBy(*keys, "place").agg(
        F.count("*").alias("base_runs"), F.collect_list(F.coalesce("n_rows", F.lit(0)).cast("double")).alias("__n"), F.collect_list(F.col("total").cast("double")).alias("__t"),
        F.max_by("columns", F.when(F.size("columns") > 0, F.col("__at"))).alias("__columns"),
    )
    met = _beside(rows, base, [*keys, "place"], "left")
    columns = F.when(F.size("__columns") > 0, F.col("__columns"))
    return met.select(*runs.columns, F.coalesce("base_runs", F.lit(0)).alias("base_runs"), _median(F.col("__n")).alias("base_n"), _median(F.col("__t")).alias("base_total"), columns.alias("base_columns"))


def findings(runs: DataFrame) -> DataFrame:
    """run_id, keys, finding, severity, current and baseline of with_baseline() rows that did not fail.

    zero_rows and parse_error_rate need no baseline; a run without baseline has no_baseline alone, if nothing else. Swings are
    relative to the size of the baseline, which must not be zero. A removed column is high, an added one a warning.
    """
    n, errors = F.coalesce("n_rows", F.lit(0)).cast("double"), F.coalesce("n_errors", F.lit(0)).cast("double")
    total = F.col("total").cast("double")
    rate = F.when(n + errors > 0, errors / (n + errors))
    swing = lambda x, base: F.when(base != 0, (x - base) / F.abs(base))
    by_n, by_total = swing(n, F.col("base_n")), swing(total, F.col("base_total"))
    known = F.col("base_runs") > 0
    both = (F.size("columns") > 0) & (F.size("base_columns") > 0)
    gone, new = F.array_except("base_columns", "columns"), F.array_except("columns", "base_columns")
    none = F.lit(None).cast("double")

    def hit(fires, finding, severity, current, baseline):
        return F.when(fires, F.struct(F.lit(finding).alias("finding"), severity.alias("severity"), F.round(current, 6).alias("current"), F.round(baseline, 6).alias("baseline")))

    band = lambda x: F.when(F.abs(x) > SWING_HIGH, "high").otherwise("warn")
    alone = ~known & (n > 0) & (errors == 0)
    hits = F.array(
        hit(n == 0, "zero_rows", F.lit("high"), n, none),
        hit(rate > 0, "parse_error_rate", F.when(rate >= ERRORS_HIGH, "high").when(rate >= ERRORS_WARN, "warn").otherwise("info"), rate, F.lit(ERRORS_HIGH)),
        hit(alone, "no_baseline", F.lit("info"), n, none),
        hit(known & (F.abs(by_n) > SWING_WARN), "row_count_swing", band(by_n), n, F.col("base_n")),
        hit(known & (F.abs(by_total) > SWING_WARN), "total_amount_swing", band(by_total), total, F.col("base_total")),
        hit(both & (F.size(gone) + F.size(new) > 0), "column_set_change", F.when(F.size(gone) > 0, "high").otherwise("warn"), F.size(new).cast("double"), F.size(gone).cast("double")),
    )
    rows = runs.where("status is null or status != 'failed'").select("run_id", *KEYS, F.explode(F.array_compact(hits)).alias("h"))
    return rows.select("run_id", *KEYS, "h.*")


def states(runs: DataFrame, found: DataFrame) -> DataFrame:
    """run_id, keys, state, written and severity of every run.

    A failed run stays failed. A finding of high severity stops the run before its figures are written, one of warn or
    high makes it a drift_alert, and one of info changes nothing.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = found.groupBy("run_id").agg(F.max_by("severity", rank).alias("severity"))
    state = F.when(F.col("status") == "failed", "failed").when(F.col("severity").isin("warn", "high"), "drift_alert").otherwise("ok")
    written = (F.coalesce("status", F.lit("")) != "failed") & (F.coalesce("severity", F.lit("")) != "high")
    return runs.join(worst, "run_id", "left").select("run_id", *KEYS, state.alias("state"), written.alias("written"), "severity")
