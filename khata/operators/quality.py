"""Data quality: invariants, freshness, drift, alerts and row validation; violations are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.plans.views import monthly_spend

# Relative swings and error rates from which findings are warnings or high.
SWING_WARN, SWING_HIGH = 0.5, 0.9
ERRORS_WARN, ERRORS_HIGH = 0.02, 0.10
BASELINE_RUNS = 8
ERROR_SHARE, REQUEST_FLOOR = 0.05, 20
SEVERITIES = ("info", "warn", "high")


def invariants(facts: DataFrame, current: DataFrame, summary: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """check_id, severity, fy, entity_id and value of every violation."""
    none = F.lit(None).cast("double")

    def found(rows, check, severity, value=none, entity="entity_id"):
        return rows.select(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), "fy", F.col(entity).alias("entity_id"), value.alias("value"))

    newer = facts.where("supersedes is not null").select(F.col("supersedes").alias("fact_key"))
    known = entities.select(F.col("ministry_id").alias("entity_id"))
    return reduce(
        DataFrame.unionByName,
        [
            found(current.join(newer, "fact_key", "left_semi"), "superseded_fact_visible", "error"),
            found(monthly_spend(current).where("is_decrease"), "cumulative_series_decreased", "warn", F.round(F.col("cumulative").cast("double"), 6)),
            found(summary.where("pct_spent > 150"), "expenditure_exceeds_authority", "warn", F.round("pct_spent", 6), "ministry_id"),
            found(facts.join(F.broadcast(sources), "source_id", "left_anti"), "fact_without_source", "error"),
            found(facts.join(F.broadcast(known), "entity_id", "left_anti"), "entity_unknown", "error"),
            found(facts.where("stage = 'EXPENDITURE' and period_end is null"), "flow_without_period", "error"),
        ],
    )


def freshness(runs: DataFrame, as_of: Column, interval_hours: int) -> DataFrame:
    """Stale: no good run yet, or the last one longer ago than twice the interval."""
    ok = F.when(F.col("status") == "ok", F.col("started_at"))
    rows = runs.groupBy("source_id").agg(F.max(ok).alias("last_ok"), F.max("started_at").alias("last_run"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"))
    gone = F.timestamp_diff("SECOND", F.col("last_ok"), as_of)
    return rows.select("source_id", "last_ok", "last_run", "last_status", F.floor(gone / 3600).cast("long").alias("hours_since"), (F.col("last_ok").isNull() | (gone > 2 * interval_hours * 3600)).alias("is_stale"))


def _median(values: Column) -> Column:
    """The median of a short array; NULL if empty."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def drift(days: DataFrame) -> DataFrame:
    """Findings of days(source_id, day, n, total, failed) against the median of the runs before."""
    before = Window.partitionBy("source_id").orderBy("day").rowsBetween(-BASELINE_RUNS, -1)
    total = F.col("total").cast("double")
    rows = days.select("source_id", "day", "n", "failed", total.alias("total"), _median(F.collect_list(F.col("n").cast("double")).over(before)).alias("base_n"), _median(F.collect_list(total).over(before)).alias("base_total"))
    swing = lambda x, base: F.when(base > 0, F.abs(x - base) / base)
    n, t, errors = swing(F.col("n"), F.col("base_n")), swing(F.col("total"), F.col("base_total")), F.when(F.col("n") > 0, F.col("failed") / F.col("n"))
    band = lambda x: F.when(x > SWING_HIGH, "high").otherwise("warn")
    hit = lambda cond, name, level, value: F.when(cond, F.struct(F.lit(name).alias("finding"), level.alias("severity"), F.round(value.cast("double"), 6).alias("value")))
    hits = F.array(
        hit(F.col("n") == 0, "zero_rows", F.lit("high"), F.lit(None)), hit(n > SWING_WARN, "row_count_swing", band(n), n), hit(t > SWING_WARN, "total_amount_swing", band(t), t),
        hit(F.col("failed") > 0, "parse_error_rate", F.when(errors >= ERRORS_HIGH, "high").when(errors >= ERRORS_WARN, "warn").otherwise("info"), errors), hit(F.col("base_n").isNull() & (F.col("n") > 0) & (F.col("failed") == 0), "no_baseline", F.lit("info"), F.lit(None)),
    )
    return rows.select("source_id", "day", F.explode(F.array_compact(hits)).alias("h")).select("source_id", "day", "h.*")


def column_changes(before: Column, now: Column) -> Column:
    """A struct of removed and added columns with its severity; removed is high, added a warning."""
    gone, new = F.array_except(before, now), F.array_except(now, before)
    return F.struct(gone.alias("removed"), new.alias("added"), F.when(F.size(gone) > 0, "high").when(F.size(new) > 0, "warn").alias("severity"))


def worst(findings: DataFrame, *keys: str) -> DataFrame:
    """The worst severity by key, and whether it stops the run."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy(*keys).agg(F.max_by("severity", rank).alias("severity"), (F.max(rank) == 3).alias("abort"))


def alerts(events: DataFrame) -> DataFrame:
    """Five-minute windows: requests, errors, whether their share passes the bound above a floor, 95th percentile."""
    return (
        events.groupBy(F.window("ts", "5 minutes").alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile("value", F.lit(0.95)).alias("p95"))
        .select(F.col("w.start").alias("start"), "requests", "errors", ((F.col("requests") >= REQUEST_FLOOR) & (F.col("errors") > ERROR_SHARE * F.col("requests"))).alias("alert"), "p95")
    )


def failures(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """Rows that fail a check, with all the messages in errors; a check that is NULL doesn't fail."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))).where(F.size("errors") > 0)
