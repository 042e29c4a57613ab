"""Anomaly rules: pure functions of a row of measures, one row per hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.calendar import fraction_elapsed, fy_end
from khata.plans.views import ratio

# Thresholds. Each rule fires strictly above or below them where the name says over or under.
MARCH = {"q4_over": 0.30, "march_over": 0.15, "q4_high": 0.45, "march_high": 0.25}
UNDER = {"elapsed_over": 0.5, "burn_under": 0.5, "burn_high": 0.25}
OVER = {"elapsed_least": 0.25, "burn_over": 1.3, "burn_high": 1.6}
SWING = {"over": 0.25, "high": 0.50}
NO_TENDER = {"spend_least": 100.0, "capital_least": 0.30, "days": 90}
OUTLIER = {"years_least": 3, "stdev_least": 1.0, "z_least": 2.5, "z_high": 3.5}
RULES = ("march_rush", "under_utilization", "over_burn", "revision_swing", "spend_no_tender", "stat_outlier")


def severity(high: Column) -> Column:
    return F.when(high, "high").otherwise("notable")


def march_measures(monthly: DataFrame) -> DataFrame:
    """Of years with all twelve months known: total, last quarter's and March's share."""
    months = monthly.groupBy("fy", "entity_id").agg(
        F.count("amount").alias("months"), F.sum("amount").alias("total"), F.sum(F.when(F.col("month") >= 10, F.col("amount"))).alias("q4"), F.sum(F.when(F.col("month") == 12, F.col("amount"))).alias("march")
    ).where("months = 12 and total > 0")
    return months.select("fy", "entity_id", (F.col("q4").cast("double") / F.col("total").cast("double")).alias("q4_share"), (F.col("march").cast("double") / F.col("total").cast("double")).alias("march_share"))


def outlier_measures(monthly: DataFrame) -> DataFrame:
    """Each month against the same month of the entity's earlier years."""
    earlier = Window.partitionBy("entity_id", "month").orderBy("fy").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col("amount").cast("double")
    known = monthly.where("amount is not null")
    rows = known.select("fy", "entity_id", "month", value.alias("value"), F.count("amount").over(earlier).alias("years"), F.avg(value).over(earlier).alias("mean"), F.stddev_pop(value).over(earlier).alias("stdev"))
    rows = rows.where((F.col("years") >= OUTLIER["years_least"]) & (F.col("stdev") >= OUTLIER["stdev_least"]))
    return rows.withColumn("z", (F.col("value") - F.col("mean")) / F.col("stdev"))


def trailing_tenders(summary: DataFrame, tenders: DataFrame) -> DataFrame:
    """Tenders of the ministry published in the days up to as_of (or the year's end), the first day left out."""
    at = summary.select("fy", "ministry_id", F.coalesce("as_of", fy_end(F.col("fy"))).alias("d"))
    # Counted by day first, so that the range join meets one row per ministry and day.
    days = tenders.groupBy(F.col("ministry_id").alias("m"), "published").agg(F.count("*").alias("n"))
    joined = at.join(days, (F.col("ministry_id") == F.col("m")) & (F.col("published") > F.date_sub("d", NO_TENDER["days"])) & (F.col("published") <= F.col("d")), "left")
    return joined.groupBy("fy", "ministry_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tenders_90d"))


def national_measures(summary: DataFrame) -> DataFrame:
    """The nation's measures by year: the sums of its ministries', pace by the newest of their days."""
    sums = summary.groupBy("fy").agg(*[F.sum(n).alias(n) for n in ("be", "re", "authority", "spent")], F.max("as_of").alias("as_of"))
    elapsed = F.when(F.col("as_of").isNotNull(), fraction_elapsed(F.col("fy"), F.col("as_of")))
    rows = sums.withColumn("elapsed", elapsed).withColumn("burn_ratio", F.when(F.col("elapsed") > 0, ratio(F.col("spent"), F.col("authority")) / F.col("elapsed")))
    return rows.select("fy", F.lit("national").alias("entity_type"), F.lit("national").alias("entity_id"), "spent", "elapsed", "burn_ratio", ratio(F.col("re") - F.col("be"), F.col("be")).alias("revision"))


def evaluate(summary: DataFrame, monthly: DataFrame, tenders: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """fy, entity_type, entity_id, rule_id, severity and metric of every hit; a missing measure fires nothing.

    others: measures of schemes and of the nation, beside those of ministries; columns that they lack are missing. Money
    released stands for money spent where it is known.
    """
    hit = lambda fires, rule, level, metric: F.when(fires, F.struct(F.lit(rule).alias("rule_id"), level.alias("severity"), metric.cast("double").alias("metric")))
    march = march_measures(monthly)
    worst = outlier_measures(monthly).groupBy("fy", "entity_id").agg(F.max_by("z", F.struct(F.abs("z"), -F.col("month"))).alias("z"))
    rows = summary.withColumnRenamed("ministry_id", "entity_id").select("fy", F.lit("ministry").alias("entity_type"), "entity_id", "spent", "elapsed", "burn_ratio", "revision", "capital_share", F.lit(None).cast("decimal(20,2)").alias("released"))
    if others is not None:
        rows = rows.unionByName(others, allowMissingColumns=True)
    rows = (
        rows.join(march, ["fy", "entity_id"], "left").join(worst, ["fy", "entity_id"], "left")
        .join(trailing_tenders(summary, tenders).withColumnRenamed("ministry_id", "entity_id"), ["fy", "entity_id"], "left")
    )
    c = F.col
    hits = F.array(
        hit((c("q4_share") > MARCH["q4_over"]) | (c("march_share") > MARCH["march_over"]), RULES[0], severity((c("q4_share") > MARCH["q4_high"]) | (c("march_share") > MARCH["march_high"])), c("q4_share")),
        hit((c("elapsed") > UNDER["elapsed_over"]) & (c("burn_ratio") < UNDER["burn_under"]), RULES[1], severity(c("burn_ratio") < UNDER["burn_high"]), c("burn_ratio")),
        hit((c("elapsed") >= OVER["elapsed_least"]) & (c("burn_ratio") > OVER["burn_over"]), RULES[2], severity(c("burn_ratio") > OVER["burn_high"]), c("burn_ratio")),
        hit(F.abs("revision") > SWING["over"], RULES[3], severity(F.abs("revision") > SWING["high"]), c("revision")),
        hit((c("tenders_90d") == 0) & (F.coalesce("released", "spent").cast("double") >= NO_TENDER["spend_least"]) & (c("capital_share") >= NO_TENDER["capital_least"]), RULES[4], F.lit("info"), c("capital_share")),
        hit(F.abs("z") >= OUTLIER["z_least"], RULES[5], severity(F.abs("z") >= OUTLIER["z_high"]), c("z")),
    )
    found = rows.select("fy", "entity_type", "entity_id", F.explode(F.array_compact(hits)).alias("h")).select("fy", "entity_type", "entity_id", "h.*")
    return found.withColumn("status", F.lit("pending"))
