"""Distance from even spending, and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.calendar import par_fraction
from khata.plans.views import ratio

# Upper bounds of the positions by pace against par, and of the bands by burn ratio.
POSITIONS = ((0.6, "far_behind"), (0.9, "behind"), (1.1, "near_par"), (1.4, "ahead"), (None, "far_ahead"))
BURN_BANDS = ((0.5, "far_behind"), (0.85, "behind"), (1.15, "on_pace"), (1.3, "ahead"), (None, "far_ahead"))


def position(pace: Column) -> Column:
    return reduce(lambda c, b: c.when(pace < b[0], b[1]), POSITIONS[:-1], F.when(pace.isNull(), F.lit(None))).otherwise(POSITIONS[-1][1])


def burn_band(burn: Column) -> Column:
    """Bands end with their bound from 1.15 on, and before it below."""
    return F.when(burn < 0.5, BURN_BANDS[0][1]).when(burn < 0.85, BURN_BANDS[1][1]).when(burn <= 1.15, BURN_BANDS[2][1]).when(burn <= 1.3, BURN_BANDS[3][1]).when(burn.isNotNull(), BURN_BANDS[4][1])


# Names of the bands, and what is said of a pace.
BURN_LABELS = {"far_behind": "Far behind pace", "behind": "Behind pace", "on_pace": "On pace", "ahead": "Ahead of pace", "far_ahead": "Far ahead of pace"}
UNKNOWN_BAND, UNKNOWN_PACE = "Not reported", "Spending pace cannot be computed from the reported figures."
IN_LINE, APART = "Spending is broadly in line with the share of the year elapsed.", "Spending is running about {}% {} the share of the year elapsed."


def burn_label(burn: Column) -> Column:
    """The band's name; a ratio that isn't known has one too."""
    band = burn_band(burn)
    return reduce(lambda c, kv: c.when(band == kv[0], kv[1]), BURN_LABELS.items(), F.when(band.isNull(), UNKNOWN_BAND))


def burn_sentence(burn: Column) -> Column:
    """The ratio in words: in line up to 15 whole per cent from one, else so many below or above."""
    apart = F.floor(F.abs(burn - 1) * 100 + 0.5)
    said = F.replace(F.replace(F.lit(APART), F.lit("{}%"), F.concat(apart.cast("string"), F.lit("%"))), F.lit("{}"), F.when(burn < 1, "below").otherwise("above"))
    return F.when(burn.isNull(), UNKNOWN_PACE).when(apart <= 15, IN_LINE).otherwise(said)


def _usable(summary: DataFrame) -> DataFrame:
    """summary with par, and usable: authority and spend are known, some authority is there and some of the year is gone."""
    rows = summary.withColumn("par", par_fraction(F.col("fy"), F.col("as_of")))
    good = (F.col("authority") > 0) & F.col("spent").isNotNull() & (F.col("par") > 0)
    return rows.withColumn("usable", F.coalesce(good, F.lit(False)))


def skipped(summary: DataFrame) -> DataFrame:
    """fy, n_usable and n_skipped: rows that pareto() ranks, and those that it leaves out."""
    return _usable(summary).groupBy("fy").agg(F.count_if("usable").alias("n_usable"), F.count_if(~F.col("usable")).alias("n_skipped"))


def pareto(summary: DataFrame) -> DataFrame:
    """Rows with known authority and spend, a part of whose year is gone: absorption, par, pace, gap in crore, weight, running share of all shortfall."""
    rows = _usable(summary).where("usable").select("fy", "ministry_id", "authority", ratio(F.col("spent"), F.col("authority")).alias("absorption"), "par")
    money = F.col("authority").cast("double")
    rows = rows.withColumn("gap", (F.col("absorption") - F.col("par")) * money).withColumn("pace", F.col("absorption") / F.col("par"))
    year, order = Window.partitionBy("fy"), Window.partitionBy("fy").orderBy("gap", "ministry_id")
    short = -F.least(F.col("gap"), F.lit(0.0))
    total = F.sum(short).over(year)
    return rows.select(
        "fy", "ministry_id", F.row_number().over(order).alias("place"), "absorption", "par", "pace", "gap", (money / F.sum(money).over(year)).alias("weight"),
        F.when(total > 0, F.sum(short).over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("pareto"), position(F.col("pace")).alias("position"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """Net, behind and ahead by year, with counts, the near-par ones apart."""
    return rows.groupBy("fy").agg(
        F.sum("gap").alias("net"), F.sum(F.when(F.col("gap") < 0, F.col("gap"))).alias("behind"), F.sum(F.when(F.col("gap") > 0, F.col("gap"))).alias("ahead"),
        F.count_if(F.col("gap") < 0).alias("n_behind"), F.count_if(F.col("gap") > 0).alias("n_ahead"), F.count_if(F.col("position") == "near_par").alias("n_near_par"),
    )


def movers(summary: DataFrame, top: int) -> DataFrame:
    """fy, list, place, ministry_id, value: slowest, fastest, revised."""
    def best(name, value, order):
        rank = F.row_number().over(Window.partitionBy("fy").orderBy(order, "ministry_id"))
        return summary.where(F.col(value).isNotNull()).select("fy", F.lit(name).alias("list"), rank.alias("place"), "ministry_id", F.col(value).alias("value")).where(F.col("place") <= top)

    return best("slowest", "burn_ratio", F.asc("burn_ratio")).union(best("fastest", "burn_ratio", F.desc("burn_ratio"))).union(best("revised", "revision", F.desc(F.abs("revision"))))


def waterfall(summary: DataFrame) -> DataFrame:
    """Steps from budget to balance: where each bar starts and ends; unknown after an unknown step."""
    deltas = {"be": F.col("be"), "revision": F.col("re") - F.col("be"), "supplementary": F.coalesce("supplementary", F.lit(0)), "spent": -F.col("spent")}
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), d.cast("decimal(20,2)").alias("delta")) for k, (n, d) in enumerate(deltas.items(), 1)])
    rows = summary.select("fy", "ministry_id", F.explode(steps).alias("s")).select("fy", "ministry_id", "s.*")
    w = Window.partitionBy("fy", "ministry_id").orderBy("step")
    broken = F.max(F.col("delta").isNull().cast("int")).over(w) > 0
    after = F.when(~broken, F.sum("delta").over(w).cast("decimal(20,2)"))
    return rows.withColumn("after", after).withColumn("before", F.when(F.col("after").isNotNull(), (F.col("after") - F.col("delta")).cast("decimal(20,2)")))
