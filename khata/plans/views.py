"""The graph of views: current facts, authority, expenditure, monthly spend and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.calendar import fraction_elapsed, fy_month_index

CELL = ["fy", "entity_type", "entity_id", "stage", "head", "period_end"]
ENTITY = ["fy", "entity_type", "entity_id"]


def current_facts(facts: DataFrame) -> DataFrame:
    """Of every cell the fact that is not superseded and has the newest document; a missing period is one cell."""
    gone = facts.where("supersedes is not null").select(F.col("supersedes").alias("fact_key"))
    order = Window.partitionBy(*CELL).orderBy(F.col("document_date").desc_nulls_last(), F.col("fact_key").desc())
    return facts.join(gone, "fact_key", "left_anti").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def authority(current: DataFrame) -> DataFrame:
    """BE, RE and supplementary of each entity and year; the revised figure stands where there is one."""
    at = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("amount")))
    budget = current.where("stage in ('BE', 'RE', 'SUPPLEMENTARY') and head = 'total'").groupBy(*ENTITY).agg(
        at("BE").alias("be"), at("RE").alias("re"), F.sum(F.when(F.col("stage") == "SUPPLEMENTARY", F.col("amount"))).alias("supplementary"), F.max("document_date").alias("document_date"),
        F.max_by("fact_key", F.struct(F.when(F.col("stage") == "RE", 2).when(F.col("stage") == "BE", 1).otherwise(0), "document_date", "fact_key")).alias("authority_key"),
    )
    return budget.withColumn("authority", (F.coalesce("re", "be") + F.coalesce("supplementary", F.lit(0).cast("decimal(20,2)"))).cast("decimal(20,2)"))


def expenditure_to_date(current: DataFrame) -> DataFrame:
    """The latest cumulative snapshot by head, one row per entity and year; snapshots are never added."""
    latest = current.where("stage = 'EXPENDITURE' and is_cumulative").groupBy(*ENTITY, "head").agg(F.max_by("amount", "period_end").alias("amount"), F.max("period_end").alias("as_of"))
    at = lambda head, c: F.max(F.when(F.col("head") == head, F.col(c)))
    return latest.groupBy(*ENTITY).agg(at("total", "amount").alias("spent"), at("revenue", "amount").alias("revenue"), at("capital", "amount").alias("capital"), at("total", "as_of").alias("as_of"))


def monthly_spend(current: DataFrame, head: str = "total") -> DataFrame:
    """Each month's own spend from cumulative snapshots.

    The first snapshot is a month's own only in April; after a missing month it is not known. A month below
    zero is kept and flagged, April's too.
    """
    snapshots = current.where((F.col("stage") == "EXPENDITURE") & F.col("is_cumulative") & (F.col("head") == head)).select(
        *ENTITY, fy_month_index(F.col("period_end")).alias("month"), "period_end", F.col("amount").alias("cumulative")
    )
    order = Window.partitionBy(*ENTITY).orderBy("month")
    before, last = F.lag("cumulative").over(order), F.lag("month").over(order)
    own = F.when(last.isNull() & (F.col("month") == 1), F.col("cumulative")).when(F.col("month") - last == 1, F.col("cumulative") - before)
    return snapshots.withColumn("amount", own.cast("decimal(20,2)")).withColumn("is_decrease", F.coalesce(F.col("amount") < 0, F.lit(False)))


def ratio(a, b):
    """a / b as double, NULL where b is missing or not above zero."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def summary(budget: DataFrame, spent: DataFrame) -> DataFrame:
    """Authority beside spend, with balance and pace; a missing figure stays missing."""
    rows = budget.join(spent, ENTITY, "left")
    elapsed = F.when(F.col("as_of").isNotNull(), fraction_elapsed(F.col("fy"), F.col("as_of")))
    share = ratio(F.col("spent"), F.col("authority"))
    return rows.select(
        *ENTITY, "be", "re", "supplementary", "authority", "spent", "revenue", "capital", "as_of",
        (F.col("authority") - F.col("spent")).cast("decimal(20,2)").alias("balance"), (share * 100).alias("pct_spent"), elapsed.alias("elapsed"),
        F.when(elapsed > 0, share / elapsed).alias("burn_ratio"), ratio(F.col("re") - F.col("be"), F.col("be")).alias("revision"),
        ratio(F.col("capital"), F.coalesce("capital", F.lit(0)) + F.coalesce("revenue", F.lit(0))).alias("capital_share"),
    )


def ministry_summary(facts: DataFrame) -> DataFrame:
    current = current_facts(facts.where("entity_type = 'ministry'"))
    return summary(authority(current), expenditure_to_date(current)).withColumnRenamed("entity_id", "ministry_id").drop("entity_type")
