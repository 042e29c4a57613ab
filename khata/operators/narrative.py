"""Prose about figures: composed from a bundle, and checked before it goes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.text import banned_words, figures, unsupported

DASHES = "[–—]|--"


def problems(prose: Column, allowed: Column) -> Column:
    """Why a text may not go out: figures that nothing supports, banned words, dashes; empty if it may."""
    stray, banned = unsupported(figures(prose), allowed), banned_words(prose)
    return F.array_compact(
        F.array(
            F.when(F.size(stray) > 0, F.concat(F.lit("unsupported: "), F.array_join(stray, ", "))), F.when(F.size(banned) > 0, F.concat(F.lit("banned: "), F.array_join(banned, ", "))),
            F.when(prose.rlike(DASHES), F.lit("dash")), F.when(prose.isNull() | (F.trim(prose) == ""), F.lit("empty")),
        )
    )


def invented_citations(cited: Column, offered: Column) -> Column:
    return F.array_except(cited, offered)


def bundles(summary: DataFrame, tenders: DataFrame, fy_of_tender: Column) -> DataFrame:
    """Each ministry's figures of a year with what follows from them, and all values that prose may state, with their sign or without."""
    by_year = tenders.groupBy(fy_of_tender.alias("fy"), "ministry_id").agg(F.count("*").alias("tenders"), F.sum("value").alias("tender_value"))
    rows = summary.join(by_year, ["fy", "ministry_id"], "left").withColumn("tenders", F.coalesce("tenders", F.lit(0)))
    values = ["be", "re", "supplementary", "authority", "spent", "balance", "pct_spent", "tenders", "tender_value"]
    return rows.withColumn("allowed", F.array_compact(F.array(*[f(F.col(v).cast("double")) for v in values for f in (F.abs, lambda x: x)])))


def fallback(rows: DataFrame, name: str = "name") -> Column:
    """Plain sentences that state the figures and nothing else; a missing one is said to be missing."""
    crore = lambda c: F.concat(c.cast("decimal(30,2)").cast("string"), F.lit(" crore"))
    say = lambda label, c: F.coalesce(F.concat(F.lit(f"{label} "), crore(F.col(c)), F.lit(".")), F.lit(f"{label} not reported."))
    return F.concat_ws(" ", F.concat(F.col(name), F.lit(", "), F.col("fy"), F.lit(":")), say("Authority", "authority"), say("Spent", "spent"), say("Balance", "balance"), F.concat(F.lit("Tenders: "), F.col("tenders").cast("string"), F.lit(".")))


def digest(flags: DataFrame) -> DataFrame:
    """One text per year: its flags by severity, as list items in order; a line per flag."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "notable", 1).otherwise(2)
    line = F.concat(F.lit("- "), F.col("severity"), F.lit(": "), F.col("rule_id"), F.lit(" ("), F.col("entity_id"), F.lit(")"))
    items = flags.select("fy", F.struct(rank.alias("r"), "rule_id", "entity_id", line.alias("line")).alias("i"))
    return items.groupBy("fy").agg(F.array_join(F.array_sort(F.collect_list("i"))["line"], "\n").alias("body"), F.count("*").alias("flags"))
