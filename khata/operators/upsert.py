"""Merges of new rows into old ones by key, as pure DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Rows of both by key, in which NULLs are equal, and an action: inserted, updated or kept.

    A column of keep_old stays as it was where the row was there; one of fill changes only to a value. Rows
    must be unique by key on either side.
    """
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    there, came = F.col("a.__old").isNotNull(), F.col("b.__new").isNotNull()

    def value(c: str):
        before, after = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keep_old:
            return F.when(there, before).otherwise(after).alias(c)
        if c in fill:
            return F.coalesce(after, before).alias(c)
        return F.when(came, after).otherwise(before).alias(c)

    action = F.when(~there, "inserted").when(~came, "kept").otherwise("updated")
    return a.join(b, same, "full").select(*map(value, old.columns), action.alias("action"))


def dedupe_newest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, NULLs being equal, the first in the order given."""
    from pyspark.sql import Window

    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
