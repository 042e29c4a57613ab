"""Tables from files: CSV with aliased headers, JSON in long and wide layout, grids of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions.money import parse_crore, unit_of
from khata.functions.text import clean_cell, normalise_name

# Least scores of a grid that is trusted, and of one that can be used at all.
TRUSTED, USABLE = 0.60, 0.25


def read_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by name or alias, whatever case or spaces; those not found are NULL."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    known = {" ".join(c.replace("﻿", "").replace("_", " ").lower().split()): c for c in raw.columns}
    pick = lambda names: next((known[n] for n in names if n in known), None)
    return raw.select(*[(F.col(f"`{c}`") if (c := pick([name.replace("_", " "), *other])) else F.lit(None).cast("string")).alias(name) for name, other in aliases.items()])


def unpivot_stages(rows: DataFrame, ids: list[str], stages: dict[str, str], hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, errors): a row per stage column, amounts parsed; a figure not reported is in neither."""
    long = rows.unpivot(ids, list(stages), "__column", "raw").withColumn("stage", F.create_map(*[F.lit(x) for kv in stages.items() for x in kv])[F.col("__column")])
    parsed = long.withColumn("p", parse_crore(F.col("raw"), F.lit(hint) if hint else None))
    facts = parsed.where("p.status = 'value'").select(*ids, "stage", F.col("p.value").alias("amount"))
    return facts, parsed.where("p.status = 'error'").select(*ids, "stage", "raw", F.col("p.reason").alias("reason"))


def read_json_records(spark: SparkSession, path: str, field: str = "records", schema: str = "array<map<string,string>>") -> DataFrame:
    """One row per record of a JSON answer, as a map of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"{field} {schema}")[field]).alias("record"))


def wide_to_long(rows: DataFrame, columns: dict[str, tuple[str, str]], keys: list[str], by: str | None = None, keep_rows: tuple[str, ...] = (), drop_rows: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fy, stage, raw, error) of records in wide layout; a declared column that a record lacks is an error.

    by names the field by whose normal form rows are chosen (the first key, if none): those of keep_rows alone, if it names any,
    and none of drop_rows. Rows whose first key is blank are left out. If keep_rows finds no row, one error says so.
    """
    field = lambda k: F.trim(F.coalesce(F.try_element_at("record", F.lit(k)), F.lit("")))
    chosen = normalise_name(field(by or keys[0]))
    left = chosen.isin(*[r for r in keep_rows if r not in drop_rows]) if keep_rows else ~chosen.isin(*drop_rows) if drop_rows else F.lit(True)
    wanted = (field(keys[0]) != "") & left
    parts = F.array(*[F.struct(F.lit(fy).alias("fy"), F.lit(stage).alias("stage"), F.try_element_at("record", F.lit(c)).alias("raw"), F.map_contains_key("record", c).alias("there"), F.lit(c).alias("column")) for c, (fy, stage) in columns.items()])
    error = F.when(~F.col("p.there"), F.concat(F.lit("missing column: "), F.col("p.column")))
    long = rows.where(wanted).select(*[F.try_element_at("record", F.lit(k)).alias(k) for k in keys], F.explode(parts).alias("p")).select(*keys, "p.fy", "p.stage", "p.raw", error.alias("error"))
    if not keep_rows:
        return long
    none = rows.agg(F.count_if(wanted).alias("n")).where("n = 0").select(F.lit(f"none of the rows: {', '.join(sorted(keep_rows))}").alias("error"))
    return long.unionByName(none, allowMissingColumns=True)


def judged_amounts(long: DataFrame, unit: str | None = None) -> DataFrame:
    """wide_to_long() with amount (in crore) or reason (what can't be read, or wasn't there), each cell read once; without figures not reported."""
    ids = [c for c in long.columns if c not in ("raw", "error")]
    parsed = long.select(*long.columns, F.inline(F.array(parse_crore(F.col("raw"), F.lit(unit) if unit else None))))  # a row each: filters above don't read the cell again
    reason = F.coalesce("error", F.when(F.col("status") == "error", F.col("reason")))
    kept = parsed.where("error is not null or status <> 'not_reported'")
    return kept.select(*ids, "raw", F.when(reason.isNull(), F.col("value")).alias("amount"), reason.alias("reason"))


def long_amounts(long: DataFrame, unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, errors) of wide_to_long(): amounts in crore, and what can't be read or wasn't there; figures not reported are in neither."""
    judged = judged_amounts(long, unit)
    return judged.where("reason is null").drop("raw", "reason"), judged.where("reason is not null").drop("amount")


def header_row(cells: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Of each table in cells(keys, row_no, cells) the first of its first rows with two cells filled and hardly a number."""
    numeric = F.size(F.filter("cells", lambda c: looks_numeric(c)))
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    return cells.where((F.col("row_no") < most) & (filled >= 2) & (numeric < 0.34 * filled)).groupBy(*keys).agg(F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_no"))


def looks_numeric(cell: Column) -> Column:
    return F.trim(cell).rlike(r"^\(?-?[₹0-9][0-9,]*(\.[0-9]+)?%?\)?$")


def grid_score(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence that a grid is a table, from 0 to 1 with four places: filled cells, rows of the usual width, numbers beside the first column.

    Under three rows it is less; a grid whose usual width is under two is no table at all.
    """
    filled = lambda c: F.size(F.filter(c, lambda x: F.trim(x) != ""))
    beside = F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1)))
    rows = cells.select(*keys, F.size("cells").alias("w"), filled("cells").alias("f"), filled(beside).alias("b"), F.size(F.filter(beside, looks_numeric)).alias("n"))
    widths = rows.groupBy(*keys, "w").agg(*[F.sum(c).alias(c) for c in ("f", "b", "n")], F.count("*").alias("k"))
    sums = widths.groupBy(*keys).agg(
        F.max("k").alias("same"), F.max_by("w", F.struct("k", "w")).alias("usual"), F.sum("k").alias("rows"), F.sum(F.col("w") * F.col("k")).alias("w"), *[F.sum(c).alias(c) for c in ("f", "b", "n")]
    )
    share = F.when(F.col("b") > 0, F.col("n") / F.col("b")).otherwise(0.0)
    score = F.least(F.lit(1.0), F.sqrt(F.col("f") / F.col("w")) * (F.col("same") / F.col("rows")) * (0.3 + 0.7 * share)) * F.when(F.col("rows") < 3, 0.6).otherwise(1.0)
    return sums.select(*keys, F.when((F.col("usual") < 2) | (F.col("w") == 0), 0.0).otherwise(F.round(score, 4)).alias("score"))


def grid_verdict(score: Column) -> Column:
    """What becomes of a grid: its figures are taken, it is read a second time, or a human gets it."""
    return F.when(score >= TRUSTED, "trusted").when(score >= USABLE, "assist").otherwise("unusable")


def carry_down(rows: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """The last value that was there, for rows below a heading."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))


def to_records(cells: DataFrame, header: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, column, raw, unit) of the cells below their header; the unit stands in the header, if anywhere."""
    joined = cells.join(header, keys).where("row_no > header_no")
    each = joined.select(*keys, "row_no", "header", F.posexplode("cells").alias("k", "raw"))
    name = clean_cell(F.get("header", F.col("k")))
    return each.select(*keys, "row_no", name.alias("column"), clean_cell(F.col("raw")).alias("raw"), unit_of(name).alias("unit"))
