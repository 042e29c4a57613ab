"""Demand sheets of a budget workbook as grids of cells: stage columns, the demand's own Net row, a stated unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import calendar as cal

# What a stage's header begins with, what the parts of a sheet are told by, and where they may stand.
STAGES = (("actuals", "EXPENDITURE"), ("revised estimates", "RE"), ("budget estimates", "BE"))
DEMAND, YEARS = r"(?i)Demand\s+No\.?\s*([0-9]+)", r"([0-9]{4})\s*[-–]\s*([0-9]{4}|[0-9]{2})"
CRORE, LAKH = r"(?i)in\s*₹?\s*crore", r"(?i)in\s*₹?\s*lakh"
TITLE_ROWS, HEADER_ROWS, SPLIT_ROWS, SECTION_ROW = 9, 20, 3, 30
SECTION, NET = "A. The Budget", "Net"
SPACE = r"[\s\u00a0]+"


def _trimmed(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))


def _title(cell: Column) -> Column:
    """The lines of a title cell that hold anything, spaces made single."""
    return F.filter(F.transform(F.split(cell, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def amount(cell: Column) -> Column:
    """A cell's amount; none for dots, which say that nothing is provided, and never zero for them."""
    bare = F.regexp_replace(F.trim(cell), ",", "")
    return F.when(~bare.rlike(r"^[. ]*$"), bare.try_cast("decimal(20,2)"))


def demand_sheets(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of cells(keys, row_no from 0, cells array<string>), the rows of sheets with the same keys.

    rows: keys, demand_no, entity (the demand's name, else its owner's), owner, fy, stage, amount, header; a figure for each stage
    that the Net row above section A reports. errors: keys and the first reason why a sheet can't be read: it states lakh or no unit,
    names no owner, has no header of stages, or no Net row. A sheet's parts are found by minimum over its rows, so long sheets are
    not gathered; only header, split and Net row travel.
    """
    rows = cells.select(*keys, "row_no", _trimmed(F.col("cells")).alias("cells"))
    joined = F.array_join("cells", " ")
    top = F.col("row_no") < TITLE_ROWS
    titles = F.filter("cells", lambda c: c.rlike(DEMAND))
    longest = F.aggregate(titles, F.lit(""), lambda a, x: F.when(F.size(_title(x)) > F.size(_title(a)), x).otherwise(a))
    lines = F.size(_title(longest))
    in_header = (F.col("row_no") < HEADER_ROWS) & F.lower(joined).contains("actuals") & F.lower(joined).contains("budget estimates")
    about = rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(top, F.struct("row_no", joined.alias("t"))))), lambda x: x["t"]), " ").alias("text"),
        F.max_by(longest, F.when(top & (F.size(titles) > 0), F.struct(lines, -F.col("row_no")))).alias("title"),
        F.min(F.when(in_header, F.col("row_no"))).alias("header_no"), F.min_by("cells", F.when(in_header, F.col("row_no"))).alias("header"),
        F.coalesce(F.min(F.when(F.exists("cells", lambda c: c.startswith(SECTION)), F.col("row_no"))), F.least(F.max("row_no") + 1, F.lit(SECTION_ROW))).alias("section_no"),
    )
    met = rows.join(about.select(*keys, "header_no", "section_no"), keys)
    is_split = (F.col("row_no") > F.col("header_no")) & (F.col("row_no") <= F.col("header_no") + SPLIT_ROWS) & F.exists("cells", lambda c: F.lower(c) == "total")
    is_net = (F.col("row_no") < F.col("section_no")) & F.exists("cells", lambda c: c == NET)
    found = met.groupBy(*keys).agg(F.min_by("cells", F.when(is_split, F.col("row_no"))).alias("split"), F.min_by("cells", F.when(is_net, F.col("row_no"))).alias("net"))
    place = F.transform("lines", lambda x: x.rlike(DEMAND))
    marker = F.array_position(place, True).cast("int")
    joined_lines = lambda a: F.trim(F.array_join(a, " "), F.lit(" ,-"))
    before = joined_lines(F.slice("lines", F.lit(1), F.greatest(marker - 1, F.lit(0))))
    sheets = about.join(found, keys).withColumn("lines", _title(F.coalesce("title", F.lit("")))).withColumn("demand_no", F.nullif(F.regexp_extract("text", DEMAND, 1), F.lit("")))
    same_line = F.trim(F.regexp_replace(F.get("lines", marker - 1), DEMAND, ""), F.lit(" ,-"))
    owner = F.when(marker > 0, F.when(before != "", before).otherwise(same_line)).otherwise("")
    name = F.when(marker > 0, joined_lines(F.slice("lines", marker + 1, F.size("lines")))).otherwise("")
    sheets = sheets.withColumn("owner", owner).withColumn("name", name).withColumn("stages", _stages(F.col("header"), F.col("split")))
    lakh, crore = F.col("text").rlike(LAKH), F.col("text").rlike(CRORE)
    reason = (
        F.when(lakh & ~crore, "amounts in lakh").when(~crore, "no unit").when(F.col("owner") == "", "no owner").when(F.coalesce(F.size("stages"), F.lit(0)) <= 0, "no header of stages").when(F.col("net").isNull(), "no Net row")
    )
    sheets = sheets.withColumn("reason", reason)
    each = sheets.where("reason is null").select(*keys, "demand_no", F.coalesce(F.nullif("name", F.lit("")), "owner").alias("entity"), "owner", "net", F.explode("stages").alias("s"))
    out = each.select(*keys, "demand_no", "entity", "owner", "s.fy", "s.stage", amount(F.get("net", F.col("s.total"))).alias("amount"), "s.header").where("amount is not null")
    return out, sheets.where("reason is not null").select(*keys, "reason")


def _stages(header: Column, split: Column) -> Column:
    """An array of (stage, fy, total, header): total is the first Total column from the stage's own on and before the next stage's."""
    starts = F.filter(F.transform(header, lambda c, k: F.struct(c.alias("header"), k.alias("at"))), lambda x: x["header"] != "")
    totals = F.filter(F.transform(split, lambda c, k: F.when(F.lower(c) == "total", k)), lambda k: k.isNotNull())

    def read(x: Column, k: Column) -> Column:
        low, after = F.lower(x["header"]), F.coalesce(F.get(starts, k + 1)["at"], F.lit(1_000_000))
        stage = F.lit(None).cast("string")
        for marker, name in reversed(STAGES):
            stage = F.when(low.startswith(marker), name).otherwise(stage)
        label = F.concat(F.regexp_extract(x["header"], YEARS, 1), F.lit("-"), F.right(F.regexp_extract(x["header"], YEARS, 2), F.lit(2)))
        total = F.array_min(F.filter(totals, lambda t: (t >= x["at"]) & (t < after)))
        return F.struct(stage.alias("stage"), cal.from_label(label).alias("fy"), total.alias("total"), x["header"].alias("header"))

    return F.filter(F.transform(starts, read), lambda s: s["stage"].isNotNull() & s["fy"].isNotNull() & s["total"].isNotNull())
