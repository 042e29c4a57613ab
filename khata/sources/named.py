"""The named sources: how each one's tables become facts. All take landed pages(page_id, url, html).

Every reader returns (rows, errors): amounts that can't be read are errors and never missing figures, and
rows that total others are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import calendar as cal
from khata.functions.money import parse_crore, unit_of
from khata.functions.text import clean_cell, normalise_name
from khata.sources import tabular, web

# Labels of an employment scheme's table and the stages they stand for, and what marks a ratio or a balance.
EMPLOYMENT = {
    "central release": "RELEASE", "central fund released": "RELEASE", "release of central share": "RELEASE", "total expenditure": "UTILIZATION", "total exp.": "UTILIZATION",
}
NO_STAGE = ("percentage", "percent", "% of", "balance", "available")
# Labels of a marketplace's page by metric.
MARKET = {
    "gross_merchandise_value": ("gmv", "gross merchandise value", "order value", "total value"), "order_count": ("orders", "total orders", "order count"),
    "seller_count": ("sellers", "total sellers", "sellers and service providers"), "buyer_count": ("buyers", "total buyers", "buyer organisations"),
}
# What marks a table about persons.
PERSONAL = (
    "registration", "reg no", "reg. no", "aadhaar", "aadhar", "account no", "account number", "bank account", "ifsc", "beneficiary name", "farmer name", "beneficiary id", "mobile", "village", "father",
)


# A water mission's labels of money by stage, and of counts of connections.
WATER = {
    "central release": "RELEASE", "central fund released": "RELEASE", "central share released": "RELEASE", "total expenditure": "UTILIZATION", "expenditure incurred": "UTILIZATION", "total exp.": "UTILIZATION",
}
COVERAGE = ("tap connections", "tap water connections", "household connections", "har ghar jal", "functional household")
# How a question's number, a ministry, a day and a year are printed in lists of answers, and what names a column of money spent.
QUESTION = r"(?i)(?:question|q\.?)\s*(?:no\.?)?\s*[:\-]?\s*([0-9]{1,5})"
OFFICE = r"(?i)((?:ministry|department) of [A-Za-z ,&]+)"
ANSWERED = r"([0-9]{1,2}[ /-][A-Za-z]{3,9}[ /-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})"
NEAR_DAY = r"[0-9]{1,2}[ /-][A-Za-z]{3,9}[ /-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
MENTION = r"(?i)(?:₹|Rs\.?|INR)\s*[0-9,]+(?:\.[0-9]+)?\s*(?:lakh\s+crore|thousand\s+crore|crore|lakh|cr)\b"
YEAR_PAIR = r"(20[0-9]{2})\s*[-/]\s*([0-9]{2,4})"
SPENT = "utilis|utiliz|expenditure|spent"


# Labels of rows that total others.
TOTALS = ("total", "grand total", "total expenditure", "total receipts", "gross total", "net total", "total of ministry")


# Labels of money transferred and of counts of persons, longest first, and an amount as it stands in text.
TRANSFERRED = ("total funds transferred", "funds transferred", "total amount released", "amount disbursed", "amount transferred", "total benefit released")
COUNTED = ("total beneficiaries", "beneficiaries covered", "registered beneficiaries", "total farmers", "farmers benefited")
AMOUNT = r"(?:₹|rs\.?|inr)?\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:lakh\s+crore|thousand\s+crore|crore|cr\b\.?|lakh)?"


def is_total(label: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(label), "[^a-z ]", ""))
    return bare.isin(*TOTALS) | bare.startswith("total ")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds any of the words."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def longest_count(text: Column) -> Column:
    """The number in the longest group of digits and commas, the first of equals; NULL if there is none."""
    groups = F.transform(F.regexp_extract_all(text, F.lit("[0-9][0-9,]*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))
    return F.aggregate(groups, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)).try_cast("long")


def page_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("prose", clean_cell(F.regexp_replace("html", "<[^>]*>", " ")))


def _split(parsed: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of parsed(..., raw, p)."""
    return parsed.where("p.status = 'value'").select(*keep, F.col("p.value").alias("amount")), parsed.where("p.status = 'error'").select(*keep, "raw", F.col("p.reason").alias("reason"))


def _columns(pages: DataFrame, words: list[str], at: dict[str, str]) -> DataFrame:
    """Rows of the first table with the words, one column per name, found by a word of the header."""
    rows = web.table_rows(pages)
    text = F.lower(F.array_join("cells", " "))
    heads = rows.where(F.forall(F.array(*map(F.lit, words)), lambda w: text.contains(w))).groupBy("page_id").agg(F.min_by("cells", F.struct("table_no", "row_no")).alias("header"))
    body = web.table_with(rows, words).join(heads, "page_id")
    place = lambda word: F.array_position(F.transform("header", lambda h: F.lower(h).rlike(word)), True).cast("int")
    return body.select("page_id", "row_no", "header", *[F.when(place(w) > 0, F.get("cells", place(w) - 1)).alias(n) for n, w in at.items()])


def monthly_accounts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cumulative spend by entity; the period stands in the heading, the unit in the page."""
    heading = F.regexp_extract(F.col("prose"), r"(?i)((?:[A-Za-z]+\.?\s*(?:-|to)\s*)?[A-Za-z]+,? (?:19|20)\d\d)", 1)
    about = page_text(pages).select("page_id", cal.period_of(heading).alias("period"), unit_of(F.col("prose")).alias("unit"))
    rows = _columns(pages, ["entity"], {"entity": "entity|ministry", "raw": "cumulative|expenditure|spend"}).join(about, "page_id").where(~is_total(F.col("entity")))
    parsed = rows.withColumn("p", parse_crore(F.col("raw"), F.col("unit")))
    found = parsed.select("page_id", "entity", F.lit("EXPENDITURE").alias("stage"), F.col("period.end").alias("period_end"), F.lit(True).alias("is_cumulative"), F.lit(True).alias("is_provisional"), "raw", "p")
    keep = ["page_id", "entity", "stage", "period_end", "is_cumulative", "is_provisional"]
    rows, errors = _split(found, *keep)
    undated = found.where("p.status = 'value' and period_end is null").select(*keep, "raw", F.lit("no period").alias("reason"))
    return rows.where("period_end is not null"), errors.union(undated)


def scheme_releases(pages: DataFrame, fy: str) -> tuple[DataFrame, DataFrame]:
    """Releases by scheme as of the date in the page, never after the end of the year."""
    day = cal.parse_day(F.regexp_extract(F.col("prose"), r"(?i)as (?:on|of):? *([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})", 1))
    about = page_text(pages).select("page_id", F.least(day, cal.fy_end(F.lit(fy))).alias("period_end"), unit_of(F.col("prose")).alias("unit"))
    rows = _columns(pages, ["scheme"], {"entity": "scheme", "raw": "release|amount"}).join(about, "page_id").where(~is_total(F.col("entity")))
    parsed = rows.withColumn("p", parse_crore(F.col("raw"), F.col("unit"))).withColumn("stage", F.lit("RELEASE"))
    return _split(parsed, "page_id", "entity", "stage", "period_end")


def tenders(pages: DataFrame) -> DataFrame:
    """tender_id, title, org_raw, value, reason, published; a bad value keeps the row."""
    rows = _columns(pages, ["title", "organisation"], {"reference": "reference|ref", "title": "title", "org_raw": "organi[sz]ation", "raw": "value", "published": "publish"})
    p = parse_crore(F.col("raw"), F.lit("rupees"))
    ident = F.coalesce(F.nullif(F.regexp_extract(F.col("reference"), r"([0-9]{4}_[A-Za-z0-9]+_[0-9]+_[0-9]+)", 1), F.lit("")), F.substring(F.sha2(F.concat_ws("|", "title", "org_raw").cast("binary"), 256), 1, 16))
    return rows.select(ident.alias("tender_id"), "title", "org_raw", p["value"].alias("value"), p["reason"].alias("reason"), cal.parse_day(F.col("published")).alias("published"))


def employment(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Amounts by stage; ratios and balances are no stage."""
    unit = page_text(pages).select("page_id", unit_of(F.col("prose")).alias("unit"))
    stage = F.coalesce(*[F.when(F.lower("label").contains(k), F.lit(v)) for k, v in EMPLOYMENT.items()])
    rows = _columns(pages, ["particulars"], {"label": "particulars", "raw": "amount"}).join(unit, "page_id").withColumn("stage", stage)
    rows = rows.where("stage is not null").where(~_holds(F.lower("label"), NO_STAGE))
    return _split(rows.withColumn("p", parse_crore(F.col("raw"), F.col("unit"))), "page_id", "label", "stage")


def marketplace(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One figure per metric, the first; counts apart from money."""
    cells = web.table_rows(pages).where(F.size("cells") >= 2).select("page_id", "table_no", "row_no", F.col("cells")[0].alias("label"), F.col("cells")[1].alias("raw"))
    metric = F.coalesce(*[F.when(_holds(F.lower("label"), names), F.lit(k)) for k, names in MARKET.items()])
    first = cells.withColumn("metric", metric).where("metric is not null").groupBy("page_id", "metric").agg(F.min_by("raw", F.struct("table_no", "row_no")).alias("raw"))
    money = F.col("metric") == "gross_merchandise_value"
    counts = first.where(~money).select("page_id", "metric", longest_count(F.col("raw")).alias("n"))
    return first.where(money).withColumn("p", parse_crore(F.col("raw"))).select("page_id", "metric", F.col("p.value").alias("amount"), F.col("p.reason").alias("reason")), counts


def farmer_transfers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(money, counts) of a page on transfers to persons: page_id, stage or label, amount or n, and reason where an amount can't be read.

    Tables whose first row names a mark of persons are not read at all, nor are rows that do; then come boxes of figures (up to
    160 characters) and the text beside the tables. Only the listed labels give an amount, the one after the label; of each
    stage the first stands, and of each label of a count.
    """
    about = page_text(pages).select("page_id", unit_of(F.col("prose")).alias("unit"))
    rows = _within_tables(pages)
    text = F.lower(F.array_join("cells", " "))
    personal = rows.where((F.col("at") == 0) & _holds(text, PERSONAL)).select("page_id", "table_no")
    records = rows.where((F.col("at") > 0) & (F.size("cells") >= 2) & ~_holds(text, PERSONAL)).join(personal, ["page_id", "table_no"], "left_anti")
    in_tables = records.select("page_id", F.lit(0).alias("kind"), F.col("table_no").alias("x"), F.col("row_no").alias("y"), clean_cell(F.col("cells")[0]).alias("label"), clean_cell(F.col("cells")[1]).alias("raw"))
    outside = pages.select("page_id", F.regexp_replace("html", "(?is)<table.*?</table>", " ").alias("html"))
    bare = lambda c: clean_cell(F.regexp_replace(c, "<[^>]*>", " "))
    boxes = boxes_of(outside).select("page_id", F.lit(1).alias("kind"), "x", "text")
    spoken = boxes.union(outside.select("page_id", F.lit(2).alias("kind"), F.lit(0).alias("x"), bare(F.col("html")).alias("text")))
    named_in = spoken.select("page_id", "kind", "x", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?i)((?:{'|'.join((*TRANSFERRED, *COUNTED))})[^0-9]{{0,40}}{AMOUNT})"), F.lit(1))).alias("y", "said"))
    said = named_in.select("page_id", "kind", "x", "y", F.regexp_extract("said", f"(?i)({'|'.join((*TRANSFERRED, *COUNTED))})", 1).alias("label"), F.regexp_extract("said", f"(?i)({AMOUNT})$", 1).alias("raw"))
    every = in_tables.union(said)
    order = F.struct("kind", "x", "y")
    money = every.where(_holds(F.lower("label"), TRANSFERRED)).groupBy("page_id").agg(F.min_by("raw", order).alias("raw")).join(about, "page_id")
    parsed = money.withColumn("p", parse_crore(F.col("raw"), F.col("unit")))
    counts = every.where(_holds(F.lower("label"), COUNTED) & ~_holds(F.lower("label"), TRANSFERRED)).withColumn("label", F.lower("label"))
    counts = counts.groupBy("page_id", "label").agg(F.min_by("raw", order).alias("raw")).select("page_id", "label", longest_count(F.col("raw")).alias("n"))
    return parsed.select("page_id", F.lit("RELEASE").alias("stage"), F.col("p.value").alias("amount"), F.col("p.reason").alias("reason")), counts


def _within_tables(pages: DataFrame) -> DataFrame:
    """The rows of all tables, with at: their place in their own table, from 0."""
    rows = web.table_rows(pages)
    heads = rows.groupBy("page_id", "table_no").agg(F.min("row_no").alias("__first"))
    return rows.join(heads, ["page_id", "table_no"]).withColumn("at", F.col("row_no") - F.col("__first")).drop("__first")


def boxes_of(pages: DataFrame) -> DataFrame:
    """page_id, x and text of the boxes of figures on a page, of 160 characters at most."""
    boxes = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?is)<(\w+)[^>]*\bclass\s*=\s*["'][^"']*(?:stat|tile|card|count)[^>]*>(.*?)</\1>"""), F.lit(2))).alias("x", "html"))
    return boxes.select("page_id", "x", web.plain(F.col("html")).alias("text")).where((F.char_length("text") <= 160) & (F.col("text") != ""))


def water_mission(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(funds, coverage, errors): money by stage from the first table on funds, and counts of connections, never money.

    funds: page_id, label, stage, fy, amount; the unit stands in the amount's column, else in the page. Percentages and balances
    are no stage. coverage: page_id, label and n, the longest number of each box that names connections.
    """
    about = page_text(pages).select("page_id", unit_of(F.col("prose")).alias("unit"), _year_in(F.col("prose")).alias("fy"))
    rows = _within_tables(pages)
    heads = rows.where((F.col("at") == 0) & F.lower(F.array_join("cells", " ")).contains("fund") & F.lower(F.array_join("cells", " ")).contains("amount"))
    first = heads.groupBy("page_id").agg(F.min(F.struct("table_no", F.col("cells").alias("header"))).alias("h")).select(F.col("page_id").alias("__page"), "h.table_no", "h.header")
    place = F.array_position(F.transform("header", lambda c: F.lower(c).contains("amount")), True).cast("int") - 1
    body = rows.withColumnRenamed("table_no", "__table").join(first, (F.col("page_id") == F.col("__page")) & (F.col("__table") == F.col("table_no"))).where("at > 0").join(about, "page_id")
    label = clean_cell(F.get("cells", F.lit(0)))
    low = F.lower(label)
    stage = F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in WATER.items()])
    read = body.select("page_id", label.alias("label"), F.when(~_holds(low, NO_STAGE), stage).alias("stage"), "fy", clean_cell(F.get("cells", place)).alias("raw"), F.coalesce(unit_of(F.get("header", place)), "unit").alias("unit"))
    parsed = read.where("stage is not null and raw is not null").withColumn("p", parse_crore(F.col("raw"), F.col("unit")))
    funds, errors = _split(parsed, "page_id", "label", "stage", "fy")
    coverage = boxes_of(pages).where(_holds(F.lower("text"), COVERAGE)).select("page_id", F.col("text").alias("label"), longest_count(F.col("text")).alias("n")).where("n is not null")
    return funds, coverage, errors


def _year_in(text: Column) -> Column:
    """The first pair of years of a text as a fiscal year; NULL if it is none."""
    return cal.from_label(F.concat(F.regexp_extract(text, YEAR_PAIR, 1), F.lit("-"), F.right(F.regexp_extract(text, YEAR_PAIR, 2), F.lit(2))))


def parliament_answers(pages: DataFrame, base: str = "https://sansad.in") -> tuple[DataFrame, DataFrame]:
    """(answers, errors): the linked answers of each list, and lists without any.

    answers: page_id, question_number, title, url, ministry, answered_on. A link to a PDF with a title of five characters counts;
    what stands beside it between the tags of rows, items and blocks tells its question, ministry and day; without a number
    there or in the title, the file's name is one. Of a question that is listed again the first link stands.
    """
    parts = pages.select("page_id", F.posexplode(F.split("html", r"(?i)</?(?:tr|li|div)\b[^>]*>")).alias("x", "part"))
    anchors = parts.select("page_id", "x", web.plain(F.col("part")).alias("context"), F.posexplode(F.regexp_extract_all("part", F.lit(r"""(?is)(<a\s[^>]*href\s*=\s*["'][^"']+["'][^>]*>.*?</a>)"""), F.lit(1))).alias("y", "anchor"))
    href = F.trim(F.regexp_extract("anchor", r"""(?is)href\s*=\s*["']([^"']+)["']""", 1))
    links = anchors.select("page_id", "x", "y", "context", href.alias("href"), web.plain(F.col("anchor")).alias("title")).where(F.lower(F.substring_index("href", "?", 1)).endswith(".pdf") & (F.char_length("title") >= 5))
    number = lambda c: F.nullif(F.regexp_extract(c, QUESTION, 1), F.lit(""))
    stem = F.substring_index(F.substring_index("href", "/", -1), ".", 1)
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace("href", "^/+", "")))
    day = cal.parse_day(F.regexp_replace(F.regexp_extract("context", ANSWERED, 1), "/", "-"))
    rows = links.select("page_id", "x", "y", F.coalesce(number("context"), number("title"), stem).alias("question_number"), "title", url.alias("url"), F.nullif(clean_cell(F.regexp_extract("context", OFFICE, 1)), F.lit("")).alias("ministry"), day.alias("answered_on"))
    first = rows.groupBy("page_id", "question_number").agg(F.min(F.struct("x", "y", "title", "url", "ministry", "answered_on")).alias("r"))
    answers = first.select("page_id", "question_number", "r.title", "r.url", "r.ministry", "r.answered_on")
    empty = pages.join(answers.select("page_id"), "page_id", "left_anti").select("page_id", F.lit("no answers in the list").alias("reason"))
    return answers, empty


def utilisation(cells: DataFrame, keys: list[str], default_fy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of an answer's tables cells(keys, row_no, cells): what each scheme used, from the first column on money spent.

    The header names the year, or default_fy is it; a table without a year is an error, for its figures have no place. The unit stands
    in the column's heading, else anywhere in the header. Rows of totals and figures not reported are left out.
    """
    header = tabular.header_row(cells, keys)
    at = F.array_position(F.transform("header", lambda c: F.lower(c).rlike(SPENT)), True).cast("int") - 1
    year = F.coalesce(_year_in(F.array_join("header", " | ")), F.lit(default_fy))
    told = header.select(*keys, "header", "header_no", at.alias("at"), year.alias("fy")).where("at >= 0")
    undated = told.where("fy is null").select(*keys, F.lit(None).cast("string").alias("scheme"), F.lit(None).cast("string").alias("raw"), F.lit("no fiscal year").alias("reason"))
    body = cells.join(told.where("fy is not null"), keys).where("row_no > header_no")
    read = body.select(*keys, clean_cell(F.get("cells", F.lit(0))).alias("scheme"), "fy", clean_cell(F.get("cells", F.col("at"))).alias("raw"), F.coalesce(unit_of(F.get("header", F.col("at"))), unit_of(F.array_join("header", " "))).alias("unit"))
    parsed = read.where((F.char_length("scheme") >= 2) & ~is_total(F.col("scheme"))).withColumn("p", parse_crore(F.col("raw"), F.col("unit")))
    rows, errors = _split(parsed, *keys, "scheme", "fy")
    return rows, errors.select(*keys, "scheme", "raw", "reason").union(undated)


def press_releases(pages: DataFrame, base: str = "https://pib.gov.in", listed_on: Column | None = None) -> DataFrame:
    """release_id, ministry, ministry_normalised, title, url, published_on and amount_mentions of every link once.

    The ministry is the heading above the link, carried down. A release is of the day of the list, if that is known, else of the
    day beside its link, in the same row, item or block. amount_mentions are the amounts in its title, as printed.
    """
    token = r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>|<a\s[^>]*PRID=[0-9]+[^>]*>.*?</a>)"
    blocks = pages.select("page_id", F.posexplode(F.split("html", r"(?i)</?(?:tr|li|div)\b[^>]*>")).alias("x", "block"))
    items = blocks.select("page_id", "x", web.plain(F.col("block")).alias("context"), F.posexplode(F.regexp_extract_all("block", F.lit(token), 1)).alias("y", "part")).withColumn("pos", F.struct("x", "y"))
    bare = web.plain(F.col("part"))
    is_heading = F.col("part").rlike("(?i)^<h[1-6]")
    heading = F.when(is_heading & (F.char_length(bare) < 160) & (bare != ""), bare)
    carried = tabular.carry_down(items.withColumn("ministry", heading), "ministry", ["page_id"], "pos").where(~is_heading)
    href = F.trim(F.regexp_extract("part", r"""(?is)href\s*=\s*["']?([^"'\s>]+)""", 1))
    url = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(href, "^/+", "")))
    near = cal.parse_day(F.regexp_replace(F.regexp_extract("context", NEAR_DAY, 0), "/", "-"))
    links = carried.select("page_id", "pos", "ministry", bare.alias("title"), url.alias("url"), F.coalesce(listed_on, near).alias("published_on") if listed_on is not None else near.alias("published_on"), F.regexp_extract("part", "(?i)PRID=([0-9]+)", 1).alias("release_id"))
    first = links.groupBy("release_id").agg(F.min_by(F.struct("ministry", "title", "url", "published_on"), F.struct("page_id", "pos")).alias("r"))
    return first.select("release_id", "r.ministry", normalise_name(F.col("r.ministry")).alias("ministry_normalised"), "r.title", "r.url", "r.published_on", F.regexp_extract_all("r.title", F.lit(MENTION), F.lit(0)).alias("amount_mentions"))


def state_budgets(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an at-a-glance table by stage and year of its header cells; actuals are the whole year's expenditure."""
    unit = page_text(pages).select("page_id", unit_of(F.col("prose")).alias("unit"))
    rows = web.table_rows(pages)
    heads = rows.where(F.exists("cells", lambda c: c.rlike(r"[12][0-9]{3}-[0-9]{2}"))).groupBy("page_id", "table_no").agg(F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_no"))
    cells = rows.join(heads, ["page_id", "table_no"]).where("row_no > header_no").select("page_id", F.col("cells")[0].alias("label"), "header", F.posexplode("cells").alias("k", "raw")).where("k > 0")
    head = F.get("header", F.col("k"))
    stage = F.when(F.lower(head).rlike("actual|account"), "EXPENDITURE").when(F.lower(head).rlike(r"revised|\bre\b"), "RE").when(F.lower(head).rlike(r"budget|\bbe\b"), "BE")
    kind = F.when(F.lower("label").contains("capital"), "capital").when(F.lower("label").contains("revenue"), "revenue").when(F.lower("label").contains("total expenditure"), "total")
    rows = cells.select("page_id", "label", kind.alias("head"), stage.alias("stage"), cal.from_label(F.regexp_extract(head, r"([12][0-9]{3}-[0-9]{2,4})", 1)).alias("fy"), F.lower(head).contains("provisional").alias("is_provisional"), "raw").join(unit, "page_id")
    rows = rows.where("head is not null and stage is not null").withColumn("p", parse_crore(F.col("raw"), F.col("unit")))
    return _split(rows, "page_id", "label", "head", "stage", "fy", "is_provisional")


def union_budget(demands: DataFrame, excluded: list[str]) -> DataFrame:
    """(entity, fy, stage, amount) of demands(demand, ministry, fy, stage, amount): nation over all, ministries without the central charges."""
    nation = demands.groupBy("fy", "stage").agg(F.sum("amount").alias("amount")).select(F.lit("india").alias("entity"), "fy", "stage", "amount")
    own = demands.where(~normalise_name(F.col("demand")).isin(*excluded)).groupBy("ministry", "fy", "stage").agg(F.sum("amount").alias("amount")).select(F.col("ministry").alias("entity"), "fy", "stage", "amount")
    return nation.union(own)


#: Names by which sources are run.
SOURCES: dict[str, Callable] = {
    "monthly_accounts": monthly_accounts, "scheme_releases": scheme_releases, "tenders": tenders, "employment": employment, "marketplace": marketplace,
    "farmer_transfers": farmer_transfers, "press_releases": press_releases, "state_budgets": state_budgets, "union_budget": union_budget,
    "water_mission": water_mission, "parliament_answers": parliament_answers,
}


def source(name: str) -> Callable:
    if name not in SOURCES:
        raise KeyError(f"unknown source: {name}")
    return SOURCES[name]
