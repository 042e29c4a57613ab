"""Queries on intake with manifests and on demand sheets, over files and grids that Spark makes of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.functions import text
from khata.functions.calendar import fy_of
from khata.oracle import fy, with_parts
from khata.plans import projection as p
from khata.plans.fiscal_queries import query_into, r6
from khata.operators import quality, search
from khata.plans.text_queries import grams
from khata.sources import catalogue, intake, named, tabular, workbook

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

def now():
    return F.lit("2025-06-01T00:00:00Z").cast("timestamp")


def dropped_files(spark, sf_dir) -> DataFrame:
    """Each page as a file; of ten, four have a manifest with something wrong, and one has none."""
    k = F.col("page_id") % 10
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 150).cast("int")).cast("string")
    fields = {
        "source_url": F.when(k == 1, "ftp://files").otherwise(F.concat(F.lit("https://data.example.org/"), F.col("page_id"))),
        "retrieved_at": F.when(k == 2, F.concat(day, F.lit("T10:00:00"))).when(k == 3, "2026-01-01T00:00:00Z").otherwise(F.concat(day, F.lit("T10:00:00+05:30"))),
        "retrieved_by": F.when(k == 1, " ").otherwise("clerk"), "document_date": F.when(k == 5, day), "note": F.lit("by hand"), "titel": F.when(k == 4, "typo"),
    }
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = p.table(spark, sf_dir, "pages")
    manifest = F.to_json(F.struct(*[v.alias(f) for f, v in fields.items()]))
    beside = pages.where("page_id % 10 != 6").select(F.concat(name, F.lit(intake.SUFFIX)).alias("name"), manifest.alias("content"))
    return pages.select(name.alias("name"), F.col("html").alias("content")).union(beside)


@query("""WITH d AS (SELECT page_id, page_id % 10 AS k, DATE '2025-01-01' + CAST(page_id % 150 AS INTEGER) AS day, html FROM pages)
    SELECT 'page-' || page_id || '.html' AS name, CAST(day AS TIMESTAMP) + INTERVAL 270 MINUTE AS retrieved_at, CASE WHEN k = 5 THEN day END AS document_date, row_number() OVER (ORDER BY day, 'page-' || page_id || '.html') AS place
    FROM d WHERE k IN (0, 5, 7, 8, 9) AND strlen(html) > 0""")
def intake_of_files(spark, sf_dir) -> DataFrame:
    """Documents whose manifests are in order, and their places from the oldest download on, told by day first."""
    good, _ = intake.intake(dropped_files(spark, sf_dir), now())
    # A place is the number of files of earlier days, and the place within the day.
    from pyspark.sql import Window

    day = F.to_date("retrieved_at")
    inside = F.row_number().over(Window.partitionBy("day").orderBy("retrieved_at", "name"))
    rows = good.select("name", "retrieved_at", "document_date", day.alias("day")).withColumn("inside", inside)
    days = rows.groupBy(F.col("day").alias("d")).agg(F.count("*").alias("n"))
    before = days.select("d", F.coalesce(F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a day
    return rows.join(before, F.col("day") == F.col("d")).select("name", "retrieved_at", "document_date", (F.col("before") + F.col("inside")).alias("place"))


@query("""SELECT 'page-' || page_id || '.html' AS name, CASE page_id % 10 WHEN 1 THEN 'source_url is not public; no retrieved_by' WHEN 2 THEN 'retrieved_at has no zone' WHEN 3 THEN 'retrieved_at is in the future'
    WHEN 4 THEN 'unknown fields: titel' WHEN 6 THEN 'no manifest' ELSE 'empty file' END AS reasons FROM pages WHERE page_id % 10 IN (1, 2, 3, 4, 6) OR strlen(html) = 0""")
def intake_errors(spark, sf_dir) -> DataFrame:
    """Files that may not enter, with every reason."""
    _, bad = intake.intake(dropped_files(spark, sf_dir), now())
    return bad.select("name", F.array_join("reasons", "; ").alias("reasons"))


def sheets(spark, sf_dir) -> DataFrame:
    """A demand sheet of every ministry and year, laid out from its orders; columns shift from sheet to sheet."""
    orders, customers = p.table(spark, sf_dir, "orders"), p.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    price = F.col("o_totalprice").cast(p.MONEY)
    at = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, price)).cast(p.MONEY)
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nk"), fy_of(F.to_date("o_orderdate")).alias("fy")).agg(at("P").alias("spent"), at("O").alias("re"), at("F").alias("be"))
    y = F.substring("fy", 3, 4).cast("int")
    s = lambda x: x.cast("string")
    pad = F.array_repeat(F.lit(""), (F.col("nk") % 3).cast("int"))
    row = lambda *cells: F.concat(pad, F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]))
    years = lambda a: F.concat(s(y + a - 1), F.lit("-"), s(y + a))
    shown = lambda c, part=1: F.coalesce(F.format_number(c * part, 2), F.lit("..."))
    line = lambda label, part: row(label, "", shown(F.col("spent"), part), "", shown(F.col("re"), part), "", "", shown(F.col("be"), part))
    unit = F.when(F.col("nk") % 7 == 5, "(In ₹ Lakhs)").when(F.col("nk") % 7 == 6, "(amounts)").otherwise("(In ₹ Crores)")
    title = F.concat(F.lit("Ministry "), s(F.col("nk")), F.lit("\nDemand No. "), s(F.col("nk") + 1), F.lit("\nDepartment of  Nation "), s(F.col("nk")))
    grid = F.array(
        row(title), row(unit), row("", F.concat(F.lit("Actuals "), years(-1)), "", F.concat(F.lit("Revised Estimates "), years(0)), "", F.concat(F.lit("Budget Estimates "), years(0)), "", ""),
        row("", "Revenue", "Total", "Revenue", "Total", "Revenue", "Capital", "Total"), line("Gross", 2), line("Recoveries", 1), F.when(F.col("nk") % 7 != 4, line("Net", 1)).otherwise(line("Nett", 1)), row("A. The Budget allocation"), line("Net", 3),
    )
    return sums.select("nk", "fy", F.posexplode(grid).alias("row_no", "cells"))


@query(with_parts("ministry") + f""", s AS (
        SELECT c_nationkey AS nk, {fy('o_orderdate')} AS sheet_fy, sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'P') AS a, sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'O') AS r,
               sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 7 < 4 GROUP BY 1, 2),
    u AS (SELECT nk, sheet_fy, 'EXPENDITURE' AS stage, -1 AS shift, a AS amount FROM s UNION ALL SELECT nk, sheet_fy, 'RE', 0, r FROM s UNION ALL SELECT nk, sheet_fy, 'BE', 0, b FROM s)
    SELECT nk, sheet_fy, CAST(nk + 1 AS VARCHAR) AS demand_no, 'Department of Nation ' || nk AS entity, 'Ministry ' || nk AS owner, 'FY' || (CAST(substr(sheet_fy, 3) AS INTEGER) + shift) AS fy, stage, round(CAST(amount AS DOUBLE), 6) AS amount FROM u WHERE amount IS NOT NULL""")
def demand_sheets(spark, sf_dir) -> DataFrame:
    """The stages of every demand, read from its sheet by position."""
    rows, _ = workbook.demand_sheets(sheets(spark, sf_dir).withColumnRenamed("fy", "sheet_fy"), ["nk", "sheet_fy"])
    return rows.select("nk", "sheet_fy", "demand_no", "entity", "owner", "fy", "stage", *r6("amount"))


@query(f"""SELECT DISTINCT c_nationkey AS nk, {fy('o_orderdate')} AS fy, CASE c_nationkey % 7 WHEN 4 THEN 'no Net row' WHEN 5 THEN 'amounts in lakh' ELSE 'no unit' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 7 >= 4""")
def demand_sheet_errors(spark, sf_dir) -> DataFrame:
    """Sheets that can't be read, and why."""
    return workbook.demand_sheets(sheets(spark, sf_dir), ["nk", "fy"])[1]


def answers_of_a_catalogue(spark, sf_dir) -> DataFrame:
    """Answers of ten goods each; ids stand under other names, every fifth record comes from the public."""
    k = F.col("p_partkey")
    record = F.to_json(F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("r-"), k)).alias("index_name"), F.when(k % 3 == 1, F.concat(F.lit("r-"), k)).alias("resource_id"), F.when(k % 3 == 2, F.concat(F.lit(" r-"), k)).alias("id"),
        F.when(k % 7 != 0, F.col("p_name")).alias("title"), F.array("p_type", F.lit(""), "p_brand").alias("org_type"), F.when(k % 5 == 0, catalogue.COMMUNITY).otherwise("office").alias("source"),
    ))
    goods = p.table(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("page")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), record.alias("r")))).alias("rs"), F.count("*").alias("n"))  # ten rows a group
    under = F.when(F.col("page") % 2 == 0, '{"records": [').otherwise('{"records": [], "field": [{"id": "title"}, {"name": "source"}], "data": [')
    return goods.select("page", F.concat(under, F.array_join("rs.r", ","), F.lit('], "total": "'), "n", F.lit('", "title": "page"}')).alias("answer"))


@query("""SELECT 'r-' || p_partkey AS resource_id, p_name AS title, p_type || ', ' || p_brand AS organisation FROM part WHERE p_partkey % 7 != 0 AND p_partkey % 5 != 0 AND contains(lower(p_name), 'gear')""")
def catalogue_search(spark, sf_dir) -> DataFrame:
    """Official entries of a catalogue whose titles hold a word."""
    found = catalogue.search(catalogue.entries(answers_of_a_catalogue(spark, sf_dir)), "GEAR")
    return found.select("resource_id", "title", "organisation")


@query("""WITH f AS (SELECT p_partkey // 10 AS page, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1), r AS (SELECT f.page, n, k, p_name, p_type, p_brand FROM f JOIN part ON p_partkey = k WHERE f.page % 2 = 0),
    u AS (SELECT page, n, 'id' AS name, CASE WHEN k % 3 = 2 THEN ' r-' || k END AS v FROM r WHERE k % 3 = 2 UNION ALL SELECT page, n, 'index_name', 'r-' || k FROM r WHERE k % 3 = 0 UNION ALL SELECT page, n, 'resource_id', 'r-' || k FROM r WHERE k % 3 = 1
          UNION ALL SELECT page, n, 'title', p_name FROM r WHERE k % 7 != 0 UNION ALL SELECT page, n, 'org_type', '["' || p_type || '","","' || p_brand || '"]' FROM r
          UNION ALL SELECT page, n, 'source', CASE WHEN k % 5 = 0 THEN 'visualize.data.gov.in' ELSE 'office' END FROM r)
    SELECT page, n AS record_count, CAST(row_number() OVER (PARTITION BY page ORDER BY name) - 1 AS INTEGER) AS place, name, v AS sample FROM u
    UNION ALL SELECT page, n, x.place, x.name, '(empty in the first record)' FROM f, (VALUES (0, 'title'), (1, 'source')) x(place, name) WHERE page % 2 = 1""")
def resource_shapes(spark, sf_dir) -> DataFrame:
    """The fields of every resource, declared or those of its first record, each with a sample."""
    return catalogue.shape(answers_of_a_catalogue(spark, sf_dir), "page").select("page", "record_count", "place", "name", "sample")


def mission_pages(spark, sf_dir) -> DataFrame:
    """A page of funds and connections for every nation, made of its orders."""
    orders, customers = p.table(spark, sf_dir, "orders"), p.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    price = F.col("o_totalprice").cast(p.MONEY)
    at = lambda s: F.format_number(F.sum(F.when(F.col("o_orderstatus") == s, price)), 2)
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("page_id")).agg(at("F").alias("f"), at("O").alias("o"), F.count("*").alias("n"))
    row = lambda label, value: F.concat(F.lit(f"<tr><td>{label}</td><td>"), value, F.lit("</td></tr>"))
    html = F.concat(
        F.lit("<p>Figures of 2024-25, Rs. in crore</p><table><tr><td>Other</td></tr></table><table><tr><th>Fund head</th><th>Amount (Rs. in lakh)</th></tr>"), row("Central Release", "f"), row("State Share Release", "o"),
        row("Total Expenditure", F.coalesce("o", F.lit("-"))), row("Percentage of Total Expenditure", F.lit("7")), row("Central Fund Released, arrears", F.lit("12%")),
        F.lit('</table><div class="stat-box">Tap connections <b>'), F.format_number("n", 0), F.lit("</b></div><div class='card'>Villages 12</div>"),
    )
    return sums.select("page_id", F.lit("https://x.org").alias("url"), html.alias("html"))


@query("""WITH s AS (SELECT c_nationkey AS page_id, sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'F') AS f, sum(CAST(o_totalprice AS DECIMAL(20,2))) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT page_id, 'RELEASE' AS stage, 'FY2025' AS fy, CAST(CAST(f * 0.01 AS DECIMAL(20,2)) AS DOUBLE) AS amount, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS reason FROM s WHERE f IS NOT NULL
    UNION ALL SELECT page_id, 'UTILIZATION', 'FY2025', CAST(CAST(o * 0.01 AS DECIMAL(20,2)) AS DOUBLE), NULL, NULL FROM s WHERE o IS NOT NULL
    UNION ALL SELECT page_id, NULL, NULL, NULL, n, NULL FROM s WHERE n >= 1 UNION ALL SELECT page_id, 'RELEASE', 'FY2025', NULL, NULL, 'percentage' FROM s""")
def water_mission(spark, sf_dir) -> DataFrame:
    """Funds by stage, connections apart from money, and what could not be read, of every page."""
    funds, coverage, errors = named.water_mission(mission_pages(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    rows = funds.select("page_id", "stage", "fy", F.col("amount").cast("double").alias("amount"), none("long").alias("n"), none("string").alias("reason"))
    rows = rows.union(coverage.select("page_id", none("string"), none("string"), none("double"), "n", none("string")))
    return rows.union(errors.select("page_id", "stage", "fy", none("double"), none("long"), "reason"))


def answer_lists(spark, sf_dir) -> DataFrame:
    """A list of answers for every customer, a row for each of its orders; numbers repeat, and every fifth link is no PDF."""
    k = F.col("o_orderkey").cast("string")
    ending = F.when(F.col("o_orderkey") % 5 == 0, ".html").otherwise(".pdf?x=1")
    row = F.concat(
        F.lit("<tr><td>Question No. "), (F.col("o_orderkey") % 7).cast("string"), F.lit("</td><td>Ministry of Ships &amp; Ports</td><td><a class='x' href='/annex/"), k, ending, F.lit("'>Answer "), k, F.lit("</a></td><td>"),
        F.date_format(F.to_date("o_orderdate"), "dd/MMM/yyyy"), F.lit("</td></tr>"),
    )
    lists = p.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rs"))  # a customer's orders
    return lists.select("page_id", F.lit("https://x.org").alias("url"), F.concat(F.lit("<table>"), F.array_join("rs.r", ""), F.lit("</table>")).alias("html"))


@query("""SELECT o_custkey AS page_id, CAST(o_orderkey % 7 AS VARCHAR) AS question_number, 'Answer ' || o_orderkey AS title, 'https://sansad.in/annex/' || o_orderkey || '.pdf?x=1' AS url, 'Ministry of Ships & Ports Answer' AS ministry, CAST(o_orderdate AS DATE) AS answered_on
    FROM orders WHERE o_orderkey % 5 != 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey) = 1""")
def parliament_answers(spark, sf_dir) -> DataFrame:
    """The linked answers of every list, each question once."""
    return named.parliament_answers(answer_lists(spark, sf_dir))[0]


@query("""SELECT o_custkey AS page_id, 'no answers in the list' AS reason FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 5 != 0) = 0""")
def lists_without_answers(spark, sf_dir) -> DataFrame:
    """Lists in which there is no answer."""
    return named.parliament_answers(answer_lists(spark, sf_dir))[1]


@query(with_parts("run") + """, listed AS (SELECT DISTINCT 'src-' || (c_custkey % 20) AS source_id FROM customer), n AS (SELECT source_id, max(started_at) FILTER (WHERE status = 'ok') AS last_ok, count(*) AS runs FROM run GROUP BY 1)
    SELECT l.source_id, last_ok, coalesce(runs, 0) AS runs, last_ok IS NULL OR date_diff('second', last_ok, TIMESTAMP '2024-02-01') > 2 * 24 * 3600 AS is_stale FROM listed l LEFT JOIN n ON n.source_id = l.source_id""")
def catalogue_beside_freshness(spark, sf_dir) -> DataFrame:
    """Every listed source once, with its last good run; one that never ran is stale."""
    listed = p.table(spark, sf_dir, "customer").select(F.concat(F.lit("src-"), (F.col("c_custkey") % 20).cast("string")).alias("source_id")).distinct()
    runs = p.pipeline_runs(spark, sf_dir)
    fresh = quality.freshness(runs, F.lit("2024-02-01").cast("timestamp"), 24).join(runs.groupBy("source_id").agg(F.count("*").alias("runs")), "source_id")
    return listed.join(fresh, "source_id", "left").select("source_id", "last_ok", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("is_stale", F.lit(True)).alias("is_stale"))


TYPED = '"small ring" or gear -hot economy or "brand 2"'


@query(f"""WITH i AS (SELECT 'min-' || n_nationkey AS entity_id, 'ministry' AS kind, n_name AS title, '' AS aliases, r_name AS extra FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'part-' || p_partkey, 'part', p_name, p_brand, p_type FROM part),
    w AS (SELECT *, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS a, ' ' || trim(regexp_replace(lower(aliases), '[^a-z0-9]+', ' ', 'g')) || ' ' AS b, ' ' || trim(regexp_replace(lower(extra), '[^a-z0-9]+', ' ', 'g')) || ' ' AS c,
          {grams('title')} AS t, {grams("'" + TYPED + "'")} AS q FROM i),
    s AS (SELECT *, CASE WHEN a LIKE '% small ring %' THEN 1.0 WHEN b LIKE '% small ring %' THEN 0.4 WHEN c LIKE '% small ring %' THEN 0.2 ELSE 0 END AS x, CASE WHEN a LIKE '% gear %' THEN 1.0 WHEN b LIKE '% gear %' THEN 0.4 WHEN c LIKE '% gear %' THEN 0.2 ELSE 0 END AS y,
          CASE WHEN a LIKE '% economy %' THEN 1.0 WHEN b LIKE '% economy %' THEN 0.4 WHEN c LIKE '% economy %' THEN 0.2 ELSE 0 END AS e, a || b || c LIKE '% hot %' AS hot,
          CASE WHEN a LIKE '% brand 2 %' THEN 1.0 WHEN b LIKE '% brand 2 %' THEN 0.4 WHEN c LIKE '% brand 2 %' THEN 0.2 ELSE 0 END AS z, CAST(len(list_intersect(t, q)) AS DOUBLE) / len(list_distinct(list_concat(t, q))) AS alike FROM w),
    r AS (SELECT *, greatest(x, CASE WHEN y > 0 AND e > 0 AND NOT hot THEN (y + e) / 2 ELSE 0 END, z) AS rank FROM s)
    SELECT entity_id, kind, title, round(2 * CAST(rank AS DOUBLE) + alike, 6) AS score FROM r WHERE rank > 0 OR alike >= 0.3 ORDER BY round(2 * CAST(rank AS DOUBLE) + alike, 9) DESC, entity_id LIMIT 40""")
def search_as_typed(spark, sf_dir) -> DataFrame:
    """The forty best hits of a text with phrases, alternatives and a word shut out."""
    nations = p.ministries(spark, sf_dir).select(F.col("ministry_id").alias("entity_id"), F.lit("ministry").alias("kind"), F.col("name").alias("title"), F.lit("").alias("aliases"), F.col("sector").alias("extra"))
    goods = p.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("part").alias("kind"), F.col("p_name").alias("title"), F.col("p_brand").alias("aliases"), F.col("p_type").alias("extra"))
    return search.web(nations.union(goods), TYPED, 40).select("entity_id", "kind", "title", *r6("score"))


def release_lists(spark, sf_dir) -> DataFrame:
    """A list of releases for every customer, a link for each of its orders under one heading."""
    k = F.col("o_orderkey").cast("string")
    item = F.concat(
        F.lit("<li>"), F.date_format(F.to_date("o_orderdate"), "dd MMM yyyy"), F.lit(" <a href='/PressReleasePage.aspx?PRID="), k, F.lit("'>Rs. "), F.col("o_totalprice").cast(p.MONEY).cast("string"),
        F.lit(" crore for ships &amp; ports, number "), k, F.lit("</a></li>"),
    )
    lists = p.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    about = p.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    html = F.concat(F.lit("<h3>Min. of "), "c_mktsegment", F.lit("</h3><ul>"), "items", F.lit("</ul>"))
    return lists.join(about, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("page_id"), F.lit("https://x.org").alias("url"), html.alias("html"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS release_id, 'Min. of ' || c_mktsegment AS ministry, 'ministry of ' || lower(c_mktsegment) AS ministry_normalised, 'https://pib.gov.in/PressReleasePage.aspx?PRID=' || o_orderkey AS url,
        CAST(o_orderdate AS DATE) AS published_on, 'Rs. ' || CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) || ' crore' AS mentions FROM orders JOIN customer ON o_custkey = c_custkey""")
def press_releases(spark, sf_dir) -> DataFrame:
    """Every release with its heading, day and the amounts that its title mentions."""
    return named.press_releases(release_lists(spark, sf_dir)).select("release_id", "ministry", "ministry_normalised", "url", "published_on", F.array_join("amount_mentions", "; ").alias("mentions"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(20,2)) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT segment, CAST(c_custkey AS VARCHAR) AS k, 'FY2025' AS fy, 'BE' AS stage, CAST(v AS DOUBLE) AS amount, NULL AS reason FROM c
    UNION ALL SELECT segment, CAST(c_custkey AS VARCHAR), 'FY2026', 'RE', CASE WHEN c_custkey % 5 <> 0 THEN CAST(v * 2 AS DOUBLE) END, CASE WHEN c_custkey % 5 = 0 THEN 'missing column: re' END FROM c""")
def wide_records(spark, sf_dir) -> DataFrame:
    """Records with a column a stage, of which a fifth lacks one: figures of the chosen rows, and what is missing."""
    v = F.col("c_acctbal").cast(p.MONEY)
    record = F.map_concat(
        F.create_map(F.lit("segment"), F.initcap("c_mktsegment"), F.lit("k"), F.col("c_custkey").cast("string"), F.lit("be"), v.cast("string")),
        F.when(F.col("c_custkey") % 5 != 0, F.create_map(F.lit("re"), (v * 2).cast(p.MONEY).cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    records = p.table(spark, sf_dir, "customer").select(record.alias("record"))
    long = tabular.wide_to_long(records, {"be": ("FY2025", "BE"), "re": ("FY2026", "RE")}, ["segment", "k"], keep_rows=("building", "machinery", "household"), drop_rows=("household",))
    judged = tabular.judged_amounts(long, "crore")
    return judged.select(F.upper("segment").alias("segment"), "k", "fy", "stage", F.col("amount").cast("double").alias("amount"), "reason")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') AS k FROM orders GROUP BY 1),
    s AS (SELECT o_custkey, round(least(1.0, sqrt((2 * n + k) / (3.0 * n)) * (0.3 + 0.7 * (n / CAST(n + k AS DOUBLE)))) * CASE WHEN n < 3 THEN 0.6 ELSE 1.0 END, 4) AS score FROM g)
    SELECT o_custkey, score, CASE WHEN score >= 0.60 THEN 'trusted' WHEN score >= 0.25 THEN 'assist' ELSE 'unusable' END AS verdict FROM s""")
def grid_verdicts(spark, sf_dir) -> DataFrame:
    """Every customer's orders as a grid of cells: how sure it is that this is a table, and what becomes of it."""
    cells = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus")), F.col("o_totalprice").cast(p.MONEY).cast("string"))
    scored = tabular.grid_score(p.table(spark, sf_dir, "orders").select("o_custkey", cells.alias("cells")), ["o_custkey"])
    return scored.select("o_custkey", "score", tabular.grid_verdict(F.col("score")).alias("verdict"))


@query("""SELECT c_custkey, replace(c_name, 'Customer#', '[redacted]') AS name, replace(c_mktsegment, 'BUILDING', '[redacted]') AS segment, replace(c_name, 'Customer#', '[redacted]') AS told, c_acctbal AS balance FROM customer""")
def redacted_records(spark, sf_dir) -> DataFrame:
    """Nested records of the log with the values of known secrets masked wherever they stand."""
    event = F.struct(F.array(F.struct(F.col("c_mktsegment").alias("segment"))).alias("list"), F.create_map(F.lit("told"), F.col("c_name")).alias("map"), F.col("c_acctbal").alias("balance"))
    rows = p.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), event.alias("event"))
    masked = text.redact_rows(rows, ["Customer#", "BUILDING", "0000"])
    return masked.select("c_custkey", "name", F.col("event.list")[0]["segment"].alias("segment"), F.col("event.map")["told"].alias("told"), F.col("event.balance").alias("balance"))
