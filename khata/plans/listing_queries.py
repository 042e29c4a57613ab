"""Listings with parameters, lookups, timelines and roll-ups, each beside its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import money
from khata.operators import resolve
from khata.oracle import M, fy, with_parts
from khata.plans import projection as p
from khata.plans import views as v
from khata.plans.fiscal_queries import SUMMARY_AND_MINISTRY, facts_of_ministries, query_into, r6, s6, summary_of

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)

#: Named orders: the figure and whether the largest comes first; missing ones stand last in either.
ORDERS = {"allocation": ("authority", True), "burn": ("burn_ratio", True), "burn_up": ("burn_ratio", False), "balance": ("balance", True), "name": None}
MOST = 500
# Stages in the order in which money moves through them.
STAGES = ("BE", "RE", "SUPPLEMENTARY", "SANCTION", "RELEASE", "EXPENDITURE", "UTILIZATION")


def valid_year(label: str | None) -> str | None:
    """The year's label, or an error if it is none."""
    if label is not None and not re.fullmatch(r"FY\d{4}", label):
        raise ValueError(f"no fiscal year: {label!r}")
    return label


def valid_order(name: str) -> str:
    if name not in ORDERS:
        raise ValueError(f"no order: {name!r}; there are {', '.join(ORDERS)}")
    return name


def valid_limit(limit: float | None, most: int = MOST) -> int:
    """A whole number from 1 to most; none given: most."""
    return most if limit is None else max(1, min(most, int(limit // 1)))


def only(**wanted) -> Column:
    """Rows whose columns have the wanted values; None asks for nothing."""
    found = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            found &= F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value
    return found


FIGURES = ["be", "authority", "spent", "balance", "burn_ratio"]


def ministries_of_year(spark, sf_dir, year: str, order: str = "allocation", limit: float | None = None, sector: str | None = None, ministry_id: str | None = None) -> DataFrame:
    """Ministries of a year in a named order, also those without figures; missing figures stand last."""
    known = p.ministries(spark, sf_dir).where(only(sector=sector, ministry_id=ministry_id))
    figures = summary_of(spark, sf_dir).where(F.col("fy") == valid_year(year))
    rows = known.join(figures, "ministry_id", "left")
    by = ORDERS[valid_order(order)]
    first = [F.desc_nulls_last(by[0]) if by[1] else F.asc_nulls_last(by[0])] if by else []
    return rows.orderBy(*first, "name", "ministry_id").limit(valid_limit(limit)).select("ministry_id", "name", "sector", *r6(*FIGURES))


def ministries_sql(year: str, order: str, where: str = "TRUE", limit: int = MOST) -> str:
    return SUMMARY_AND_MINISTRY + f"""SELECT m.ministry_id, m.name, m.sector, {s6(*FIGURES)} FROM ministry m LEFT JOIN (SELECT * FROM summary WHERE fy = '{year}') s ON s.ministry_id = m.ministry_id
        WHERE {where} ORDER BY {order} m.name, m.ministry_id LIMIT {limit}"""


@query(ministries_sql("FY1998", "s.balance DESC NULLS LAST,"))
def ministries_by_balance(spark, sf_dir) -> DataFrame:
    """A year's ministries, the largest balance first."""
    return ministries_of_year(spark, sf_dir, "FY1998", "balance")


@query(ministries_sql("FY1997", "s.burn_ratio ASC NULLS LAST,", "m.sector = 'ASIA'", 3))
def slowest_of_a_sector(spark, sf_dir) -> DataFrame:
    """The three slowest spenders of one sector."""
    return ministries_of_year(spark, sf_dir, "FY1997", "burn_up", 3.7, sector="ASIA")


@query(ministries_sql("FY2031", "", "m.ministry_id = 'min-4'"))
def ministry_without_figures(spark, sf_dir) -> DataFrame:
    """A ministry in a year without facts: the row is there and its figures are missing."""
    return ministries_of_year(spark, sf_dir, "FY2031", "name", ministry_id="min-4")


def schemes_of_year(spark, sf_dir, year: str, ministry_id: str | None = None, scheme_type: str | None = None, limit: float | None = None) -> DataFrame:
    """Schemes of a year by what was released, also those without figures."""
    facts = p.scheme_facts(spark, sf_dir).where(F.col("fy") == valid_year(year))
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("amount")))
    figures = facts.groupBy(F.col("entity_id").alias("scheme_id")).agg(at("RELEASE").alias("released"), at("UTILIZATION").alias("utilised"))
    rows = p.schemes(spark, sf_dir).where(only(ministry_id=ministry_id, scheme_type=scheme_type)).join(figures, "scheme_id", "left")
    return rows.orderBy(F.desc_nulls_last("released"), "name", "scheme_id").limit(valid_limit(limit)).select("scheme_id", "name", *r6("released", "utilised"))


@query(with_parts("portal", "scheme") + f"""SELECT s.scheme_id, s.name, {s6('released', 'utilised')} FROM scheme s LEFT JOIN (
        SELECT entity_id, max(amount) FILTER (WHERE stage = 'RELEASE') AS released, max(amount) FILTER (WHERE stage = 'UTILIZATION') AS utilised FROM portal WHERE fy = 'FY1996' GROUP BY 1) f ON f.entity_id = s.scheme_id
    WHERE s.ministry_id = 'min-3' AND s.scheme_type = 'CSS' ORDER BY released DESC NULLS LAST, s.name, s.scheme_id LIMIT 50""")
def schemes_of_a_ministry(spark, sf_dir) -> DataFrame:
    """A ministry's schemes of one type in one year."""
    return schemes_of_year(spark, sf_dir, "FY1996", "min-3", "CSS", 50)


@query(SUMMARY_AND_MINISTRY + """SELECT s.fy, s.ministry_id, row_number() OVER (PARTITION BY s.fy ORDER BY round(burn_ratio, 9) ASC NULLS LAST, m.name) AS place_up,
        row_number() OVER (PARTITION BY s.fy ORDER BY round(burn_ratio, 9) DESC NULLS LAST, m.name) AS place_down FROM summary s JOIN ministry m ON s.ministry_id = m.ministry_id""")
def ministry_places(spark, sf_dir) -> DataFrame:
    """A table's places in both directions: missing figures last in either, ties by name."""
    rows = summary_of(spark, sf_dir).join(F.broadcast(p.ministries(spark, sf_dir)), "ministry_id")
    pace = F.round("burn_ratio", 9)
    at = lambda order: F.row_number().over(Window.partitionBy("fy").orderBy(order, "name")).cast("long")
    return rows.select("fy", "ministry_id", at(pace.asc_nulls_last()).alias("place_up"), at(pace.desc_nulls_last()).alias("place_down"))


@query(with_parts("auth", "spent", "portal", "facts") + "SELECT fact_key, row_number() OVER (PARTITION BY fy, entity_id ORDER BY CASE stage " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(STAGES)) + " END, period_end ASC NULLS FIRST, fact_key) AS place FROM facts")
def facts_by_stage(spark, sf_dir) -> DataFrame:
    """Facts of every entity and year in the order of stages, undated ones first within a stage."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    w = Window.partitionBy("fy", "entity_id").orderBy(rank, F.asc_nulls_first("period_end"), "fact_key")
    return p.fiscal_facts(spark, sf_dir).select("fact_key", F.row_number().over(w).cast("long").alias("place"))


@query(SUMMARY_AND_MINISTRY + """, o AS (SELECT fy, authority, row_number() OVER (PARTITION BY fy ORDER BY authority DESC NULLS LAST, ministry_id) AS n FROM summary)
    SELECT fy, round(CAST(sum(authority) FILTER (WHERE n <= 5) AS DOUBLE) / CAST(sum(authority) AS DOUBLE), 6) AS share FROM o GROUP BY 1""")
def concentration(spark, sf_dir) -> DataFrame:
    """The share of a year's authority that its five largest ministries hold."""
    n = F.row_number().over(Window.partitionBy("fy").orderBy(F.desc_nulls_last("authority"), "ministry_id"))
    sums = summary_of(spark, sf_dir).withColumn("n", n).groupBy("fy").agg(F.sum(F.when(F.col("n") <= 5, F.col("authority"))).alias("top"), F.sum("authority").alias("every"))
    return sums.select("fy", F.round(F.col("top").cast("double") / F.col("every").cast("double"), 6).alias("share"))


@query(with_parts("run") + """, s AS (SELECT source_id, max(started_at) FILTER (WHERE status = 'ok') AS newest FROM run GROUP BY 1), t AS (SELECT max(started_at) AS now FROM run)
    SELECT count(*) AS sources, count(newest) AS reporting, count(*) FILTER (WHERE now - newest <= INTERVAL 1 DAY) AS current, count(*) FILTER (WHERE newest IS NULL OR now - newest > INTERVAL 1 DAY) AS stale, max(newest) AS newest FROM s, t""")
def freshness_rollup(spark, sf_dir) -> DataFrame:
    """How many sources report, are current (a good run in the last day before the newest run) or stale, and the newest good run."""
    good = F.max(F.when(F.col("status") == "ok", F.col("started_at")))
    by_source = p.pipeline_runs(spark, sf_dir).groupBy("source_id").agg(good.alias("newest"), F.max("started_at").alias("last"))
    listed = by_source.agg(F.max("last").alias("now"), F.collect_list(F.struct("newest")).alias("sources"))  # a row a source
    rows = listed.select("now", F.explode("sources.newest").alias("newest"))
    current = F.col("newest") >= F.col("now") - F.expr("INTERVAL 1 DAY")
    return rows.agg(F.count("*").alias("sources"), F.count("newest").alias("reporting"), F.count_if(current).alias("current"), F.count_if(F.col("newest").isNull() | ~current).alias("stale"), F.max("newest").alias("newest"))


@query(with_parts("auth", "spent", "facts0", "current", "monthly") + """, e AS (SELECT DISTINCT fy, entity_id FROM monthly), d AS (SELECT fy, entity_id, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM e),
    s AS (SELECT d.fy, d.entity_id, d.month, m.cumulative, CASE WHEN d.month = 1 THEN 0 ELSE lag(m.cumulative) OVER (PARTITION BY d.fy, d.entity_id ORDER BY d.month) END AS previous
          FROM d LEFT JOIN monthly m ON d.fy = m.fy AND d.entity_id = m.entity_id AND d.month = m.month)
    SELECT fy, entity_id, month, round(CAST(cumulative - previous AS DOUBLE), 6) AS amount FROM s""")
def twelve_months(spark, sf_dir) -> DataFrame:
    """A slot for each of the twelve months; a month that is not reported is missing and so is the one after it."""
    months = v.monthly_spend(v.current_facts(p.expenditure_facts(spark, sf_dir))).select("fy", "entity_id", "month", "cumulative")
    slots = months.select("fy", "entity_id").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    before = F.lag("cumulative").over(Window.partitionBy("fy", "entity_id").orderBy("month"))
    previous = F.when(F.col("month") == 1, F.lit(0).cast("decimal(20,2)")).otherwise(before)
    return slots.join(months, ["fy", "entity_id", "month"], "left").withColumn("previous", previous).select("fy", "entity_id", "month", F.round((F.col("cumulative") - F.col("previous")).cast("double"), 6).alias("amount"))


@query(with_parts("auth", "spent", "portal", "facts") + "SELECT entity_id, fact_key, document_date FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY document_date DESC NULLS LAST, fact_key DESC) = 1")
def latest_documents(spark, sf_dir) -> DataFrame:
    """The newest document of every entity."""
    best = F.max(F.struct("document_date", "fact_key")).alias("best")
    return p.fiscal_facts(spark, sf_dir).groupBy("entity_id").agg(best).select("entity_id", "best.fact_key", "best.document_date")


TIMELINE = """, t AS (SELECT entity_id AS ministry_id, 'fact' AS kind, fact_key AS key, period_end AS day FROM auth UNION ALL SELECT entity_id, 'fact', fact_key, period_end FROM spent
        UNION ALL SELECT ministry_id, 'tender', CAST(o_orderkey AS VARCHAR), published FROM tender)"""


def timeline(spark, sf_dir) -> DataFrame:
    facts = facts_of_ministries(spark, sf_dir).select(F.col("entity_id").alias("ministry_id"), F.lit("fact").alias("kind"), F.col("fact_key").alias("key"), F.col("period_end").alias("day"))
    return facts.unionByName(p.tenders(spark, sf_dir).select("ministry_id", F.lit("tender").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.col("published").alias("day")))


@query(with_parts("auth", "spent", "tender") + TIMELINE + "SELECT ministry_id, kind, key, day, row_number() OVER (PARTITION BY ministry_id ORDER BY day DESC NULLS LAST, kind, key) AS place FROM t")
def evidence_timeline(spark, sf_dir) -> DataFrame:
    """A ministry's facts and tenders in one line, newest first, undated last."""
    w = Window.partitionBy("ministry_id").orderBy(F.desc_nulls_last("day"), "kind", "key")
    return timeline(spark, sf_dir).withColumn("place", F.row_number().over(w).cast("long"))


@query(with_parts("auth", "spent", "tender") + TIMELINE + "SELECT ministry_id, kind, key, day FROM t WHERE day IS NOT NULL ORDER BY day DESC, kind, key LIMIT 50")
def feed(spark, sf_dir) -> DataFrame:
    """The fifty newest entries of all kinds."""
    return timeline(spark, sf_dir).where("day is not null").orderBy(F.desc("day"), "kind", "key").limit(50)


@query(with_parts("auth", "spent", "portal", "facts", "current", "ministry", "scheme") + """SELECT f.fy, coalesce(m.name, s.name, f.entity_id) AS label, count(*) AS facts, round(CAST(sum(amount) AS DOUBLE), 6) AS amount FROM current_facts f
    LEFT JOIN ministry m ON f.entity_type = 'ministry' AND m.ministry_id = f.entity_id LEFT JOIN scheme s ON f.entity_type = 'scheme' AND s.scheme_id = f.entity_id
    WHERE f.entity_id = 'min-3' OR s.ministry_id = 'min-3' GROUP BY 1, 2""")
def facts_of_a_ministry_and_its_schemes(spark, sf_dir) -> DataFrame:
    """Facts by label, of a ministry and of the schemes under it."""
    ministry = F.broadcast(p.ministries(spark, sf_dir)).select(F.col("ministry_id").alias("m_id"), F.col("name").alias("m_name"))
    scheme = p.schemes(spark, sf_dir).select(F.col("scheme_id").alias("s_id"), F.col("name").alias("s_name"), F.col("ministry_id").alias("s_ministry"))
    rows = v.current_facts(p.fiscal_facts(spark, sf_dir)).join(ministry, (F.col("entity_type") == "ministry") & (F.col("m_id") == F.col("entity_id")), "left")
    rows = rows.join(scheme, (F.col("entity_type") == "scheme") & (F.col("s_id") == F.col("entity_id")), "left").where("entity_id = 'min-3' or s_ministry = 'min-3'")
    return rows.groupBy("fy", F.coalesce("m_name", "s_name", "entity_id").alias("label")).agg(F.count("*").alias("facts"), F.round(F.sum("amount").cast("double"), 6).alias("amount"))


@query(with_parts("auth", "spent", "facts0", "current") + "SELECT fy, entity_id, count(*) AS n, string_agg(fact_key, ',' ORDER BY fact_key) AS evidence FROM current_facts WHERE head = 'total' GROUP BY 1, 2")
def evidence_of_figures(spark, sf_dir) -> DataFrame:
    """The facts behind every ministry's figures of a year."""
    rows = v.current_facts(facts_of_ministries(spark, sf_dir)).where("head = 'total'")
    return rows.groupBy("fy", "entity_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("fact_key")), ",").alias("evidence"))


@query(with_parts("auth", "spent", "facts0", "current") + f""", n AS (SELECT {fy('o_orderdate')} AS fy, sum(CAST(o_totalprice AS {M})) * 4 AS national FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    m AS (SELECT fy, sum(amount) AS ministries FROM current_facts WHERE stage = 'BE' AND head = 'total' GROUP BY 1)
    SELECT n.fy, round(CAST(national AS DOUBLE), 6) AS national, round(CAST(ministries AS DOUBLE), 6) AS ministries, abs(national - ministries) > 0.25 * national AS breaks FROM n JOIN m ON n.fy = m.fy""")
def national_against_ministries(spark, sf_dir) -> DataFrame:
    """The nation's budget beside the sum of its ministries'; it breaks where they differ by over a quarter."""
    from khata.functions.calendar import fy_of

    orders = p.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    national = orders.groupBy(fy_of(F.to_date("o_orderdate")).alias("fy")).agg((F.sum(F.col("o_totalprice").cast("decimal(20,2)")) * 4).alias("national"))
    ministries = v.current_facts(p.authority_facts(spark, sf_dir)).where("stage = 'BE' and head = 'total'").groupBy("fy").agg(F.sum("amount").alias("ministries"))
    return national.join(ministries, "fy").select("fy", *r6("national", "ministries"), (F.abs(F.col("national") - F.col("ministries")) > F.col("national") * F.lit(0.25).cast("decimal(3,2)")).alias("breaks"))


@query(with_parts("portal", "scheme") + """SELECT p.fy, count(*) AS facts, count(DISTINCT entity_id) AS entities FROM portal p JOIN scheme s ON s.scheme_id = p.entity_id WHERE s.scheme_type = 'other' GROUP BY 1""")
def state_facts_in_union_ledger(spark, sf_dir) -> DataFrame:
    """Facts of schemes outside the Union's own that stand in its ledger, by year: each would count twice."""
    other = p.schemes(spark, sf_dir).where("scheme_type = 'other'").select(F.col("scheme_id").alias("entity_id"))
    return p.scheme_facts(spark, sf_dir).join(other, "entity_id").groupBy("fy").agg(F.count("*").alias("facts"), F.count_distinct("entity_id").alias("entities"))


ALIASES = "SELECT upper(c_name) || '.' AS alias, 'org-' || c_custkey AS entity_id, 0.85 + 0.05 * (c_custkey % 3) AS confidence FROM customer UNION ALL SELECT c_name, 'old-' || c_custkey, 0.95 FROM customer WHERE c_custkey % 10 = 0"


@query(with_parts("tender") + f""", a AS ({ALIASES}), k AS (SELECT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS key, entity_id, confidence FROM a),
    b AS (SELECT key, entity_id FROM k WHERE confidence >= 0.9 QUALIFY row_number() OVER (PARTITION BY key ORDER BY confidence DESC, entity_id) = 1),
    w AS (SELECT key, max(entity_id) AS weak FROM k WHERE confidence < 0.9 GROUP BY 1), n AS (SELECT DISTINCT org_raw FROM tender)
    SELECT org_raw, coalesce(b.entity_id, weak) AS entity_id, CASE WHEN b.entity_id IS NOT NULL THEN 'alias' WHEN weak IS NOT NULL THEN 'review' ELSE 'unknown' END AS outcome
    FROM n LEFT JOIN b ON b.key = trim(regexp_replace(lower(org_raw), '[^a-z0-9]+', ' ', 'g')) LEFT JOIN w ON w.key = trim(regexp_replace(lower(org_raw), '[^a-z0-9]+', ' ', 'g'))""")
def aliases_of_organisations(spark, sf_dir) -> DataFrame:
    """Names as printed in tenders by known aliases; those of little confidence go to review."""
    c = p.table(spark, sf_dir, "customer")
    weight = (F.lit(85) + 5 * (F.col("c_custkey") % 3)) / 100
    aliases = c.select(F.concat(F.upper("c_name"), F.lit(".")).alias("alias"), F.concat(F.lit("org-"), "c_custkey").alias("entity_id"), weight.alias("confidence"))
    aliases = aliases.union(c.where("c_custkey % 10 = 0").select("c_name", F.concat(F.lit("old-"), "c_custkey"), F.lit(0.95)))
    return resolve.by_alias(p.tenders(spark, sf_dir).select(F.col("org_raw").alias("name")).distinct(), aliases).withColumnRenamed("name", "org_raw")


def grouped(w: str) -> str:
    """Whole numbers below a crore in Indian groups."""
    return f"CASE WHEN {w} >= 100000 THEN ({w} // 100000) || ',' || printf('%02d,%03d', {w} // 1000 % 100, {w} % 1000) WHEN {w} >= 1000 THEN ({w} // 1000) || ',' || printf('%03d', {w} % 1000) ELSE CAST({w} AS VARCHAR) END"


@query(f"""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS {M}) AS v, o_orderkey % 7 = 0 AS gone FROM orders),
    b AS (SELECT *, abs(v) AS x, CAST(round(abs(v)) AS BIGINT) AS w, CAST(floor(abs(v)) AS BIGINT) AS f, CAST(round(abs(v) * 100) AS BIGINT) % 100 AS paise, CASE WHEN v < 0 THEN '-' ELSE '' END AS sign, CAST(round(abs(v) / 1000) AS BIGINT) AS l FROM a)
    SELECT o_orderkey, CASE WHEN gone THEN 'Not reported' ELSE sign || '₹' || (l // 100) || printf('.%02d lakh cr', l % 100) END AS lakh_crore,
        CASE WHEN gone THEN '' WHEN x >= 100000 THEN sign || (l // 100) || printf('.%02d lakh cr', l % 100) ELSE sign || {grouped('w')} || ' cr' END AS compact,
        CASE WHEN gone THEN 'Not reported' WHEN x >= 100000 THEN sign || '₹' || (l // 100) || printf('.%02d lakh cr', l % 100) WHEN paise = 0 THEN sign || '₹' || {grouped('f')} || ' cr' ELSE sign || '₹' || {grouped('f')} || printf('.%02d cr', paise) END AS auto FROM b""")
def amounts_in_words(spark, sf_dir) -> DataFrame:
    """Amounts in crore, some below zero and some not reported, as lakh crore, for an axis, and in the unit that reads best."""
    value = F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1) * F.col("o_totalprice").cast("decimal(20,2)"))
    return p.table(spark, sf_dir, "orders").select("o_orderkey", money.lakh_crore(value).alias("lakh_crore"), money.compact(value).alias("compact"), money.auto(value).alias("auto"))


@query(r"""SELECT event_id, array_to_string(regexp_extract_all(props, '[:\[,]\s*(-?[0-9]+(?:\.[0-9]+)?)', 1), ' ') AS figures FROM events""")
def figures_in_json(spark, sf_dir) -> DataFrame:
    """The numbers among the values of nested JSON, in order."""
    return p.table(spark, sf_dir, "events").select("event_id", F.array_join(F.regexp_extract_all("props", F.lit(r"[:\[,]\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), " ").alias("figures"))


@query("""WITH g AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS d FROM documents), u AS (SELECT doc_id, unnest(d) AS x, generate_subscripts(d, 1) AS i FROM g)
    SELECT doc_id, x AS digits FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) = 1""")
def longest_digits(spark, sf_dir) -> DataFrame:
    """The longest group of digits of every text that has one, the first of equals."""
    groups = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    best = F.aggregate(groups, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return p.table(spark, sf_dir, "documents").select("doc_id", best.alias("digits")).where("digits != ''")


SECRET = r"(password|passwd|secret|token|api_?key)([\"']? *[:=] *)([^ \t\n]+)"


@query(rf"""SELECT doc_id, md5(regexp_replace(text, '(?i)(password|passwd|secret|token|api_?key)(["'']? *[:=] *)([^ \t\n]+)', '\1\2[redacted]', 'g')) AS redacted FROM documents""")
def redacted_logs(spark, sf_dir) -> DataFrame:
    """Texts with the values of credential names masked, by digest."""
    return p.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", "(?i)" + SECRET, "$1$2[redacted]")).alias("redacted"))


@query("""WITH k AS (SELECT split_part(url, '/', 3) AS host, md5(html) AS key, strlen(html) AS bytes FROM pages)
    SELECT host, count(*) AS artifacts, count(DISTINCT key) AS different, CAST(sum(bytes) AS BIGINT) AS bytes, array_to_string(list_sort(list_distinct(list(key)))[1:20], ',') AS first_keys FROM k GROUP BY 1""")
def artifact_summary(spark, sf_dir) -> DataFrame:
    """What was stored by host: artifacts, different contents, bytes and the first twenty keys.

    Keys are cut to twenty a task before they travel, so a large host's list stays short.
    """
    rows = p.table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.md5("html").alias("key"), F.octet_length("html").alias("bytes"))
    by_key = rows.groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    first = by_key.where("key is not null").withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("key"))).where("place <= 20").groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("first_keys"))
    sums = by_key.groupBy("host").agg(F.sum("n").alias("artifacts"), F.count("key").alias("different"), F.sum("bytes").alias("bytes"))
    return sums.join(first, "host", "left")


@query(r"""SELECT page_id, coalesce(try_cast(nullif(regexp_extract(html, '([12][0-9]{3}-[01][0-9]-[0-3][0-9])', 1), '') AS DATE), DATE '2024-04-01' + CAST(page_id % 365 AS INTEGER)) AS document_date FROM pages""")
def document_dates(spark, sf_dir) -> DataFrame:
    """A page's own date where one is printed, else that of its manifest."""
    printed = F.expr("try_cast(nullif(regexp_extract(html, '([12][0-9]{3}-[01][0-9]-[0-3][0-9])', 1), '') as date)")
    listed = F.date_add(F.lit("2024-04-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    return p.table(spark, sf_dir, "pages").select("page_id", F.coalesce(printed, listed).alias("document_date"))


@query(with_parts("auth", "spent", "facts0") + "SELECT y.fy, bool_or(f.fy IS NOT NULL) AS there FROM (VALUES ('FY1995'), ('FY1998'), ('FY2031')) y(fy) LEFT JOIN facts f ON f.fy = y.fy GROUP BY 1")
def years_with_facts(spark, sf_dir) -> DataFrame:
    """Whether there is any fact of a year."""
    asked = spark.createDataFrame([("FY1995",), ("FY1998",), ("FY2031",)], "fy string")
    there = facts_of_ministries(spark, sf_dir).select("fy").distinct().withColumn("there", F.lit(True))
    return asked.join(there, "fy", "left").select("fy", F.coalesce("there", F.lit(False)).alias("there"))
