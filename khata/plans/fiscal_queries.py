"""The public fiscal queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import calendar as cal
from khata.operators import quality, rules, upsert, variance
from khata.oracle import M, SUMMARY, elapsed, end, fy, month, quarter, ratio, start, with_parts
from khata.plans import projection as p
from khata.plans import views as v
from khata.plans.once import once

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query_into(queries: dict, texts: dict):
    """A decorator that registers a query, and its SQL, by its name."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return query


query = query_into(QUERIES, SQL)


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def facts_of_ministries(spark, sf_dir) -> DataFrame:
    return p.authority_facts(spark, sf_dir).unionByName(p.expenditure_facts(spark, sf_dir))


def summary_of(spark, sf_dir) -> DataFrame:
    return v.ministry_summary(facts_of_ministries(spark, sf_dir))


SUMMARY_AND_MINISTRY = with_parts("ministry", "auth", "spent", "facts0", "current", "authority", "to_date", "summary")
COMPARED = ["be", "re", "authority", "spent", "balance", "burn_ratio"]
FIGURES = ["be", "re", "supplementary", "authority", "spent", "revenue", "capital", "balance", "pct_spent", "elapsed", "burn_ratio", "revision", "capital_share"]


@query(SUMMARY_AND_MINISTRY + f"SELECT s.fy, s.ministry_id, m.name, m.sector, as_of, {s6(*FIGURES)} FROM summary s JOIN ministry m ON s.ministry_id = m.ministry_id")
def ministry_summary(spark, sf_dir) -> DataFrame:
    """Every ministry and year: budget, spend, balance and pace."""
    return summary_of(spark, sf_dir).join(F.broadcast(p.ministries(spark, sf_dir)), "ministry_id").select("fy", "ministry_id", "name", "sector", "as_of", *r6(*FIGURES))



@query(with_parts("auth", "spent", "portal", "facts", "current") + "SELECT fact_key, fy, entity_type, entity_id, stage, head, period_end, document_date, CAST(amount AS DOUBLE) AS amount FROM current_facts")
def current_facts(spark, sf_dir) -> DataFrame:
    """Facts that are not superseded, the newest document of each cell."""
    return v.current_facts(p.fiscal_facts(spark, sf_dir)).select("fact_key", "fy", "entity_type", "entity_id", "stage", "head", "period_end", "document_date", F.col("amount").cast("double").alias("amount"))


@query(with_parts("auth", "spent", "facts0", "current", "monthly") + f"SELECT fy, entity_id, month, period_end, is_decrease, {s6('cumulative', 'amount')} FROM monthly")
def monthly_spend(spark, sf_dir) -> DataFrame:
    """De-cumulated months, unknown after a gap, falls flagged."""
    current = v.current_facts(p.expenditure_facts(spark, sf_dir))
    return v.monthly_spend(current).select("fy", "entity_id", "month", "period_end", "is_decrease", *r6("cumulative", "amount"))


@query(SUMMARY + f""", n AS (SELECT fy, CAST(sum(be) AS {M}) AS be, CAST(sum(authority) AS {M}) AS authority, CAST(sum(spent) AS {M}) AS spent, count(*) AS ministries, count(spent) AS reporting, max(as_of) AS as_of FROM summary GROUP BY fy)
    SELECT fy, ministries, reporting, as_of, {s6('be', 'authority', 'spent')}, round({ratio('spent', 'authority')}, 6) AS share, round({elapsed('fy', 'as_of')}, 6) AS elapsed FROM n""")
def national_summary(spark, sf_dir) -> DataFrame:
    """The sums of all ministries by year, and how many report."""
    n = summary_of(spark, sf_dir).groupBy("fy").agg(
        F.sum("be").alias("be"), F.sum("authority").alias("authority"), F.sum("spent").alias("spent"), F.count("*").alias("ministries"), F.count("spent").alias("reporting"), F.max("as_of").alias("as_of")
    )
    return n.select("fy", "ministries", "reporting", "as_of", *r6("be", "authority", "spent"), F.round(v.ratio(F.col("spent"), F.col("authority")), 6).alias("share"), F.round(cal.fraction_elapsed(F.col("fy"), F.col("as_of")), 6).alias("elapsed"))


@query(with_parts("portal", "scheme", "ministry") + f""", f AS (
        SELECT fy, entity_id, max(amount) FILTER (WHERE stage = 'RELEASE') AS released, max(amount) FILTER (WHERE stage = 'UTILIZATION') AS utilised,
               max(amount) FILTER (WHERE stage = 'SANCTION') AS sanctioned, max(period_end) AS as_of FROM portal GROUP BY 1, 2)
    SELECT fy, scheme_id, s.name AS scheme, scheme_type, m.name AS ministry, as_of, {s6('released', 'utilised', 'sanctioned')}, round({ratio('utilised', 'released')}, 6) AS utilisation
    FROM f JOIN scheme s ON s.scheme_id = f.entity_id LEFT JOIN ministry m ON m.ministry_id = s.ministry_id""")
def scheme_summary(spark, sf_dir) -> DataFrame:
    """Release, utilisation and sanction of every scheme and year."""
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("amount")))
    f = p.scheme_facts(spark, sf_dir).groupBy("fy", F.col("entity_id").alias("scheme_id")).agg(at("RELEASE").alias("released"), at("UTILIZATION").alias("utilised"), at("SANCTION").alias("sanctioned"), F.max("period_end").alias("as_of"))
    ministry = p.ministries(spark, sf_dir).select("ministry_id", F.col("name").alias("ministry"))
    return f.join(p.schemes(spark, sf_dir), "scheme_id").join(F.broadcast(ministry), "ministry_id", "left").select(
        "fy", "scheme_id", F.col("name").alias("scheme"), "scheme_type", "ministry", "as_of", *r6("released", "utilised", "sanctioned"), F.round(v.ratio(F.col("utilised"), F.col("released")), 6).alias("utilisation")
    )


@query(SUMMARY_AND_MINISTRY + """SELECT fy, sector, count(*) AS rows_in, round(CAST(sum(authority) AS DOUBLE), 6) AS authority, round(CAST(sum(spent) AS DOUBLE), 6) AS spent
    FROM summary s JOIN ministry m ON s.ministry_id = m.ministry_id GROUP BY ROLLUP (fy, sector)""")
def sector_rollup(spark, sf_dir) -> DataFrame:
    """Authority and spend by year and sector, with their totals."""
    rows = summary_of(spark, sf_dir).join(F.broadcast(p.ministries(spark, sf_dir)), "ministry_id")
    return rows.rollup("fy", "sector").agg(F.count("*").alias("rows_in"), F.round(F.sum("authority").cast("double"), 6).alias("authority"), F.round(F.sum("spent").cast("double"), 6).alias("spent"))


def z(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


FLAGS = (
    with_parts("auth", "spent", "facts0", "current", "authority", "to_date", "summary", "monthly", "central")
    + f""", march AS (
        SELECT fy, entity_id, {z('sum(amount) FILTER (WHERE month >= 10)')} / {z('sum(amount)')} AS q4, {z('sum(amount) FILTER (WHERE month = 12)')} / {z('sum(amount)')} AS march
        FROM monthly GROUP BY 1, 2 HAVING count(amount) = 12 AND sum(amount) > 0),
    past AS (
        SELECT fy, entity_id, month, {z('amount')} AS value, count(amount) OVER w AS years, avg({z('amount')}) OVER w AS mean, stddev_pop({z('amount')}) OVER w AS stdev
        FROM monthly WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY entity_id, month ORDER BY fy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    zs AS (SELECT fy, entity_id, month, (value - mean) / stdev AS z FROM past WHERE years >= 3 AND stdev >= 1),
    worst AS (SELECT fy, entity_id, z FROM zs QUALIFY row_number() OVER (PARTITION BY fy, entity_id ORDER BY abs(z) DESC, month) = 1),
    trail AS (
        SELECT s.fy, s.ministry_id, count(t.o_orderkey) AS n FROM summary s
        LEFT JOIN central t ON t.ministry_id = s.ministry_id AND t.published > CAST(coalesce(s.as_of, {end('s.fy')}) - 90 AS DATE) AND t.published <= coalesce(s.as_of, {end('s.fy')}) GROUP BY 1, 2),
    m AS (
        SELECT s.*, q4, march, w.z, t.n FROM summary s LEFT JOIN march a ON a.fy = s.fy AND a.entity_id = s.ministry_id LEFT JOIN worst w ON w.fy = s.fy AND w.entity_id = s.ministry_id
        LEFT JOIN trail t ON t.fy = s.fy AND t.ministry_id = s.ministry_id),
    flags AS (
        SELECT fy, ministry_id AS entity_id, 'march_rush' AS rule_id, CASE WHEN q4 > 0.45 OR march > 0.25 THEN 'high' ELSE 'notable' END AS severity, q4 AS metric FROM m WHERE q4 > 0.30 OR march > 0.15
        UNION ALL SELECT fy, ministry_id, 'under_utilization', CASE WHEN burn_ratio < 0.25 THEN 'high' ELSE 'notable' END, burn_ratio FROM m WHERE elapsed > 0.5 AND burn_ratio < 0.5
        UNION ALL SELECT fy, ministry_id, 'over_burn', CASE WHEN burn_ratio > 1.6 THEN 'high' ELSE 'notable' END, burn_ratio FROM m WHERE elapsed >= 0.25 AND burn_ratio > 1.3
        UNION ALL SELECT fy, ministry_id, 'revision_swing', CASE WHEN abs(revision) > 0.50 THEN 'high' ELSE 'notable' END, revision FROM m WHERE abs(revision) > 0.25
        UNION ALL SELECT fy, ministry_id, 'spend_no_tender', 'info', capital_share FROM m WHERE n = 0 AND spent >= 100 AND capital_share >= 0.30
        UNION ALL SELECT fy, ministry_id, 'stat_outlier', CASE WHEN abs(z) >= 3.5 THEN 'high' ELSE 'notable' END, z FROM m WHERE abs(z) >= 2.5)
    """
)


def flags_and_summary(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The flags and the summary of ministries, over facts that are worked out once."""
    current = once(v.current_facts(facts_of_ministries(spark, sf_dir)))
    summary = once(v.summary(v.authority(current), v.expenditure_to_date(current)).withColumnRenamed("entity_id", "ministry_id").drop("entity_type"))
    return rules.evaluate(summary, v.monthly_spend(current), p.central_tenders(spark, sf_dir)), summary


def flags_of(spark, sf_dir) -> DataFrame:
    return flags_and_summary(spark, sf_dir)[0]


@query(FLAGS + "SELECT fy, entity_id, rule_id, severity, round(metric, 6) AS metric, 'pending' AS status FROM flags")
def anomaly_flags(spark, sf_dir) -> DataFrame:
    """Every hit of the six rules."""
    return flags_of(spark, sf_dir).select("fy", "entity_id", "rule_id", "severity", *r6("metric"), "status")


@query(FLAGS + f", c AS (SELECT fy, entity_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS high FROM flags GROUP BY 1, 2) SELECT s.fy, ministry_id, coalesce(n, 0) AS flags, coalesce(high, 0) AS high FROM summary s LEFT JOIN c ON c.fy = s.fy AND c.entity_id = s.ministry_id")
def flag_counts(spark, sf_dir) -> DataFrame:
    """Flags of every ministry and year, none counted as 0."""
    flags, summary = flags_and_summary(spark, sf_dir)
    counts = flags.groupBy("fy", F.col("entity_id").alias("ministry_id")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("h"))
    return summary.select("fy", "ministry_id").join(counts, ["fy", "ministry_id"], "left").select("fy", "ministry_id", F.coalesce("n", F.lit(0)).alias("flags"), F.coalesce("h", F.lit(0)).alias("high"))


@query(with_parts("auth", "spent", "facts0", "current", "authority", "to_date", "summary", "monthly") + f"""
    SELECT 'superseded_fact_visible' AS check_id, 'error' AS severity, c.fy, c.entity_id, CAST(NULL AS DOUBLE) AS value FROM current_facts c JOIN facts n ON n.supersedes = c.fact_key
    UNION ALL SELECT 'cumulative_series_decreased', 'warn', fy, entity_id, round(CAST(cumulative AS DOUBLE), 6) FROM monthly WHERE is_decrease
    UNION ALL SELECT 'expenditure_exceeds_authority', 'warn', fy, ministry_id, round(pct_spent, 6) FROM summary WHERE pct_spent > 150
    UNION ALL SELECT 'fact_without_source', 'error', fy, entity_id, CAST(NULL AS DOUBLE) FROM facts WHERE source_id NOT IN ('budget', 'accounts')
    UNION ALL SELECT 'entity_unknown', 'error', fy, entity_id, CAST(NULL AS DOUBLE) FROM facts WHERE entity_id NOT IN (SELECT 'min-' || n_nationkey FROM nation)
    UNION ALL SELECT 'flow_without_period', 'error', fy, entity_id, CAST(NULL AS DOUBLE) FROM facts WHERE stage = 'EXPENDITURE' AND period_end IS NULL""")
def invariants(spark, sf_dir) -> DataFrame:
    """Violations of the ledger's invariants, one row each."""
    facts = once(facts_of_ministries(spark, sf_dir))
    return quality.invariants(facts, v.current_facts(facts), v.ministry_summary(facts), p.ministries(spark, sf_dir), spark.createDataFrame([("budget",), ("accounts",)], "source_id string"))


@query(with_parts("run") + """, n AS (
        SELECT source_id, max(started_at) FILTER (WHERE status = 'ok') AS last_ok, max(started_at) AS last_run, arg_max(status, struct_pack(a := started_at, b := run_id)) AS last_status FROM run GROUP BY 1)
    SELECT source_id, last_ok, last_run, last_status, CAST(date_diff('second', last_ok, TIMESTAMP '2024-02-01') // 3600 AS BIGINT) AS hours_since,
           last_ok IS NULL OR date_diff('second', last_ok, TIMESTAMP '2024-02-01') > 2 * 24 * 3600 AS is_stale FROM n""")
def source_freshness(spark, sf_dir) -> DataFrame:
    """Per source the last run, the last good one, and whether that is older than twice the interval."""
    return quality.freshness(p.pipeline_runs(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"), 24)


@query(with_parts("run") + """, d AS (SELECT source_id, CAST(started_at AS DATE) AS day, count(*) AS n, sum(CAST(total AS DECIMAL(20,2))) AS total, count(*) FILTER (WHERE status = 'failed') AS failed FROM run GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY day) AS k FROM d),
    m AS (SELECT x.source_id, x.day, median(y.n) AS base_n, median(CAST(y.total AS DOUBLE)) AS base_total FROM b x LEFT JOIN b y ON x.source_id = y.source_id AND y.k BETWEEN x.k - 8 AND x.k - 1 GROUP BY 1, 2),
    j AS (SELECT b.source_id, b.day, n, total, failed, CASE WHEN base_n > 0 THEN abs(n - base_n) / base_n END AS n_swing, CASE WHEN base_total > 0 THEN abs(CAST(total AS DOUBLE) - base_total) / base_total END AS t_swing, base_n FROM b JOIN m ON b.source_id = m.source_id AND b.day = m.day)
    SELECT source_id, day, 'row_count_swing' AS finding, CASE WHEN n_swing > 0.9 THEN 'high' ELSE 'warn' END AS severity, round(n_swing, 6) AS value FROM j WHERE n_swing > 0.5
    UNION ALL SELECT source_id, day, 'total_amount_swing', CASE WHEN t_swing > 0.9 THEN 'high' ELSE 'warn' END, round(t_swing, 6) FROM j WHERE t_swing > 0.5
    UNION ALL SELECT source_id, day, 'parse_error_rate', CASE WHEN failed / n >= 0.10 THEN 'high' WHEN failed / n >= 0.02 THEN 'warn' ELSE 'info' END, round(failed / n, 6) FROM j WHERE failed > 0
    UNION ALL SELECT source_id, day, 'no_baseline', 'info', CAST(NULL AS DOUBLE) FROM j WHERE base_n IS NULL AND n > 0 AND failed = 0""")
def drift_findings(spark, sf_dir) -> DataFrame:
    """Each source's day against the median of its eight days before."""
    runs = p.pipeline_runs(spark, sf_dir).groupBy("source_id", F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("n"), F.sum(F.col("total").cast("decimal(20,2)")).alias("total"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    return quality.drift(runs)


@query(f"""SELECT o_orderkey, {fy('o_orderdate')} AS fy, {quarter('o_orderdate')} AS q, {month('o_orderdate')} AS month_index, {start(fy('o_orderdate'))} AS fy_first, {end(fy('o_orderdate'))} AS fy_last,
    round({elapsed(fy('o_orderdate'), 'CAST(o_orderdate AS DATE)')}, 9) AS elapsed, round(CAST(date_diff('day', {start(fy('o_orderdate'))}, CAST(o_orderdate AS DATE)) AS DOUBLE) / date_diff('day', {start(fy('o_orderdate'))}, {end(fy('o_orderdate'))}), 9) AS par,
    (CAST(substr({fy('o_orderdate')}, 3) AS INTEGER) - 1) || '-' || lpad(CAST(CAST(substr({fy('o_orderdate')}, 3) AS INTEGER) % 100 AS VARCHAR), 2, '0') AS label,
    'FY' || (CAST(substr({fy('o_orderdate')}, 3) AS INTEGER) - 1) AS previous,
    CAST(o_orderdate + INTERVAL 330 MINUTE AS DATE) AS india_day FROM orders""")
def calendar_of_orders(spark, sf_dir) -> DataFrame:
    """The fiscal calendar of every order's date."""
    day, year = F.to_date("o_orderdate"), cal.fy_of(F.to_date("o_orderdate"))
    return p.table(spark, sf_dir, "orders").select(
        "o_orderkey", year.alias("fy"), cal.fy_quarter(day).alias("q"), cal.fy_month_index(day).alias("month_index"), cal.fy_start(year).alias("fy_first"), cal.fy_end(year).alias("fy_last"),
        F.round(cal.fraction_elapsed(year, day), 9).alias("elapsed"), F.round(cal.par_fraction(year, day), 9).alias("par"), cal.long_label(year).alias("label"), cal.shift_fy(year, -1).alias("previous"), cal.digest_day(F.col("o_orderdate")).alias("india_day"),
    )


@query(SUMMARY + f""", g AS (SELECT *, {elapsed('fy', 'as_of')} AS e FROM summary WHERE authority > 0 AND spent IS NOT NULL AND as_of IS NOT NULL),
    h AS (SELECT fy, ministry_id, share AS absorption, par, (share - par) * CAST(authority AS DOUBLE) AS gap, CASE WHEN par > 0 THEN share / par END AS pace, authority
          FROM (SELECT *, greatest(0.0, least(1.0, CAST(date_diff('day', {start('fy')}, as_of) AS DOUBLE) / date_diff('day', {start('fy')}, {end('fy')}))) AS par FROM g) WHERE par > 0),
    t AS (SELECT *, -sum(least(gap, 0)) OVER (PARTITION BY fy ORDER BY gap, ministry_id ROWS UNBOUNDED PRECEDING) AS running, -sum(least(gap, 0)) OVER (PARTITION BY fy) AS short_total,
          CAST(authority AS DOUBLE) / sum(CAST(authority AS DOUBLE)) OVER (PARTITION BY fy) AS weight, row_number() OVER (PARTITION BY fy ORDER BY gap, ministry_id) AS place FROM h)
    SELECT fy, ministry_id, CAST(place AS INTEGER) AS place, round(absorption, 6) AS absorption, round(par, 6) AS par, round(pace, 6) AS pace, round(gap, 2) AS gap, round(weight, 6) AS weight, round(CASE WHEN short_total > 0 THEN running / short_total END, 6) AS pareto,
           CASE WHEN pace < 0.6 THEN 'far_behind' WHEN pace < 0.9 THEN 'behind' WHEN pace < 1.1 THEN 'near_par' WHEN pace < 1.4 THEN 'ahead' WHEN pace IS NOT NULL THEN 'far_ahead' END AS position FROM t""")
def variance_pareto(spark, sf_dir) -> DataFrame:
    """Distance of every ministry from even spending, largest shortfall first, with its running share."""
    rows = variance.pareto(summary_of(spark, sf_dir))
    return rows.select("fy", "ministry_id", "place", *r6("absorption", "par", "pace"), F.round("gap", 2).alias("gap"), *r6("weight", "pareto"), "position")


@query(SUMMARY + f""" SELECT fy, count(*) FILTER (WHERE u) AS n_usable, count(*) FILTER (WHERE NOT u) AS n_skipped
    FROM (SELECT fy, coalesce(authority > 0 AND spent IS NOT NULL AND as_of > {start('fy')}, FALSE) AS u FROM summary) GROUP BY fy""")
def variance_skipped(spark, sf_dir) -> DataFrame:
    """How many ministries of a year can be set against even spending, and how many can't."""
    return variance.skipped(summary_of(spark, sf_dir))


@query(SUMMARY + """, b AS (SELECT fy, ministry_id, burn_ratio AS r, floor(abs(burn_ratio - 1) * 100 + 0.5) AS apart FROM summary)
    SELECT fy, ministry_id, CASE WHEN r IS NULL THEN 'Not reported' WHEN r < 0.5 THEN 'Far behind pace' WHEN r < 0.85 THEN 'Behind pace' WHEN r <= 1.15 THEN 'On pace' WHEN r <= 1.3 THEN 'Ahead of pace' ELSE 'Far ahead of pace' END AS label,
           CASE WHEN r IS NULL THEN 'Spending pace cannot be computed from the reported figures.' WHEN apart <= 15 THEN 'Spending is broadly in line with the share of the year elapsed.'
                ELSE 'Spending is running about ' || CAST(apart AS BIGINT) || '% ' || CASE WHEN r < 1 THEN 'below' ELSE 'above' END || ' the share of the year elapsed.' END AS sentence FROM b""")
def pace_in_words(spark, sf_dir) -> DataFrame:
    """Each ministry's pace as a label and as a sentence."""
    burn = F.col("burn_ratio")
    return summary_of(spark, sf_dir).select("fy", "ministry_id", variance.burn_label(burn).alias("label"), variance.burn_sentence(burn).alias("sentence"))



@query(SUMMARY + f""", ranked AS (
        SELECT *, row_number() OVER (PARTITION BY fy ORDER BY burn_ratio ASC NULLS LAST, ministry_id) AS slow, row_number() OVER (PARTITION BY fy ORDER BY burn_ratio DESC NULLS LAST, ministry_id) AS fast,
               row_number() OVER (PARTITION BY fy ORDER BY abs(revision) DESC NULLS LAST, ministry_id) AS moved FROM summary)
    SELECT fy, 'slowest' AS list, slow AS place, ministry_id, round(burn_ratio, 6) AS value FROM ranked WHERE slow <= 5 AND burn_ratio IS NOT NULL
    UNION ALL SELECT fy, 'fastest', fast, ministry_id, round(burn_ratio, 6) FROM ranked WHERE fast <= 5 AND burn_ratio IS NOT NULL
    UNION ALL SELECT fy, 'revised', moved, ministry_id, round(revision, 6) FROM ranked WHERE moved <= 5 AND revision IS NOT NULL""")
def top_movers(spark, sf_dir) -> DataFrame:
    """Per year the five slowest, fastest and most revised ministries; missing figures come last."""
    return variance.movers(summary_of(spark, sf_dir), 5).select("fy", "list", F.col("place").cast("long").alias("place"), "ministry_id", *r6("value"))


@query(with_parts("auth", "spent", "facts0", "current", "monthly") + f"""SELECT a.fy, a.entity_id, a.month, {', '.join(f'round(CAST({x}.amount AS DOUBLE), 6) AS {n}' for x, n in (('a', 'amount'), ('b', 'year_before')))}
    FROM monthly a LEFT JOIN monthly b ON a.entity_id = b.entity_id AND a.month = b.month AND CAST(substr(a.fy, 3) AS INTEGER) = CAST(substr(b.fy, 3) AS INTEGER) + 1""")
def months_beside_year_before(spark, sf_dir) -> DataFrame:
    """Every month beside the same fiscal month of the year before."""
    months = v.monthly_spend(v.current_facts(p.expenditure_facts(spark, sf_dir)))
    w = Window.partitionBy("entity_id", "month").orderBy("fy")
    last = F.when(F.lag("fy").over(w) == cal.shift_fy(F.col("fy"), -1), F.lag("amount").over(w))
    return months.withColumn("year_before", last).select("fy", "entity_id", "month", *r6("amount", "year_before"))


@query(SUMMARY + "SELECT fy, ministry_id, metric, round(CAST(value AS DOUBLE), 6) AS value FROM (" + " UNION ALL ".join(f"SELECT fy, ministry_id, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM summary" for n in COMPARED) + ") WHERE ministry_id IN ('min-1', 'min-2', 'min-3', 'min-7')")
def compare_ministries(spark, sf_dir) -> DataFrame:
    """Four ministries side by side, a row for each figure."""
    rows = summary_of(spark, sf_dir).where(F.col("ministry_id").isin("min-1", "min-2", "min-3", "min-7")).select("fy", "ministry_id", *[F.col(n).cast("double").alias(n) for n in COMPARED])
    return rows.unpivot(["fy", "ministry_id"], COMPARED, "metric", "value").select("fy", "ministry_id", "metric", *r6("value"))


@query(with_parts("auth", "spent", "facts0", "current") + """, y AS (SELECT fy, bool_or(stage IN ('BE', 'RE')) AS a, bool_or(stage = 'EXPENDITURE') AS b FROM current_facts GROUP BY 1)
    SELECT fy FROM y ORDER BY CASE WHEN a AND b THEN 0 WHEN a THEN 1 ELSE 2 END, fy DESC LIMIT 1""")
def default_year(spark, sf_dir) -> DataFrame:
    """The newest year with budget and spend, else with a budget, else any."""
    years = v.current_facts(facts_of_ministries(spark, sf_dir)).groupBy("fy").agg(F.bool_or(F.col("stage").isin("BE", "RE")).alias("a"), F.bool_or(F.col("stage") == "EXPENDITURE").alias("b"))
    return years.orderBy(F.when(F.col("a") & F.col("b"), 0).when(F.col("a"), 1).otherwise(2), F.desc("fy")).limit(1).select("fy")


@query(with_parts("tender") + f""", y AS (SELECT *, {fy('published')} AS fy FROM tender)
    SELECT fy, ministry_id, status, count(*) AS tenders, round(CAST(sum(value) AS DOUBLE), 6) AS value FROM y GROUP BY CUBE (fy, ministry_id, status)""")
def tender_cube(spark, sf_dir) -> DataFrame:
    """Tenders by year, ministry and status, with every total."""
    rows = p.tenders(spark, sf_dir).withColumn("fy", cal.fy_of(F.col("published")))
    return rows.cube("fy", "ministry_id", "status").agg(F.count("*").alias("tenders"), F.round(F.sum("value").cast("double"), 6).alias("value"))


@query(with_parts("auth") + f""", fresh AS (SELECT * FROM auth WHERE fy >= 'FY1998'), old AS (SELECT * FROM auth WHERE fy <= 'FY1999')
    SELECT coalesce(n.fact_key, o.fact_key) AS fact_key, round(CAST(CASE WHEN n.fact_key IS NOT NULL THEN n.amount * 2 ELSE o.amount END AS DOUBLE), 6) AS amount, CASE WHEN o.fact_key IS NULL THEN 'inserted' WHEN n.fact_key IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM old o FULL OUTER JOIN fresh n ON o.fact_key = n.fact_key""")
def upsert_facts(spark, sf_dir) -> DataFrame:
    """New figures laid over old ones by their natural key, in which missing values are equal."""
    facts = p.authority_facts(spark, sf_dir)
    fresh = facts.where("fy >= 'FY1998'").withColumn("amount", (F.col("amount") * 2).cast("decimal(20,2)"))
    merged = upsert.merge(facts.where("fy <= 'FY1999'"), fresh, ["fy", "entity_type", "entity_id", "stage", "head", "period_end", "document_date"])
    return merged.select("fact_key", *r6("amount"), "action")


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
        count(*) >= 20 AND count(*) FILTER (WHERE event_type = 'error') > 0.05 * count(*) AS alert, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def alert_windows(spark, sf_dir) -> DataFrame:
    """Five-minute windows of events: error rate with a floor of 20, and the 95th percentile."""
    return quality.alerts(p.table(spark, sf_dir, "events")).select("start", "requests", "errors", "alert", *r6("p95"))


@query(with_parts("run") + """, h AS (SELECT *, CASE WHEN status = 'ok' THEN run_id END AS ok_id FROM run)
    SELECT run_id, source_id, last_value(ok_id IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS baseline_run,
           row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS newest FROM h""")
def carried_baseline(spark, sf_dir) -> DataFrame:
    """For every run the last good run of its source, carried down, and its place from the newest.

    Each day of a source is ordered by itself; what a day takes over from earlier ones, and how many runs follow it, comes
    from a row a source and day.
    """
    runs = p.pipeline_runs(spark, sf_dir).select("run_id", "source_id", "started_at", F.to_date("started_at").alias("day"), F.when(F.col("status") == "ok", F.col("run_id")).alias("good"))
    place = F.struct("started_at", "run_id")
    days = runs.groupBy("source_id", "day").agg(F.max_by("good", F.when(F.col("good").isNotNull(), place)).alias("last_good"), F.count("*").alias("n"))
    order = Window.partitionBy("source_id").orderBy("day")
    before = F.last("last_good", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.coalesce(F.sum("n").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    days = days.select("source_id", "day", before.alias("before"), after.alias("after"))
    w = Window.partitionBy("source_id", "day").orderBy("started_at", "run_id")
    back = Window.partitionBy("source_id", "day").orderBy(F.desc("started_at"), F.desc("run_id"))
    within = runs.select("run_id", "source_id", "day", F.last("good", ignorenulls=True).over(w).alias("own"), F.row_number().over(back).alias("place"))
    return within.join(days, ["source_id", "day"]).select("run_id", "source_id", F.coalesce("own", "before").alias("baseline_run"), (F.col("place") + F.col("after")).cast("long").alias("newest"))


@query(with_parts("run") + """, c AS (SELECT source_id, status, count(*) AS n FROM run GROUP BY 1, 2)
    SELECT source_id, status AS usual_status, n FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, status) = 1""")
def usual_status(spark, sf_dir) -> DataFrame:
    """The most frequent status of each source, ties by name."""
    counts = p.pipeline_runs(spark, sf_dir).groupBy("source_id", "status").agg(F.count("*").alias("n"))
    return counts.groupBy("source_id").agg(F.min_by("status", F.struct(-F.col("n"), "status")).alias("usual_status"), F.max("n").alias("n"))


@query(f"""WITH e AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey, list_filter([
        CASE WHEN c_acctbal IS NULL THEN 'amount missing' END, CASE WHEN c_acctbal < 0 THEN 'amount below zero' END, CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+$') THEN 'name malformed' END,
        CASE WHEN c_nationkey NOT BETWEEN 0 AND 24 THEN 'nation unknown' END, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD') THEN 'segment unknown' END], lambda x: x IS NOT NULL) AS errors FROM customer)
    SELECT c_custkey, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")
def row_validation(spark, sf_dir) -> DataFrame:
    """All failures of each row at once."""
    checks = [
        (F.col("c_acctbal").isNull(), "amount missing"), (F.col("c_acctbal") < 0, "amount below zero"), (~F.col("c_name").rlike("^Customer#[0-9]+$"), "name malformed"),
        (~F.col("c_nationkey").between(0, 24), "nation unknown"), (~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"), "segment unknown"),
    ]
    return quality.failures(p.table(spark, sf_dir, "customer"), checks).select("c_custkey", F.array_join("errors", "; ").alias("errors"))


@query(SUMMARY + f"""SELECT fy, ministry_id, {s6('be', 're', 'authority')}, round({ratio('(authority - before)', 'before')}, 6) AS growth
    FROM (SELECT *, CASE WHEN CAST(substr(lag(fy) OVER w, 3) AS INTEGER) + 1 = CAST(substr(fy, 3) AS INTEGER) THEN lag(authority) OVER w END AS before FROM summary WINDOW w AS (PARTITION BY ministry_id ORDER BY fy))""")
def allocation_history(spark, sf_dir) -> DataFrame:
    """Every ministry's allocation by year and its growth over the year before, unknown after a gap."""
    w = Window.partitionBy("ministry_id").orderBy("fy")
    before = F.when(F.lag("fy").over(w) == cal.shift_fy(F.col("fy"), -1), F.lag("authority").over(w))
    rows = summary_of(spark, sf_dir).withColumn("before", before)
    return rows.select("fy", "ministry_id", *r6("be", "re", "authority"), F.round(v.ratio(F.col("authority") - F.col("before"), F.col("before")), 6).alias("growth"))


@query(SUMMARY_AND_MINISTRY + f""", t AS (SELECT s.fy, 'st-' || sector AS state_id, CAST(sum(be) AS {M}) AS be, CAST(sum(authority) AS {M}) AS authority, CAST(sum(spent) AS {M}) AS spent, max(as_of) AS as_of, count(*) FILTER (WHERE spent IS NULL) AS missing
        FROM summary s JOIN ministry m ON s.ministry_id = m.ministry_id GROUP BY 1, 2)
    SELECT fy, state_id, as_of, missing, {s6('be', 'authority', 'spent')}, round(CASE WHEN {elapsed('fy', 'as_of')} > 0 THEN {ratio('spent', 'authority')} / ({elapsed('fy', 'as_of')}) END, 6) + 0.0 AS burn_ratio FROM t""")
def state_summary(spark, sf_dir) -> DataFrame:
    """Budget, spend and pace by state and year, and how many of its ministries don't report."""
    rows = summary_of(spark, sf_dir).join(F.broadcast(p.ministries(spark, sf_dir)), "ministry_id")
    t = rows.groupBy("fy", F.concat(F.lit("st-"), "sector").alias("state_id")).agg(
        F.sum("be").alias("be"), F.sum("authority").alias("authority"), F.sum("spent").alias("spent"), F.max("as_of").alias("as_of"), F.count_if(F.col("spent").isNull()).alias("missing")
    )
    gone = cal.fraction_elapsed(F.col("fy"), F.col("as_of"))
    return t.select("fy", "state_id", "as_of", "missing", *r6("be", "authority", "spent"), (F.round(F.when(gone > 0, v.ratio(F.col("spent"), F.col("authority")) / gone), 6) + F.lit(0.0)).alias("burn_ratio"))


@query(with_parts("auth", "spent", "portal", "facts") + """, c AS (SELECT source_id, fy, stage, count(*) AS n FROM facts GROUP BY 1, 2, 3),
    usual AS (SELECT source_id, fy, stage AS usual_stage FROM c QUALIFY row_number() OVER (PARTITION BY source_id, fy ORDER BY n DESC, stage) = 1)
    SELECT f.source_id, f.fy, usual_stage, count(*) AS facts, count(DISTINCT entity_id) AS entities, max(document_date) AS newest, count(supersedes) AS supersessions
    FROM facts f JOIN usual u ON f.source_id = u.source_id AND f.fy = u.fy GROUP BY 1, 2, 3""")
def provenance(spark, sf_dir) -> DataFrame:
    """By source and year: facts, entities, newest document, usual stage and supersessions."""
    facts = p.fiscal_facts(spark, sf_dir)
    by_stage = facts.groupBy("source_id", "fy", "stage").agg(F.count("*").alias("n"), F.max("document_date").alias("newest"), F.count("supersedes").alias("s"))
    sums = by_stage.groupBy("source_id", "fy").agg(F.min_by("stage", F.struct(-F.col("n"), "stage")).alias("usual_stage"), F.sum("n").alias("facts"), F.max("newest").alias("newest"), F.sum("s").alias("supersessions"))
    entities = facts.groupBy("source_id", "fy").agg(F.count_distinct("entity_id").alias("entities"))
    return sums.join(entities, ["source_id", "fy"])


@query(SUMMARY + f"SELECT fy, ministry_id, {s6('be', 're')}, round(CAST(be - re AS DOUBLE) / abs(CAST(re AS DOUBLE)), 6) AS delta FROM summary WHERE re IS NOT NULL AND re != 0 AND be IS NOT NULL AND abs(CAST(be - re AS DOUBLE)) / abs(CAST(re AS DOUBLE)) > 0.01")
def reconciliation(spark, sf_dir) -> DataFrame:
    """Figures of two documents that differ by over one in a hundred; missing and zero ones are not compared."""
    rows = summary_of(spark, sf_dir).where("re is not null and re != 0 and be is not null")
    delta = (F.col("be") - F.col("re")).cast("double") / F.abs(F.col("re").cast("double"))
    return rows.withColumn("delta", delta).where(F.abs("delta") > 0.01).select("fy", "ministry_id", *r6("be", "re", "delta"))


@query(with_parts("ministry") + "SELECT sector, count(*) AS ministries, min(name) AS first_name FROM ministry GROUP BY 1")
def sectors(spark, sf_dir) -> DataFrame:
    """Sectors and their ministries."""
    return p.ministries(spark, sf_dir).groupBy("sector").agg(F.count("*").alias("ministries"), F.min("name").alias("first_name"))
