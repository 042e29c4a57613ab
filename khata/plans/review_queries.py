"""Queries on runs and their baselines, flags under review, evidence, and the ladder of names, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.operators import resolve, review, rules, runs
from khata.oracle import elapsed, end, fy, ratio
from khata.plans import projection as p
from khata.plans import views as v
from khata.plans.fiscal_queries import FLAGS, facts_of_ministries, query_into, r6
from khata.plans.once import once
from khata.plans.text_queries import grams, part_names

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = query_into(QUERIES, SQL)


RUNS = """WITH r AS (
        SELECT event_id AS run_id, 'src-' || (user_id % 16) AS source_id, 'set-' || (user_id % 3) AS dataset, ts AS started_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'drift_alert' ELSE 'ok' END AS status,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS n_rows, CAST(value AS DOUBLE) AS total, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 ELSE 0 END AS n_errors,
               CASE event_type WHEN 'signup' THEN ['ministry', 'amount', 'revised'] WHEN 'view' THEN ['amount', 'ministry'] ELSE ['ministry', 'amount'] END AS columns FROM events),
    good AS (SELECT *, row_number() OVER (PARTITION BY source_id, dataset ORDER BY started_at, run_id) AS k FROM r WHERE status = 'ok'),
    place AS (SELECT *, count(*) FILTER (WHERE status = 'ok') OVER (PARTITION BY source_id, dataset ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM r),
    based AS (
        SELECT x.run_id, count(g.run_id) AS base_runs, median(g.n_rows) AS base_n, median(g.total) AS base_total, arg_max(g.columns, g.k) AS base_columns
        FROM place x LEFT JOIN good g ON g.source_id = x.source_id AND g.dataset = x.dataset AND g.k BETWEEN x.place - 7 AND x.place GROUP BY 1),
    j AS (
        SELECT r.*, base_runs, base_n, base_total, base_columns, CASE WHEN n_rows + n_errors > 0 THEN n_errors / (n_rows + n_errors) END AS rate, CASE WHEN base_n != 0 THEN (n_rows - base_n) / abs(base_n) END AS by_n,
               CASE WHEN base_total != 0 THEN (total - base_total) / abs(base_total) END AS by_total, len(list_filter(base_columns, lambda c: NOT list_contains(columns, c))) AS gone, len(list_filter(columns, lambda c: NOT list_contains(base_columns, c))) AS new
        FROM r JOIN based USING (run_id)),
    found AS (
        SELECT run_id, source_id, dataset, 'zero_rows' AS finding, 'high' AS severity, CAST(n_rows AS DOUBLE) AS current, CAST(NULL AS DOUBLE) AS baseline FROM j WHERE n_rows = 0 AND status != 'failed'
        UNION ALL SELECT run_id, source_id, dataset, 'parse_error_rate', CASE WHEN rate >= 0.10 THEN 'high' WHEN rate >= 0.02 THEN 'warn' ELSE 'info' END, round(rate, 6), 0.1 FROM j WHERE rate > 0 AND status != 'failed'
        UNION ALL SELECT run_id, source_id, dataset, 'no_baseline', 'info', n_rows, NULL FROM j WHERE base_runs = 0 AND n_rows > 0 AND n_errors = 0 AND status != 'failed'
        UNION ALL SELECT run_id, source_id, dataset, 'row_count_swing', CASE WHEN abs(by_n) > 0.9 THEN 'high' ELSE 'warn' END, n_rows, round(base_n, 6) FROM j WHERE base_runs > 0 AND abs(by_n) > 0.5 AND status != 'failed'
        UNION ALL SELECT run_id, source_id, dataset, 'total_amount_swing', CASE WHEN abs(by_total) > 0.9 THEN 'high' ELSE 'warn' END, round(total, 6), round(base_total, 6) FROM j WHERE base_runs > 0 AND abs(by_total) > 0.5 AND status != 'failed'
        UNION ALL SELECT run_id, source_id, dataset, 'column_set_change', CASE WHEN gone > 0 THEN 'high' ELSE 'warn' END, new, gone FROM j WHERE base_runs > 0 AND gone + new > 0 AND status != 'failed')
    """


@query(RUNS + "SELECT * FROM found")
def run_drift(spark, sf_dir) -> DataFrame:
    """What looks wrong about each run, against the last eight good runs of its dataset before it."""
    return runs.findings(runs.with_baseline(p.run_metrics(spark, sf_dir)))


@query(RUNS + """, w AS (SELECT run_id, max(CASE severity WHEN 'high' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS w FROM found GROUP BY 1)
    SELECT r.run_id, source_id, dataset, CASE WHEN status = 'failed' THEN 'failed' WHEN w >= 2 THEN 'drift_alert' ELSE 'ok' END AS state, status != 'failed' AND coalesce(w, 0) < 3 AS written, CASE w WHEN 3 THEN 'high' WHEN 2 THEN 'warn' WHEN 1 THEN 'info' END AS severity
    FROM r LEFT JOIN w ON w.run_id = r.run_id""")
def run_states(spark, sf_dir) -> DataFrame:
    """The state that every run ends in, and whether its figures may be written."""
    rows = runs.with_baseline(p.run_metrics(spark, sf_dir))
    return runs.states(rows, runs.findings(rows))


@query(RUNS + """SELECT run_id, base_runs, base_n, round(base_total, 6) AS base_total, array_to_string(base_columns, ',') AS base_columns FROM based""")
def run_baselines(spark, sf_dir) -> DataFrame:
    """The baseline of every run, failed ones too."""
    return runs.with_baseline(p.run_metrics(spark, sf_dir)).select("run_id", "base_runs", *r6("base_n", "base_total"), F.array_join("base_columns", ",").alias("base_columns"))


EVERY_FLAG = FLAGS + f""", n0 AS (SELECT fy, sum(be) AS be, sum(re) AS re, sum(authority) AS authority, sum(spent) AS spent, max(as_of) AS as_of FROM summary GROUP BY 1),
    n1 AS (SELECT *, CASE WHEN as_of IS NOT NULL THEN {elapsed('fy', 'as_of')} END AS elapsed, {ratio('(re - be)', 'be')} AS revision, {ratio('spent', 'authority')} AS share FROM n0),
    n2 AS (SELECT *, CASE WHEN elapsed > 0 THEN share / elapsed END AS burn_ratio FROM n1),
    every AS (
        SELECT fy, 'ministry' AS entity_type, entity_id, rule_id, severity, round(metric, 6) AS metric FROM flags
        UNION ALL SELECT fy, 'national', 'national', 'under_utilization', CASE WHEN burn_ratio < 0.25 THEN 'high' ELSE 'notable' END, round(burn_ratio, 6) FROM n2 WHERE elapsed > 0.5 AND burn_ratio < 0.5
        UNION ALL SELECT fy, 'national', 'national', 'over_burn', CASE WHEN burn_ratio > 1.6 THEN 'high' ELSE 'notable' END, round(burn_ratio, 6) FROM n2 WHERE elapsed >= 0.25 AND burn_ratio > 1.3
        UNION ALL SELECT fy, 'national', 'national', 'revision_swing', CASE WHEN abs(revision) > 0.50 THEN 'high' ELSE 'notable' END, round(revision, 6) FROM n2 WHERE abs(revision) > 0.25)
    """
REVIEWED = EVERY_FLAG + f""", log AS (
        SELECT list_extract(['march_rush', 'under_utilization', 'over_burn', 'revision_swing', 'spend_no_tender', 'stat_outlier'], CAST(event_id % 6 AS INTEGER) + 1) AS rule_id, 'min-' || (user_id % 25) AS entity_id,
               'FY' || (1993 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) AS fy, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS decision, ts, CAST(user_id AS VARCHAR) AS reviewer
        FROM events WHERE event_type IN ('purchase', 'error')),
    first AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY rule_id, entity_id, fy ORDER BY ts, reviewer, decision) = 1),
    reviewed AS (
        SELECT e.*, CASE WHEN e.rule_id = 'stat_outlier' THEN 'inserted' ELSE 'updated' END AS action, coalesce(f.decision, 'pending') AS status, f.ts AS reviewed_at, f.reviewer AS reviewed_by, CAST({end('e.fy')} AS TIMESTAMP) AS created_at
        FROM every e LEFT JOIN first f ON e.rule_id != 'stat_outlier' AND e.entity_type = 'ministry' AND f.rule_id = e.rule_id AND f.entity_id = e.entity_id AND f.fy = e.fy)
    """


def flags_of_all_levels(spark, sf_dir) -> DataFrame:
    current = once(v.current_facts(facts_of_ministries(spark, sf_dir)))
    summary = once(v.summary(v.authority(current), v.expenditure_to_date(current)).withColumnRenamed("entity_id", "ministry_id").drop("entity_type"))
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("amount")))
    schemes = p.scheme_facts(spark, sf_dir).groupBy("fy", "entity_type", "entity_id").agg(at("UTILIZATION").alias("spent"), at("RELEASE").alias("released"))
    others = rules.national_measures(summary).unionByName(schemes, allowMissingColumns=True)
    return rules.evaluate(summary, v.monthly_spend(current), p.central_tenders(spark, sf_dir), others)


@query(EVERY_FLAG + "SELECT * FROM every")
def flags_of_every_level(spark, sf_dir) -> DataFrame:
    """Hits of the rules on ministries, schemes and the nation, in one assembly; money released goes before money spent."""
    return flags_of_all_levels(spark, sf_dir).select("fy", "entity_type", "entity_id", "rule_id", "severity", *r6("metric"))


def reviewed(spark, sf_dir) -> DataFrame:
    """Flags of a first run without stat_outlier, decided by the log, and then laid over by a run of all rules."""
    from khata.functions.calendar import fy_end

    raised = fy_end(F.col("fy")).cast("timestamp")
    new = flags_of_all_levels(spark, sf_dir).select(*review.KEY, "severity", *r6("metric"), "status", raised.alias("created_at"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewed_by"))
    new = once(new)
    old = new.where("rule_id != 'stat_outlier'").withColumn("metric", F.round("metric", 1)).withColumn("severity", F.lit("info"))
    return review.rerun(review.decide(old, p.review_log(spark, sf_dir)), new)


@query(REVIEWED + "SELECT fy, entity_type, entity_id, rule_id, severity, metric, status, reviewed_at, reviewed_by, created_at, action FROM reviewed")
def flags_after_review(spark, sf_dir) -> DataFrame:
    """Every flag after decisions and a rerun: figures are new, decisions stay."""
    return reviewed(spark, sf_dir)


ITEMS = f""", item AS (SELECT o_orderkey AS evidence_id, 'min-' || c_nationkey AS entity_id, CAST(o_orderdate AS DATE) AS published, {fy('o_orderdate')} AS fy FROM orders JOIN customer ON o_custkey = c_custkey),
    six AS (SELECT *, row_number() OVER (PARTITION BY fy, entity_id ORDER BY published DESC, evidence_id DESC) AS place FROM item QUALIFY place <= 6)
    """


@query(REVIEWED + ITEMS + """, lists AS (SELECT fy, entity_id, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY place) AS evidence FROM six GROUP BY 1, 2)
    SELECT r.fy, r.entity_type, r.entity_id, rule_id, severity, metric, coalesce(reviewed_at, created_at) AS published_at, CAST(coalesce(reviewed_at, created_at) + INTERVAL 330 MINUTE AS DATE) AS day, coalesce(evidence, '') AS evidence
    FROM reviewed r LEFT JOIN lists l ON l.fy = r.fy AND l.entity_id = r.entity_id WHERE status = 'approved'""")
def published_flags(spark, sf_dir) -> DataFrame:
    """All approved flags with the day of their publication and their newest evidence."""
    flags = once(reviewed(spark, sf_dir))
    rows = review.with_evidence(review.published(flags, limit=None), review.offered(flags, p.evidence_items(spark, sf_dir)))
    return rows.select(*review.KEY, "severity", "metric", "published_at", "day", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query(EVERY_FLAG + ITEMS + "SELECT e.fy, e.entity_type, e.entity_id, rule_id, evidence_id, CAST(place AS INTEGER) AS place FROM every e JOIN six s ON s.fy = e.fy AND s.entity_id = e.entity_id")
def evidence_of_flags(spark, sf_dir) -> DataFrame:
    """The bridge between flags and evidence: the six newest items of the entity within the year."""
    return review.offered(flags_of_all_levels(spark, sf_dir), p.evidence_items(spark, sf_dir))


@query(REVIEWED + """SELECT status, severity, count(*) AS flags, count(DISTINCT entity_id) AS entities, max(coalesce(reviewed_at, created_at)) AS newest FROM reviewed GROUP BY 1, 2""")
def review_states(spark, sf_dir) -> DataFrame:
    """How many flags stand in each state, by severity."""
    return reviewed(spark, sf_dir).groupBy("status", "severity").agg(F.count("*").alias("flags"), F.count_distinct("entity_id").alias("entities"), F.max(review.published_at()).alias("newest"))


PRINTED = """CASE k % 6 WHEN 1 THEN 'The ' || upper(name) WHEN 2 THEN replace(name, ' ', ' - ') WHEN 3 THEN substr(name, 1, length(name) - 1) WHEN 4 THEN upper(name) || ' LTD' WHEN 5 THEN 'zqx' || k ELSE name END"""
LADDER = f"""WITH e AS (SELECT 'part-' || min(p_partkey) AS entity_id, min(p_partkey) AS k, p_name AS name FROM part GROUP BY p_name),
    a AS (SELECT upper(name) || ' LTD' AS alias, entity_id, 0.85 + 0.05 * (k % 3) AS confidence, CASE WHEN k % 8 = 0 THEN 'human' ELSE 'agent' END AS resolved_by FROM e WHERE k % 4 = 0),
    asked AS (SELECT DISTINCT {PRINTED} AS name FROM e),
    known AS (SELECT name, entity_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN resolved_by IN ('exact', 'trigram', 'agent') THEN resolved_by ELSE 'exact' END AS resolved_by FROM asked JOIN a ON name = alias),
    open AS (SELECT name, {grams('name')} AS t FROM asked WHERE name NOT IN (SELECT alias FROM a)),
    spelled AS (SELECT entity_id, {grams('name')} AS t, 'reference' AS via FROM e UNION ALL SELECT entity_id, {grams('alias')}, 'alias' FROM a),
    scored AS (SELECT name, entity_id, via, len(list_intersect(open.t, spelled.t)) AS n, len(open.t) + len(spelled.t) AS m FROM open JOIN spelled ON TRUE),
    hits AS (SELECT name, entity_id, via, CAST(n AS DOUBLE) / (m - n) AS similarity FROM scored WHERE CAST(n AS DOUBLE) / (m - n) >= 0.35),
    best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY name, entity_id ORDER BY similarity DESC, via DESC) = 1),
    short AS (SELECT b.name, b.entity_id, e.name AS entity_name, similarity, via, row_number() OVER (PARTITION BY b.name ORDER BY similarity DESC, b.entity_id) AS place FROM best b JOIN e ON e.entity_id = b.entity_id QUALIFY place <= 8),
    normed AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS same FROM short),
    judged AS (
        SELECT o.name, arg_min(entity_id, place) FILTER (WHERE same) AS exact_id, max(entity_id) FILTER (WHERE place = 1) AS top_id, max(similarity) FILTER (WHERE place = 1) AS top, coalesce(max(similarity) FILTER (WHERE place = 2), 0) AS next,
               coalesce(string_agg(s.entity_id || ':' || CAST(CAST(round(similarity * 1000) AS INTEGER) AS VARCHAR) || ':' || via, ',' ORDER BY place), '') AS suggestions
        FROM open o LEFT JOIN normed s ON s.name = o.name GROUP BY 1),
    ruled AS (SELECT *, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN top >= 0.92 AND top - next >= 0.08 THEN 'trigram' ELSE 'queued' END AS resolved_by FROM judged)
    """


def names_and_aliases(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    entities = part_names(spark, sf_dir)
    keyed = entities.withColumn("k", F.substring_index("entity_id", "-", -1).cast("long"))
    names = keyed.select(F.expr(PRINTED).alias("name")).distinct()
    aliases = keyed.where("k % 4 = 0").select(F.concat(F.upper("name"), F.lit(" LTD")).alias("alias"), "entity_id", ((85 + 5 * (F.col("k") % 3)) / 100).alias("confidence"), F.when(F.col("k") % 8 == 0, "human").otherwise("agent").alias("resolved_by"))
    return names, entities, aliases


@query(LADDER + """SELECT name, entity_id, round(confidence, 6) AS confidence, resolved_by FROM known
    UNION ALL SELECT name, CASE resolved_by WHEN 'exact' THEN exact_id WHEN 'trigram' THEN top_id END, CASE resolved_by WHEN 'exact' THEN 1.0 WHEN 'trigram' THEN round(least(top, 0.99), 2) ELSE 0.0 END, resolved_by FROM ruled""")
def resolved_names(spark, sf_dir) -> DataFrame:
    """Part names as printed in other forms, each by the first step of the ladder that decides."""
    resolved, _ = resolve.ladder(*names_and_aliases(spark, sf_dir))
    return resolved.select("name", "entity_id", *r6("confidence"), "resolved_by")


@query(LADDER + "SELECT name, suggestions FROM ruled WHERE resolved_by = 'queued'")
def names_for_review(spark, sf_dir) -> DataFrame:
    """The names that no step decides, with what a reviewer is shown."""
    _, queue = resolve.ladder(*names_and_aliases(spark, sf_dir))
    shown = F.transform("suggestions", lambda s: F.concat_ws(":", s["entity_id"], F.round(s["similarity"] * 1000).cast("int").cast("string"), s["via"]))
    return queue.select("name", F.array_join(shown, ",").alias("suggestions"))
