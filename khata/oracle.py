"""Common table expressions of the SQL twins: the projection and the views, as DuckDB reads them."""

from __future__ import annotations


def fy(day: str) -> str:
    return f"('FY' || CAST(year({day}) + CASE WHEN month({day}) > 3 THEN 1 ELSE 0 END AS VARCHAR))"


def month(day: str) -> str:
    return f"CAST((month({day}) + 8) % 12 + 1 AS INTEGER)"


def quarter(day: str) -> str:
    return f"CAST(floor(((month({day}) + 8) % 12) / 3) + 1 AS INTEGER)"


def start(label: str) -> str:
    return f"make_date(CAST(substr({label}, 3, 4) AS INTEGER) - 1, 4, 1)"


def end(label: str) -> str:
    return f"make_date(CAST(substr({label}, 3, 4) AS INTEGER), 3, 31)"


def elapsed(label: str, day: str) -> str:
    return f"CASE WHEN {day} < {start(label)} THEN 0.0 WHEN {day} > {end(label)} THEN 1.0 ELSE CAST(date_diff('day', {start(label)}, {day}) + 1 AS DOUBLE) / (date_diff('day', {start(label)}, {end(label)}) + 1) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


M = "DECIMAL(20,2)"

PARTS = {
    "ministry": "ministry AS (SELECT 'min-' || n_nationkey AS ministry_id, n_name AS name, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "scheme": "scheme AS (SELECT 'sch-' || s_suppkey AS scheme_id, 'min-' || s_nationkey AS ministry_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'CSS' WHEN 1 THEN 'CS' ELSE 'other' END AS scheme_type FROM supplier)",
    "auth": f"""cells AS (
        SELECT {fy('o_orderdate')} AS fy, c_nationkey AS nk, {quarter('o_orderdate')} AS q,
               CASE o_orderstatus WHEN 'F' THEN 'BE' WHEN 'O' THEN 'RE' ELSE 'SUPPLEMENTARY' END AS stage,
               CAST(sum(CAST(o_totalprice AS {M})) * 4 AS {M}) AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
    auth AS (
        SELECT fy || '|min-' || nk || '|' || stage || '|' || q AS fact_key, fy, 'ministry' AS entity_type, 'min-' || nk AS entity_id, stage, 'total' AS head,
               CAST(NULL AS DATE) AS period_end, FALSE AS is_cumulative, amount, CAST({start('fy')} + to_months((q - 1) * 3) AS DATE) AS document_date, 'budget' AS source_id,
               CASE WHEN q > 1 AND (nk + q) % 4 = 0 THEN fy || '|min-' || nk || '|' || stage || '|' || (q - 1) END AS supersedes
        FROM cells)""",
    "spent": f"""split AS (
        SELECT {fy('l_shipdate')} AS fy, s_nationkey AS nk, {month('l_shipdate')} AS month, CASE WHEN l_linestatus = 'F' THEN 'revenue' ELSE 'capital' END AS head,
               sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS {M}) ELSE CAST(l_extendedprice AS {M}) END) AS amount
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
    heads AS (SELECT fy, nk, month, head, amount FROM split UNION ALL SELECT fy, nk, month, 'total', sum(amount) FROM split GROUP BY 1, 2, 3),
    snapshots AS (
        SELECT fy, nk, head, month, CAST(sum(amount) OVER (PARTITION BY fy, nk, head ORDER BY month) AS {M}) AS amount,
               last_day(CAST({start('fy')} + to_months(month - 1) AS DATE)) AS period_end FROM heads),
    spent AS (
        SELECT fy || '|min-' || nk || '|EXPENDITURE|' || head || '|' || month AS fact_key, fy, 'ministry' AS entity_type, 'min-' || nk AS entity_id, 'EXPENDITURE' AS stage, head,
               period_end, TRUE AS is_cumulative, amount, CAST(period_end + 30 AS DATE) AS document_date, 'accounts' AS source_id, CAST(NULL AS VARCHAR) AS supersedes
        FROM snapshots)""",
    "portal": f"""portal AS (
        SELECT {fy('l_shipdate')} || '|sch-' || l_suppkey || '|' || CASE l_returnflag WHEN 'A' THEN 'RELEASE' WHEN 'R' THEN 'UTILIZATION' ELSE 'SANCTION' END AS fact_key,
               {fy('l_shipdate')} AS fy, 'scheme' AS entity_type, 'sch-' || l_suppkey AS entity_id,
               CASE l_returnflag WHEN 'A' THEN 'RELEASE' WHEN 'R' THEN 'UTILIZATION' ELSE 'SANCTION' END AS stage, 'total' AS head, CAST(max(l_shipdate) AS DATE) AS period_end,
               TRUE AS is_cumulative, CAST(sum(CAST(l_extendedprice AS {M})) AS {M}) AS amount, CAST(max(l_shipdate) AS DATE) AS document_date, 'portal' AS source_id, CAST(NULL AS VARCHAR) AS supersedes
        FROM lineitem GROUP BY 1, 2, 3, 4, 5)""",
    "facts": "facts AS (SELECT * FROM auth UNION ALL SELECT * FROM spent UNION ALL SELECT * FROM portal)",
    "current": """current_facts AS (
        SELECT * FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts n WHERE n.supersedes = f.fact_key)
        QUALIFY row_number() OVER (PARTITION BY fy, entity_type, entity_id, stage, head, period_end ORDER BY document_date DESC NULLS LAST, fact_key DESC) = 1)""",
    "authority": f"""authority AS (
        SELECT *, CAST(coalesce(re, be) + coalesce(supplementary, 0) AS {M}) AS authority FROM (
            SELECT fy, entity_type, entity_id, max(amount) FILTER (WHERE stage = 'BE') AS be, max(amount) FILTER (WHERE stage = 'RE') AS re,
                   CAST(sum(amount) FILTER (WHERE stage = 'SUPPLEMENTARY') AS {M}) AS supplementary
            FROM current_facts WHERE stage IN ('BE', 'RE', 'SUPPLEMENTARY') AND head = 'total' GROUP BY 1, 2, 3))""",
    "to_date": """latest AS (
        SELECT fy, entity_type, entity_id, head, arg_max(amount, period_end) AS amount, max(period_end) AS as_of
        FROM current_facts WHERE stage = 'EXPENDITURE' AND is_cumulative GROUP BY 1, 2, 3, 4),
    to_date AS (
        SELECT fy, entity_type, entity_id, max(amount) FILTER (WHERE head = 'total') AS spent, max(amount) FILTER (WHERE head = 'revenue') AS revenue,
               max(amount) FILTER (WHERE head = 'capital') AS capital, max(as_of) FILTER (WHERE head = 'total') AS as_of FROM latest GROUP BY 1, 2, 3)""",
    "monthly": f"""monthly AS (
        SELECT *, coalesce(amount < 0, FALSE) AS is_decrease FROM (
            SELECT fy, entity_type, entity_id, month, period_end, amount AS cumulative,
                   CAST(CASE WHEN m0 IS NULL AND month = 1 THEN amount WHEN month - m0 = 1 THEN amount - c0 END AS {M}) AS amount
            FROM (SELECT *, lag(amount) OVER w AS c0, lag(month) OVER w AS m0 FROM (
                    SELECT *, {month('period_end')} AS month FROM current_facts WHERE stage = 'EXPENDITURE' AND is_cumulative AND head = 'total')
                  WINDOW w AS (PARTITION BY fy, entity_type, entity_id ORDER BY month))))""",
    "summary": f"""summary0 AS (
        SELECT a.fy, a.entity_id AS ministry_id, be, re, supplementary, authority, spent, revenue, capital, as_of, CAST(authority - spent AS {M}) AS balance,
               {ratio('spent', 'authority')} AS share, CASE WHEN as_of IS NOT NULL THEN {elapsed('a.fy', 'as_of')} END AS elapsed, {ratio('(re - be)', 'be')} AS revision,
               {ratio('capital', '(coalesce(capital, 0) + coalesce(revenue, 0))')} AS capital_share
        FROM authority a LEFT JOIN to_date t ON a.fy = t.fy AND a.entity_id = t.entity_id AND a.entity_type = t.entity_type),
    summary AS (SELECT *, share * 100 AS pct_spent, CASE WHEN elapsed > 0 THEN share / elapsed END AS burn_ratio FROM summary0)""",
    "tender": f"""tender AS (
        SELECT o_orderkey, c_name AS org_raw, 'min-' || c_nationkey AS ministry_id, CAST(o_totalprice AS {M}) AS value,
               CASE o_orderstatus WHEN 'F' THEN 'awarded' WHEN 'O' THEN 'open' ELSE 'cancelled' END AS status, CAST(o_orderdate AS DATE) AS published
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "central": """central AS (SELECT o_orderkey, 'min-' || c_nationkey AS ministry_id, CAST(o_orderdate AS DATE) AS published FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')""",
    "run": """run AS (
        SELECT event_id AS run_id, 'src-' || (user_id % 16) AS source_id, ts AS started_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'drift_alert' ELSE 'ok' END AS status,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS n_rows, value AS total FROM events)""",
}

CURRENT = ("auth", "spent", "facts0", "current")


def with_parts(*names: str) -> str:
    """WITH and the parts of these names; facts of ministries alone unless "facts" or "portal" is asked for."""
    texts = []
    for n in names:
        texts.append("facts AS (SELECT * FROM auth UNION ALL SELECT * FROM spent)" if n == "facts0" else PARTS[n])
    return "WITH " + ",\n    ".join(texts) + "\n"


SUMMARY = with_parts("auth", "spent", "facts0", "current", "authority", "to_date", "summary")
