"""Labels, bands, grids, releases, names and records: small rules on rows of our own."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from khata.functions import calendar, money, text
from khata.operators import resolve, variance
from khata.plans import fiscal_queries
from khata.sources import named, tabular


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k long, x {kind}").orderBy("k").select(column(F.col("x"))).collect()]


def test_periods_with_years_of_their_own(spark):
    want = {
        "April 2025 to January 2026": ("2025-04-01", "2026-01-31", True), "April-March 2025-26": ("2025-04-01", "2026-03-31", True), "April–November 2025": ("2025-04-01", "2025-11-30", True),
        "January 2025-26": ("2026-01-01", "2026-01-31", False), "Nov. 2025/2026": ("2025-11-01", "2025-11-30", False), "Apr 2025 through Sept 2025": ("2025-04-01", "2025-09-30", True),
        "April-January 2026": ("2025-04-01", "2026-01-31", True), "April 2024 to January 2026": None, "December 2025 to April 2025": None, "April 2025-27": None, "April": None, "2025-26": None, "": None, None: None, "Smarch 2025": None,
    }
    got = values(spark, calendar.period_of, list(want))
    assert [p and (str(p.start), str(p.end), p.cumulative) for p in got] == list(want.values())


def test_labels_of_years_and_ages(spark):
    assert values(spark, calendar.short_label, ["FY2026", "FY2000", "x"]) == ["FY26", "FY00", None]
    assert values(spark, calendar.span_label, ["FY2026"]) == ["FY2026 (Apr 2025 to Mar 2026)"]
    assert values(spark, calendar.month_label, [dt.date(2025, 4, 9)], "date") == ["Apr 2025"]
    hours = [None, 0.0, 0.99, 1.0, 23.9, 24.0, 47.9, 48.0, 24.0 * 29, 24.0 * 30, 24.0 * 59, 24.0 * 60]
    assert values(spark, calendar.age_label, hours, "double") == [
        "Not yet fetched", "Within the hour", "Within the hour", "1h ago", "23h ago", "Yesterday", "Yesterday", "2 days ago", "29 days ago", "Last month", "Last month", "2 months ago"]
    assert values(spark, lambda x: calendar.age_label(x, "hi"), [5.0], "double") == ["5 घंटे पहले"]


def test_pace_in_words(spark):
    burn = [None, 0.49, 0.5, 0.85, 1.15, 1.16, 1.3, 1.31]
    assert values(spark, variance.burn_label, burn, "double") == ["Not reported", "Far behind pace", "Behind pace", "On pace", "On pace", "Ahead of pace", "Ahead of pace", "Far ahead of pace"]
    said = values(spark, variance.burn_sentence, [None, 1.154, 0.4, 1.5], "double")
    assert said[0].startswith("Spending pace cannot") and "in line" in said[1] and "about 60% below" in said[2] and "about 50% above" in said[3]


def test_rows_that_cannot_be_set_against_the_year(spark):
    rows = [("FY2026", "a", 100, 40, dt.date(2025, 9, 30)), ("FY2026", "b", 100, 0, dt.date(2025, 4, 1)), ("FY2026", "c", None, 1, dt.date(2025, 9, 30)), ("FY2026", "d", 0, 1, dt.date(2025, 9, 30)), ("FY2026", "e", 9, None, None)]
    summary = spark.createDataFrame([(f, m, a if a is None else Decimal(a), s if s is None else Decimal(s), d) for f, m, a, s, d in rows], "fy string, ministry_id string, authority decimal(20,2), spent decimal(20,2), as_of date")
    got = variance.pareto(summary).collect()
    assert [(r.ministry_id, r.weight) for r in got] == [("a", 1.0)]
    assert [tuple(r) for r in variance.skipped(summary).collect()] == [("FY2026", 1, 4)]


def test_names_by_their_rarest_words(spark):
    rows = [("e1", "Department of Space Research"), ("e2", "Department of Ocean Research"), ("e3", "Department"), ("e4", "The of India")] + [(f"x{k}", f"Department w{k}") for k in range(30)]
    entities = spark.createDataFrame(rows, "entity_id string, name string")
    names = spark.createDataFrame([("Space Research Department",), ("Dept of Ocean",), ("the of India",), ("nothing",), (None,)], "name string")
    got = {r.name: (r.entity_id, r.match) for r in resolve.match_tokens(names, entities).collect()}
    assert got == {"Space Research Department": ("e1", "medium"), "Dept of Ocean": ("e2", "medium"), "the of India": ("e4", "high"), "nothing": (None, "none"), None: (None, "none")}
    best = resolve.best_matches(names, entities).orderBy("name", "place").collect()
    # against all pairs
    words = lambda s: {{"dept": "department"}.get(w, w) for w in s.lower().split()} - set(text.NOISE)
    want = []
    for (n,) in [("Dept of Ocean",), ("Space Research Department",)]:
        scored = [(len(words(n) & words(e)) / len(words(n) | words(e)), e, i) for i, e in rows if words(e)]
        want += [(n, i, s) for s, e, i in sorted((x for x in scored if x[0] >= 0.34), key=lambda x: (-x[0], x[1]))[:5]]
    assert [(r.name, r.entity_id, pytest.approx(r.score)) for r in best] == want


def test_records_in_wide_layout_by_rows(spark):
    records = spark.createDataFrame([({"m": "Dept of Space", "y1": "5", "kind": "Net"},), ({"m": "Grand Total", "y1": "9", "kind": "Net"},), ({"m": " ", "y1": "1", "kind": "Net"},), ({"m": "Dept of Ocean", "kind": "Gross"},)], "record map<string,string>")
    columns = {"y1": ("FY2025", "BE")}
    assert [r.m for r in tabular.wide_to_long(records, columns, ["m"], keep_rows=("department of space",)).collect()] == ["Dept of Space"]
    assert sorted(r.m for r in tabular.wide_to_long(records, columns, ["m"], drop_rows=("grand total",)).collect()) == ["Dept of Ocean", "Dept of Space"]
    assert sorted(r.m for r in tabular.wide_to_long(records, columns, ["m"], by="kind", keep_rows=("net",), drop_rows=()).collect()) == ["Dept of Space", "Grand Total"]
    none = tabular.wide_to_long(records, columns, ["m"], keep_rows=("z", "a"))
    assert [tuple(r) for r in none.collect()] == [(None, None, None, None, "none of the rows: a, z")]
    assert tabular.long_amounts(none)[1].first().reason == "none of the rows: a, z"
    facts, errors = tabular.long_amounts(tabular.wide_to_long(records, columns, ["m"], drop_rows=("grand total",)), "crore")
    assert [(r.m, float(r.amount)) for r in facts.collect()] == [("Dept of Space", 5.0)] and [r.reason for r in errors.collect()] == ["missing column: y1"]


def test_units_and_cells_are_worked_out_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cells = spark.createDataFrame([("5 lakh",), ("5 furlongs",), (None,)], "cell string")
    factor = cells.select(money.factor_of(F.regexp_extract("cell", "[a-z]+", 0)).alias("f"))
    assert plan(factor).count("regexp_extract") == 1
    assert [r.f and float(r.f) for r in factor.collect()] == [0.01, None, None]
    long = spark.createDataFrame([("a", "5", None), ("b", "x", None), ("c", "-", None), ("d", None, "gone"), ("e", "7", "gone")], "k string, raw string, error string")
    facts, errors = tabular.long_amounts(long, "crore")
    assert plan(facts).count("percentage") == plan(errors).count("percentage") == 1
    assert [(r.k, float(r.amount)) for r in facts.collect()] == [("a", 5.0)]
    assert [(r.k, r.raw, r.reason) for r in errors.collect()] == [("b", "x", "letters that are no unit"), ("d", None, "gone"), ("e", "7", "gone")]


def test_grids(spark):
    cells = [(1, ["Head", "BE", "RE"]), (1, ["Roads", "12", "13"]), (1, ["Rail", "1,000", ""]), (2, ["one"]), (2, ["two"]), (2, ["three"]), (3, ["a", "1"]), (4, ["", ""]), (4, ["", ""]), (4, ["", ""])]
    grid = spark.createDataFrame(cells, "t long, cells array<string>")
    scored = tabular.grid_score(grid, ["t"])
    got = {r.t: (r.score, r.v) for r in scored.select("t", "score", tabular.grid_verdict(F.col("score")).alias("v")).collect()}
    want = (8 / 9) ** 0.5 * (0.3 + 0.7 * 3 / 5)
    assert got == {1: (round(want, 4), "trusted"), 2: (0.0, "unusable"), 3: (0.6, "trusted"), 4: (0.0, "unusable")}
    hint = money.unit_hint(F.array(F.lit("Head"), F.lit("BE (Rs. in lakh)")), F.lit("in crore"))
    assert spark.range(1).select(hint, money.unit_hint(F.array(F.lit("Head")), F.lit("none"), F.lit("All in crores")), money.unit_hint(F.array(F.lit("x")))).first()[:] == ("lakh", "crores", None)


def test_figures_for_review(spark):
    rows = [("12.5", "crore", 0.9), ("12.5", "crore", 0.84), ("12.5", "unstated", 0.99), ("n.a.", "crore", 0.99), ("5%", "crore", 0.99), ("１２", "lakh", 0.85), ("3", None, 1.0), ("3", "crore", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, cell string, unit string, c double").orderBy("k")
    got = [r[0] for r in df.select(money.reviewed(F.col("cell"), F.col("unit"), F.col("c"))).collect()]
    assert [(r.amount and float(r.amount), r.reason, r.needs_review) for r in got] == [
        (12.5, None, False), (12.5, None, True), (None, "no unit stated", True), (None, "no figure", True), (None, "percentage", True), (0.12, None, False), (None, "no unit stated", True), (3.0, None, True)]


def test_secrets_in_nested_values(spark):
    rows = spark.sql("SELECT 'key abcdef' AS a, named_struct('b', array('x', 'abcdef', NULL), 'm', map('abcdef', 'abcdefabcdef'), 'n', 5) AS s, array(named_struct('t', 'tiny')) AS l, CAST(NULL AS STRUCT<q: STRING>) AS z")
    r = text.redact_rows(rows, ["abcdef", "tiny"]).first()
    assert r.a == "key [redacted]" and r.s.b == ["x", "[redacted]", None] and r.s.m == {"abcdef": "[redacted][redacted]"} and r.s.n == 5 and r.l[0].t == "tiny" and r.z is None


def test_releases_with_days_and_amounts(spark):
    html = "<h2>M/o Power</h2><ul><li>12 Aug 2025 <a href='/Page.aspx?PRID=7'>Rs. 1,200 crore and ₹ 3 lakh crore approved</a></li><li><a href=\"https://o.org/p?prid=8\">No sum</a></li></ul><h3>" + "x" * 170 + "</h3><div><a href='/p?PRID=7'>again</a></div>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.release_id: r for r in named.press_releases(pages).collect()}
    assert set(got) == {"7", "8"}
    assert got["7"].ministry_normalised == "ministry of power" and got["7"].published_on == dt.date(2025, 8, 12) and got["7"].amount_mentions == ["Rs. 1,200 crore", "₹ 3 lakh crore"]
    assert got["7"].url == "https://pib.gov.in/Page.aspx?PRID=7" and got["8"].url == "https://o.org/p?prid=8" and got["8"].amount_mentions == [] and got["8"].published_on is None
    assert {r.published_on for r in named.press_releases(pages, listed_on=F.lit("2025-09-01").cast("date")).collect()} == {dt.date(2025, 9, 1)}


def test_baselines_carried_over_days(spark, tmp_path):
    day = lambda d, h: dt.datetime(2025, 1, d, h)
    rows = [(1, day(1, 1), 0, "view"), (2, day(1, 2), 0, "error"), (3, day(2, 1), 0, "error"), (4, day(4, 1), 0, "click"), (5, day(4, 1), 0, "error"), (6, day(1, 1), 1, "error"), (7, day(2, 1), 1, "view")]
    spark.createDataFrame([(*r, 1.0, '{"k": 1}') for r in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.run_id: (r.baseline_run, r.newest) for r in fiscal_queries.carried_baseline(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 5), 2: (1, 4), 3: (1, 3), 4: (4, 2), 5: (4, 1), 6: (None, 2), 7: (7, 1)}
