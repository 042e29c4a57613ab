"""Baselines of runs, flags under review and the ladder of names, on cases of our own."""

import datetime as dt
import random
import statistics

import pytest

from khata.operators import resolve, review, runs

AT = dt.datetime(2025, 1, 1)
RUN = "run_id long, source_id string, dataset string, started_at timestamp, status string, n_rows int, total double, n_errors int, columns array<string>"
COLUMNS = ["ministry", "expenditure"]


def history(spark, *steps, source="s", dataset="d"):
    rows = []
    for k, step in enumerate(steps):
        r = {"status": "ok", "n_rows": 100, "total": 5000.0, "n_errors": 0, "columns": COLUMNS} | step
        rows.append((k, source, dataset, AT + dt.timedelta(hours=7 * k), r["status"], r["n_rows"], r["total"], r["n_errors"], r["columns"]))
    return spark.createDataFrame(rows, RUN)


def last(spark, *steps):
    """finding: severity of the last run."""
    rows = runs.findings(runs.with_baseline(history(spark, *steps))).where(f"run_id = {len(steps) - 1}").collect()
    return {r.finding: r.severity for r in rows}


@pytest.mark.parametrize(
    "steps, found",
    [
        ([{}], {"no_baseline": "info"}), ([{"n_rows": 0, "total": None}], {"zero_rows": "high"}), ([{}, {"n_rows": 102}, {"n_rows": 98}, {"n_rows": 101}], {}), ([{}, {}, {"n_rows": 40}], {"row_count_swing": "warn"}),
        ([{}, {}, {"n_rows": 3}], {"row_count_swing": "high"}), ([{}, {"n_rows": 10}, {}, {}], {}), ([{}, {}, {"total": 500000.0}], {"total_amount_swing": "high"}), ([{}, {"total": None}], {}),
        ([{}, {"columns": [*COLUMNS, "revised"]}], {"column_set_change": "warn"}), ([{}, {"columns": ["ministry"]}], {"column_set_change": "high"}), ([{}, {"columns": COLUMNS[::-1]}], {}), ([{}, {"columns": []}], {}),
        ([{"n_rows": 1000}, {"n_rows": 1000, "n_errors": 5}], {"parse_error_rate": "info"}), ([{}, {"n_errors": 5}], {"parse_error_rate": "warn"}), ([{}, {"n_rows": 80, "n_errors": 20}], {"parse_error_rate": "high"}),
        ([{}, {}, *[{"n_rows": 3, "status": "drift_alert"}] * 12, {"n_rows": 3}], {"row_count_swing": "high"}), ([{"status": "failed"}, {}], {"no_baseline": "info"}), ([{}, {"n_rows": 0, "status": "failed"}], {}),
    ],
)
def test_drift_against_good_runs_only(spark, steps, found):
    assert last(spark, *steps) == found


def test_baselines_agree_with_a_plain_loop(spark):
    r = random.Random(6)
    rows = []
    for k in range(400):
        rows.append((k, r.choice(["a", "b", None]), r.choice(["x", None]), None if k == 5 else AT + dt.timedelta(hours=r.randrange(200)), r.choice(["ok", "ok", "failed", None]), r.randrange(50), r.choice([None, float(r.randrange(9))]), 0, r.choice([None, [], ["p"], ["q"]])))
    got = {x.run_id: (x.base_runs, x.base_n, x.base_total, x.base_columns) for x in runs.with_baseline(spark.createDataFrame(rows, RUN).repartition(3)).collect()}
    assert len(got) == 400
    for me in rows:
        order = lambda x: (x[3] is not None, x[3] or AT, x[0])
        good = sorted((x for x in rows if x[1:3] == me[1:3] and x[4] == "ok" and order(x) < order(me)), key=order)[-8:]
        totals = [x[6] for x in good if x[6] is not None]
        columns = next((x[8] for x in reversed(good) if x[8]), None)
        assert got[me[0]] == (len(good), statistics.median(x[5] for x in good) if good else None, statistics.median(totals) if totals else None, columns)


def test_states_of_runs(spark):
    rows = runs.with_baseline(history(spark, {}, {"n_rows": 60, "n_errors": 1}, {"n_rows": 30}, {"n_rows": 1}, {"status": "failed"}))
    got = {r.run_id: (r.state, r.written, r.severity) for r in runs.states(rows, runs.findings(rows)).collect()}
    assert got == {0: ("ok", True, "info"), 1: ("ok", True, "info"), 2: ("drift_alert", True, "warn"), 3: ("drift_alert", False, "high"), 4: ("failed", False, None)}


FLAG = "rule_id string, entity_type string, entity_id string, fy string, severity string, metric double, status string, created_at timestamp, reviewed_at timestamp, reviewed_by string"


def flag(rule, entity="m1", severity="notable", metric=1.0, status="pending", created=AT, reviewed=None, by=None, fy="FY2026", kind="ministry"):
    return (rule, kind, entity, fy, severity, metric, status, created, reviewed, by)


def test_a_rerun_keeps_decisions(spark):
    later = AT + dt.timedelta(days=30)
    old = spark.createDataFrame([flag("a", status="approved", reviewed=AT, by="x"), flag("b", status="rejected", reviewed=AT, by="y"), flag("c"), flag("gone")], FLAG)
    new = spark.createDataFrame([flag(r, severity="high", metric=2.0, created=later) for r in ("a", "b", "c", "d")], FLAG)
    got = {r.rule_id: (r.severity, r.metric, r.status, r.created_at, r.reviewed_by, r.action) for r in review.rerun(old, new).collect()}
    assert got == {
        "a": ("high", 2.0, "approved", AT, "x", "updated"), "b": ("high", 2.0, "rejected", AT, "y", "updated"), "c": ("high", 2.0, "pending", AT, None, "updated"),
        "d": ("high", 2.0, "pending", later, None, "inserted"), "gone": ("notable", 1.0, "pending", AT, None, "kept"),
    }


def test_the_first_decision_on_a_pending_flag_holds(spark):
    flags = spark.createDataFrame([flag("a"), flag("b", status="rejected", by="z"), flag("c")], FLAG)
    day = lambda n: AT + dt.timedelta(days=n)
    log = [("a", "rejected", day(3), "q"), ("a", "approved", day(2), "p"), ("a", "opened", day(1), "o"), ("b", "approved", day(1), "p"), ("c", "approved", None, "p"), ("none", "approved", day(1), "p")]
    decisions = spark.createDataFrame([(r, "ministry", "m1", "FY2026", d, t, w) for r, d, t, w in log], "rule_id string, entity_type string, entity_id string, fy string, decision string, decided_at timestamp, reviewer string")
    got = {r.rule_id: (r.status, r.reviewed_at, r.reviewed_by) for r in review.decide(flags, decisions).collect()}
    assert got == {"a": ("approved", day(2), "p"), "b": ("rejected", None, "z"), "c": ("pending", None, None)}


def test_only_approved_flags_are_published(spark):
    night = dt.datetime(2025, 1, 1, 20, 0)  # the next day in India
    flags = spark.createDataFrame([flag("a", status="approved", reviewed=night), flag("b"), flag("c", status="rejected"), flag("d", "s1", status="approved", kind="scheme"), flag("e", "m2", "high", status="approved")], FLAG)
    from pyspark.sql import functions as F

    flags = flags.withColumn("parent_id", F.when(F.col("entity_type") == "scheme", "m1"))
    assert [r.rule_id for r in review.published(flags).collect()] == ["a", "d", "e"]
    assert [(r.rule_id, str(r.day)) for r in review.published(flags, day="2025-01-02").collect()] == [("a", "2025-01-02")]
    assert {r.rule_id for r in review.published(flags, ministry_id="m1").collect()} == {"a", "d"}
    assert [r.rule_id for r in review.listed(flags).collect()][0] == "e" and review.listed(flags, "all").count() == 5 and review.listed(flags, "pending", entity_id="m1", fy=None).count() == 1


def test_evidence_is_the_newest_of_the_year(spark):
    flags = spark.createDataFrame([flag("a"), flag("b"), flag("c", "m2"), flag("n", "national", kind="national")], FLAG)
    days = [(k, "ministry", "m1", dt.date(2025, 4, 1) + dt.timedelta(days=k)) for k in range(9)] + [(50, "ministry", "m1", dt.date(2025, 3, 31)), (51, "ministry", "m1", None), (52, "ministry", "m1", dt.date(2025, 4, 9)), (53, "scheme", "m2", dt.date(2025, 5, 1))]
    items = spark.createDataFrame(days, "evidence_id long, entity_type string, entity_id string, published date")
    got = {r.rule_id: list(r.evidence) for r in review.with_evidence(flags, review.offered(flags, items)).collect()}
    assert got == {"a": [52, 8, 7, 6, 5, 4], "b": [52, 8, 7, 6, 5, 4], "c": [], "n": []}


ALIAS = "alias string, entity_id string, confidence double, resolved_by string"
ENTITIES = [("r", "Ministry of Road Transport"), ("j", "Department of Drinking Water and Sanitation"), ("w", "Department of Water Resources"), ("d", "Ministry of Defence")]


def down(spark, names, aliases=()):
    entities = spark.createDataFrame(ENTITIES, "entity_id string, name string")
    resolved, queue = resolve.ladder(spark.createDataFrame([(n,) for n in names], "name string"), entities, spark.createDataFrame(list(aliases), ALIAS))
    return {r.name: (r.entity_id, r.confidence, r.resolved_by) for r in resolved.collect()}, {r.name: [(s.entity_id, s.via) for s in r.suggestions] for r in queue.collect()}


def test_steps_of_the_ladder(spark):
    aliases = [("MoRTH", "r", 0.4, "human"), ("Drinking Water Mission", "j", 0.95, "agent"), ("Lost", "nowhere", 1.0, "human")]
    got, queue = down(spark, ["MoRTH", "M/o Road Transport", "Ministry of Defense", "Drinking Water Missions", "Department of Water", "zzz", "", None, "Lost"], aliases)
    assert got["MoRTH"] == ("r", 0.4, "exact") and got["Lost"] == ("nowhere", 1.0, "exact")  # as it stands, whatever its confidence
    assert got["M/o Road Transport"][::2] == ("r", "exact") and got["Ministry of Defense"] == ("d", 1.0, "exact")
    assert got["Department of Water"] == (None, 0.0, "queued") and {e for e, _ in queue["Department of Water"]} == {"w", "j"}
    assert got["zzz"] == (None, 0.0, "queued") and queue["zzz"] == [] and queue[""] == [] and None not in got
    assert ("j", "alias") in queue.get("Drinking Water Missions", [("j", "alias")]) and got["Drinking Water Missions"][0] in (None, "j")


def test_one_dominant_candidate_and_its_margin(spark):
    entities = spark.createDataFrame([("a", "national highway authority board one"), ("b", "coastal shipping register")], "entity_id string, name string")
    twin = entities.union(spark.createDataFrame([("c", "national highway authority board ones")], "entity_id string, name string"))
    names, none = spark.createDataFrame([("national highway authority board onee",)], "name string"), spark.createDataFrame([], ALIAS)
    assert [(r.entity_id, r.resolved_by) for r in resolve.ladder(names, entities, none)[0].collect()] == [("a", "trigram")]
    assert [(r.entity_id, r.resolved_by) for r in resolve.ladder(names, twin, none)[0].collect()] == [(None, "queued")]


def test_humans_outrank_machines(spark):
    aliases = spark.createDataFrame([("x", "old", 0.95, "human"), ("y", "old", 0.9, "agent")], ALIAS)
    resolved = spark.createDataFrame([("x", "new", 0.99, "trigram"), ("y", "new", 0.9, "trigram"), ("z", "new", 1.0, "exact"), ("low", "new", 0.89, "agent"), ("q", None, 0.0, "queued")], "name string, entity_id string, confidence double, resolved_by string")
    got = {r.alias: (r.entity_id, r.action) for r in resolve.remember(aliases, resolved).collect()}
    assert got == {"x": ("old", "kept"), "y": ("new", "updated"), "z": ("new", "inserted")}
    old = spark.createDataFrame([("x", "s1", "pending"), ("y", "s1", "done")], "name string, suggestions string, status string")
    new = spark.createDataFrame([("x", "s2"), ("y", "s2"), ("z", "s2")], "name string, suggestions string")
    got = {r.name: (r.suggestions, r.status, r.action) for r in resolve.queue_up(old, new).collect()}
    assert got == {"x": ("s2", "pending", "updated"), "y": ("s1", "done", "kept"), "z": ("s2", "pending", "inserted")}
