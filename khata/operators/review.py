"""Flags under review: reruns that keep decisions, decisions on what is pending, what may be published, and the evidence.

A flag is told by KEY. Its status is pending, approved or rejected; only a reviewer's decision moves it, from pending alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.calendar import fy_of
from khata.operators.upsert import merge

KEY = ["rule_id", "entity_type", "entity_id", "fy"]
PENDING, DECISIONS = "pending", ("approved", "rejected")
#: Columns of a flag that a rerun never changes.
SETTLED = ("created_at", "reviewed_at", "reviewed_by")
#: Evidence items of a flag at most; the place of a severity on a page.
EVIDENCE = 6
SEVERITY = {"high": 0, "notable": 1}


def rerun(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new flags merged by KEY, with action inserted, updated or kept.

    A flag that fires again gets the new severity, metric and explanation; its decision, its reviewer and when it was first
    raised stay. One that doesn't fire again is kept as it was. Flags must be unique by KEY on either side; missing parts
    of a key are equal.
    """
    before = old.select(*[F.col(c) for c in new.columns])
    merged = merge(before.withColumn("__was", F.col("status")), new.withColumn("__was", F.lit(None).cast("string")), KEY, keep_old=["__was", *SETTLED])
    status = F.when(F.coalesce("__was", F.lit(PENDING)) == PENDING, F.col("status")).otherwise(F.col("__was"))
    return merged.withColumn("status", status).drop("__was")


def decide(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """flags after decisions(KEY, decision, decided_at, reviewer): of each pending flag, the first decision holds.

    A decision other than approved or rejected, one without a time, and all on a flag that is settled or not there, change nothing.
    """
    good = decisions.where(F.col("decision").isin(*DECISIONS) & F.col("decided_at").isNotNull())
    first = good.groupBy(*KEY).agg(F.min(F.struct("decided_at", "reviewer", "decision")).alias("__d"))
    moved = (F.col("status") == PENDING) & F.col("__d").isNotNull()
    rows = flags.join(first, KEY, "left")
    pick = lambda name, value: F.when(moved, F.col(f"__d.{value}")).otherwise(F.col(name)).alias(name)
    changed = {"status": "decision", "reviewed_at": "decided_at", "reviewed_by": "reviewer"}
    return rows.select(*[pick(c, changed[c]) if c in changed else F.col(c) for c in flags.columns])


def published_at() -> Column:
    """When a flag was decided, or else raised."""
    return F.coalesce("reviewed_at", "created_at")


def listed(flags: DataFrame, status: str = "approved", limit: int = 100, **only) -> DataFrame:
    """A page of flags, the severest and then the newest first; approved ones unless another status, or all, is asked for.

    only: values that columns must have, None for any.
    """
    rows = flags if status == "all" else flags.where(F.col("status") == status)
    for name, value in only.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity")), F.lit(len(SEVERITY)))
    return rows.orderBy(rank, F.desc("created_at"), *KEY).limit(limit)


def published(flags: DataFrame, day: str | None = None, ministry_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """Approved flags with published_at and its day in India, newest first; no argument lets others through.

    ministry_id: that ministry's and its schemes' (a column parent_id names a scheme's ministry). limit None: all.
    """
    rows = flags.where("status = 'approved'").withColumn("published_at", published_at()).withColumn("day", F.to_date(F.col("published_at") + F.expr("INTERVAL 330 MINUTE")))
    if day is not None:
        rows = rows.where(F.col("day") == F.lit(day).cast("date"))
    if ministry_id is not None:
        rows = rows.where(((F.col("entity_type") == "ministry") & (F.col("entity_id") == ministry_id)) | ((F.col("entity_type") == "scheme") & (F.col("parent_id") == ministry_id)))
    rows = rows.orderBy(F.desc("published_at"), *KEY)
    return rows if limit is None else rows.limit(limit)


def offered(flags: DataFrame, evidence: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The bridge (KEY, evidence_id, place): of each flag the newest items of its entity within its year, most at most.

    evidence(evidence_id, entity_type, entity_id, published): items are ranked within entity and year before they meet flags, so
    that an entity with many items brings most of them and no more. The nation has no items of its own. Ties go to the larger id.
    """
    dated = evidence.where("published is not null").withColumn("fy", fy_of(F.col("published")))
    order = Window.partitionBy("fy", "entity_type", "entity_id").orderBy(F.desc("published"), F.desc("evidence_id"))
    newest = dated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("fy", "entity_type", "entity_id", "evidence_id", "place")
    return flags.where("entity_type != 'national'").select(*KEY).join(newest, ["fy", "entity_type", "entity_id"]).select(*KEY, "evidence_id", "place")


def with_evidence(flags: DataFrame, bridge: DataFrame) -> DataFrame:
    """flags with evidence, the ids of their items, newest first; none: an empty list. One join, whatever the page."""
    lists = bridge.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", "evidence_id"))).alias("__e"))
    return flags.join(lists, KEY, "left").withColumn("evidence", F.coalesce(F.col("__e.evidence_id"), F.array().cast("array<long>"))).drop("__e")
