"""The fiscal model laid over the given tables: which rows stand for ministries, facts, tenders and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from khata.functions.calendar import fy_month_index, fy_of, fy_quarter, fy_start, quarter_start

MONEY = "decimal(20,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ministries(spark, sf_dir) -> DataFrame:
    """ministry_id, name, sector: the nations, by region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("min-"), F.col("n_nationkey").cast("string")).alias("ministry_id"), F.col("n_name").alias("name"), F.col("r_name").alias("sector")
    )


def schemes(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, "CSS").when(F.col("s_suppkey") % 3 == 1, "CS").otherwise("other")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("sch-"), F.col("s_suppkey").cast("string")).alias("scheme_id"), F.concat(F.lit("min-"), F.col("s_nationkey").cast("string")).alias("ministry_id"),
        F.col("s_name").alias("name"), kind.alias("scheme_type"),
    )


def authority_facts(spark, sf_dir) -> DataFrame:
    """Budget stages: one document per quarter, from orders by the customer's nation."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", F.col("o_totalprice").cast(MONEY).alias("price"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"))
    stage = F.when(F.col("o_orderstatus") == "F", "BE").when(F.col("o_orderstatus") == "O", "RE").otherwise("SUPPLEMENTARY")
    cells = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(fy_of(F.col("day")).alias("fy"), "nk", fy_quarter(F.col("day")).alias("q"), stage.alias("stage"))
        .agg((F.sum("price") * 4).cast(MONEY).alias("amount"))
    )
    entity = F.concat(F.lit("min-"), F.col("nk").cast("string"))
    key = lambda q: F.concat_ws("|", "fy", entity, "stage", q.cast("string"))
    return cells.select(
        key(F.col("q")).alias("fact_key"), "fy", F.lit("ministry").alias("entity_type"), entity.alias("entity_id"), "stage", F.lit("total").alias("head"),
        F.lit(None).cast("date").alias("period_end"), F.lit(False).alias("is_cumulative"), "amount", quarter_start(F.col("fy"), F.col("q")).alias("document_date"),
        F.lit("budget").alias("source_id"), F.when((F.col("q") > 1) & ((F.col("nk") + F.col("q")) % 4 == 0), key(F.col("q") - 1)).alias("supersedes"),
    )


def expenditure_facts(spark, sf_dir) -> DataFrame:
    """Cumulative monthly snapshots by head, from line items by the supplier's nation."""
    items = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    price = F.col("l_extendedprice").cast(MONEY)
    # Added up by supplier first: the join then sees a row per supplier, month and head.
    by_supplier = items.groupBy("l_suppkey", fy_of(day).alias("fy"), fy_month_index(day).alias("month"), F.when(F.col("l_linestatus") == "F", "revenue").otherwise("capital").alias("head")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", -price).otherwise(price)).alias("amount")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"))
    split = by_supplier.join(suppliers, by_supplier.l_suppkey == suppliers.s_suppkey).groupBy("fy", "nk", "month", "head").agg(F.sum("amount").alias("amount"))
    heads = split.select("fy", "nk", "month", F.explode(F.array("head", F.lit("total"))).alias("head"), "amount").groupBy("fy", "nk", "month", "head").agg(F.sum("amount").alias("amount"))
    running = F.sum("amount").over(Window.partitionBy("fy", "nk", "head").orderBy("month")).cast(MONEY)
    snapshots = heads.withColumn("amount", running)
    entity = F.concat(F.lit("min-"), F.col("nk").cast("string"))
    end = F.last_day(F.add_months(fy_start(F.col("fy")), F.col("month") - 1))
    return snapshots.select(
        F.concat_ws("|", "fy", entity, F.lit("EXPENDITURE"), "head", F.col("month").cast("string")).alias("fact_key"), "fy", F.lit("ministry").alias("entity_type"), entity.alias("entity_id"),
        F.lit("EXPENDITURE").alias("stage"), "head", end.alias("period_end"), F.lit(True).alias("is_cumulative"), "amount", F.date_add(end, 30).alias("document_date"),
        F.lit("accounts").alias("source_id"), F.lit(None).cast("string").alias("supersedes"),
    )


def scheme_facts(spark, sf_dir) -> DataFrame:
    """Release, utilisation and sanction by scheme and year, as at the last shipping day."""
    items = table(spark, sf_dir, "lineitem")
    stage = F.when(F.col("l_returnflag") == "A", "RELEASE").when(F.col("l_returnflag") == "R", "UTILIZATION").otherwise("SANCTION")
    day = F.to_date("l_shipdate")
    cells = items.groupBy("l_suppkey", fy_of(day).alias("fy"), stage.alias("stage")).agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"), F.max(day).alias("period_end"))
    entity = F.concat(F.lit("sch-"), F.col("l_suppkey").cast("string"))
    return cells.select(
        F.concat_ws("|", "fy", entity, "stage").alias("fact_key"), "fy", F.lit("scheme").alias("entity_type"), entity.alias("entity_id"), "stage", F.lit("total").alias("head"), "period_end",
        F.lit(True).alias("is_cumulative"), "amount", F.col("period_end").alias("document_date"), F.lit("portal").alias("source_id"), F.lit(None).cast("string").alias("supersedes"),
    )


def fiscal_facts(spark, sf_dir) -> DataFrame:
    return authority_facts(spark, sf_dir).unionByName(expenditure_facts(spark, sf_dir)).unionByName(scheme_facts(spark, sf_dir))


def tenders(spark, sf_dir) -> DataFrame:
    """tender_id, org, ministry_id, value, status, published: all orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "awarded").when(F.col("o_orderstatus") == "O", "open").otherwise("cancelled")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .select("o_orderkey", "o_orderpriority", F.col("c_name").alias("org_raw"), F.concat(F.lit("min-"), F.col("c_nationkey").cast("string")).alias("ministry_id"), F.col("o_totalprice").cast(MONEY).alias("value"), status.alias("status"), F.to_date("o_orderdate").alias("published"))
    )


def central_tenders(spark, sf_dir) -> DataFrame:
    """The tenders that a central portal carries, which is not all of them: the urgent ones. Read by the rule spend_no_tender alone."""
    return tenders(spark, sf_dir).where("o_orderpriority = '1-URGENT'")


def pipeline_runs(spark, sf_dir) -> DataFrame:
    """run_id, source_id, started_at, status, rows: the events, by user."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "drift_alert").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("src-"), (F.col("user_id") % 16).cast("string")).alias("source_id"), F.col("ts").alias("started_at"), status.alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("n_rows"), F.col("value").alias("total"),
    )


def run_metrics(spark, sf_dir) -> DataFrame:
    """Runs with what they measured: the events by user, in three datasets a source.

    Rows that could not be read belong to clicks; signups have a column more, and views their columns in another order.
    """
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "drift_alert").otherwise("ok")
    columns = F.when(kind == "signup", F.array(*map(F.lit, ("ministry", "amount", "revised")))).when(kind == "view", F.array(*map(F.lit, ("amount", "ministry")))).otherwise(F.array(*map(F.lit, ("ministry", "amount"))))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("src-"), (F.col("user_id") % 16).cast("string")).alias("source_id"), F.concat(F.lit("set-"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.col("ts").alias("started_at"), status.alias("status"), k.alias("n_rows"), F.col("value").cast("double").alias("total"), F.when(kind == "click", k % 10).otherwise(0).alias("n_errors"), columns.alias("columns"),
    )


def review_log(spark, sf_dir) -> DataFrame:
    """Decisions on flags: purchases approve and errors reject a flag, told by event, user and payload; all else decides nothing."""
    from khata.operators.rules import RULES

    decision = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("opened")
    return table(spark, sf_dir, "events").select(
        F.get(F.array(*map(F.lit, RULES)), (F.col("event_id") % len(RULES)).cast("int")).alias("rule_id"), F.lit("ministry").alias("entity_type"), F.concat(F.lit("min-"), (F.col("user_id") % 25).cast("string")).alias("entity_id"),
        F.concat(F.lit("FY"), (1993 + F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias("fy"), decision.alias("decision"), F.col("ts").alias("decided_at"), F.col("user_id").cast("string").alias("reviewer"),
    )


def evidence_items(spark, sf_dir) -> DataFrame:
    """evidence_id, entity_type, entity_id, kind, title, published, summary: all orders; urgent and high ones have a summary."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    summary = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat("c_name", F.lit(": "), "o_orderstatus"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").cast("long").alias("evidence_id"), F.lit("ministry").alias("entity_type"), F.concat(F.lit("min-"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.lit("order").alias("kind"),
        F.col("c_name").alias("title"), F.to_date("o_orderdate").alias("published"), summary.alias("summary"),
    )
