"""Named sources on pages of our own: units, totals, headings, states of amounts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from khata.operators import narrative
from khata.sources import named


def pages(spark, *html):
    return spark.createDataFrame([(k, "https://x.org", h) for k, h in enumerate(html)], "page_id long, url string, html string")


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


ACCOUNTS = "<h2>Accounts, April to June 2025</h2><p>Rs. in crore</p><table>" + row("Entity", "BE", "Cumulative spend") + row("Alpha", "100", "1,234.5") + row("Beta", "9", "-") + row("Grand Total", "1", "5") + "</table>"


def test_monthly_accounts(spark):
    rows, errors = named.monthly_accounts(pages(spark, ACCOUNTS, ACCOUNTS.replace("Rs. in crore", "")))
    got = rows.collect()
    assert [(r.entity, float(r.amount), r.period_end, r.is_cumulative) for r in got] == [("Alpha", 1234.5, dt.date(2025, 6, 30), True)]
    assert [(r.page_id, r.entity, r.reason) for r in errors.collect()] == [(1, "Alpha", "no unit")]


def test_accounts_without_a_period_are_errors(spark):
    rows, errors = named.monthly_accounts(pages(spark, ACCOUNTS.replace("April to June 2025", "latest")))
    assert rows.count() == 0 and [(r.entity, r.reason) for r in errors.collect()] == [("Alpha", "no period")]


@pytest.mark.parametrize("mark", named.PERSONAL)
def test_tables_about_persons_are_refused(spark, mark):
    table = "<table>" + row("Total", mark.title()) + row("Funds transferred", "Rs 3 crore") + "</table>"
    beside = "<table>" + row("Item", "Figure") + row(f"Funds transferred by {mark}", "9 crore") + row("Amount disbursed", "Rs 5 crore") + "</table>"
    got = named.farmer_transfers(pages(spark, table, table + beside, beside.replace("5", "6") + table))[0].collect()
    assert sorted((r.page_id, float(r.amount)) for r in got) == [(1, 5.0), (2, 6.0)]


def test_transfers_beside_menus_and_in_boxes(spark):
    menu = '<div class="mobile-menu">Menu</div><p>Total funds transferred: Rs. 700 crore</p>'
    box = '<div class="stat-box"><span>Total beneficiaries</span> 9,12,345</div><div class="card">Amount Disbursed <b>₹ 2 lakh crore</b></div>'
    bad = "<table>" + row("Item", "Figure") + row("Total amount released", "about 5%") + "</table>"
    money, counts = named.farmer_transfers(pages(spark, menu, box, bad, "<p>Total funds: 5 crore</p>"))
    assert [(r.page_id, r.amount and float(r.amount), r.reason is None) for r in money.orderBy("page_id").collect()] == [(0, 700.0, True), (1, 200000.0, True), (2, None, False)]
    assert [(r.page_id, r.label, r.n) for r in counts.collect()] == [(1, "total beneficiaries", 912345)]


def test_scheme_releases(spark):
    page = "<p>As on 15-05-2026, in lakh</p><table>" + row("Scheme", "Release", "Transactions") + row("Roads", "500", "3") + row("Total", "500", "3") + "</table>"
    rows, _ = named.scheme_releases(pages(spark, page), "FY2026")
    assert [(r.entity, float(r.amount), r.period_end) for r in rows.collect()] == [("Roads", 5.0, dt.date(2026, 3, 31))]


def test_tenders(spark):
    page = "<table>" + row("S.No", "Reference", "Title", "Organisation", "Value in Rs.", "Published") + row("1", "2025_ABC_12_1", "Bridge", "Works", "1,00,00,000", "01-Jan-2025") + row("2", "x", "Road", "Works", "call us", "") + "</table>"
    got = named.tenders(pages(spark, page)).orderBy("title").collect()
    assert (got[0].tender_id, float(got[0].value), got[0].published) == ("2025_ABC_12_1", 1.0, dt.date(2025, 1, 1))
    assert got[1].value is None and got[1].reason and len(got[1].tender_id) == 16


def test_employment_and_market(spark):
    page = "<p>Rs. in lakh</p><table>" + row("Particulars", "Amount") + row("Central Release", "200") + row("State Release", "7") + row("Total expenditure as % of release", "9") + row("Total Expenditure", "100") + row("Balance of central release", "1") + "</table>"
    rows, _ = named.employment(pages(spark, page))
    assert {(r.stage, float(r.amount)) for r in rows.collect()} == {("RELEASE", 2.0), ("UTILIZATION", 1.0)}
    money, counts = named.marketplace(pages(spark, "<table>" + row("Order Value", "Rs 5 crore") + row("Order Value", "Rs 6 crore") + row("Sellers", "1,23,456") + "</table>"))
    assert [float(r.amount) for r in money.collect()] == [5.0] and [(r.metric, r.n) for r in counts.collect()] == [("seller_count", 123456)]


def test_press_and_persons(spark):
    page = "<h3>Ministry A</h3><a href='x?PRID=1'>One</a><a href='x?PRID=2'>Two</a><h3>Ministry B</h3><a href='x?PRID=3'>Three</a><a href='x?PRID=1'>One again</a>"
    assert {(r.release_id, r.ministry, r.title) for r in named.press_releases(pages(spark, page)).collect()} == {("1", "Ministry A", "One"), ("2", "Ministry A", "Two"), ("3", "Ministry B", "Three")}
    got = named.farmer_transfers(pages(spark, "<p>Total amount transferred: ₹ 3 lakh crore</p>", "<table><tr><td>Aadhaar</td></tr><tr><td>Amount transferred</td><td>₹ 3 crore</td></tr></table>"))[0].collect()
    assert [(r.page_id, float(r.amount)) for r in got] == [(0, 300000.0)]


def test_state_and_union_budgets(spark):
    page = "<p>in crore</p><table>" + row("Item", "2023-24 Actuals", "2024-25 Revised", "2025-26 Budget") + row("Capital outlay", "1", "2", "3") + row("Something else", "9", "9", "9") + "</table>"
    rows, _ = named.state_budgets(pages(spark, page))
    assert {(r.head, r.stage, r.fy, float(r.amount)) for r in rows.collect()} == {("capital", "EXPENDITURE", "FY2024", 1.0), ("capital", "RE", "FY2025", 2.0), ("capital", "BE", "FY2026", 3.0)}
    demands = spark.createDataFrame([("Roads", "A", "FY2026", "BE", 5), ("Interest Payments", "A", "FY2026", "BE", 7)], "demand string, ministry string, fy string, stage string, amount int")
    assert {(r.entity, r.amount) for r in named.union_budget(demands, ["interest payments"]).collect()} == {("india", 12), ("A", 5)}
    with pytest.raises(KeyError):
        named.source("nowhere")


def test_narrative_problems(spark):
    check = lambda t, *v: spark.range(1).select(narrative.problems(F.lit(t), F.array(*map(F.lit, v))).alias("p")).first().p
    assert check("Spent 12.5 crore.", 12.46) == [] and check("Spent 13 crore.", 12.4) == ["unsupported: 13"]
    assert check("A scam – of 5.", 5.0) == ["banned: scam", "dash"] and check(" ", 1.0) == ["empty"]
