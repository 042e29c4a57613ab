"""Catalogues, lists of answers, the water mission and search as typed, on cases of our own."""

import datetime as dt
import json

from khata.operators import search
from khata.sources import catalogue, named


def pages(spark, *html):
    return spark.createDataFrame([(k, "https://x.org", h) for k, h in enumerate(html)], "page_id long, url string, html string")


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def answers(spark, *values):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "k int, answer string")


def test_entries_of_a_catalogue(spark):
    records = [{"index_name": " a ", "title": "Budget of Roads", "org_type": ["Central", "", "Works"], "source": "works.gov"}, {"resource_id": "b", "desc": "budget", "source": catalogue.COMMUNITY}, {"title": "no id"}, {"id": "c", "title": " "}, "text"]
    found = catalogue.entries(answers(spark, {"records": records}, {"records": [], "data": [{"id": "d", "name": "Rails", "sector": "Transport"}]}, "no json", "[]"))
    assert {(r.resource_id, r.title, r.organisation, r.sector) for r in found.collect()} == {("a", "Budget of Roads", "Central, Works", ""), ("b", "budget", catalogue.COMMUNITY, ""), ("c", "(untitled)", "", ""), ("d", "Rails", "", "Transport")}
    assert [r.resource_id for r in catalogue.search(found, "BUDGET").collect()] == ["a"]
    assert {r.resource_id for r in catalogue.search(found, "budget", official_only=False).collect()} == {"a", "b"}


def test_shape_of_a_resource(spark):
    declared = {"title": "T", "total": "12", "updated": "2025", "field": [{"id": "x"}, {"name": "y"}, {"type": "z"}], "records": [{"x": "v" * 70, "z": 1}]}
    rows = catalogue.shape(answers(spark, declared, {"count": 3, "desc": "D", "records": [{"b": 1.5, "a": None}]}, {"records": []}), "k").orderBy("k", "place").collect()
    assert [(r.k, r.title, r.record_count, r.name, r.sample) for r in rows] == [(0, "T", 12, "x", "v" * 60), (0, "T", 12, "y", catalogue.EMPTY), (1, "D", 3, "a", catalogue.EMPTY), (1, "D", 3, "b", "1.5")]


def test_answers_in_lists(spark):
    page = (
        "<ul><li>Q. No: 12 Ministry of Rural Development <a href='/a/one.pdf'>Roads built</a> 5 Mar 2025</li><li>Question 12 <a href='two.pdf'>Listed again</a></li>"
        "<li><a href='https://x.org/AU77.PDF?v=1'>Without number</a> 2025-04-01</li><li><a href='x.html'>No document</a><a href='y.pdf'>abc</a></li></ul>"
    )
    found, empty = named.parliament_answers(pages(spark, page, "<p>nothing", None))
    assert {(r.question_number, r.title, r.url, r.ministry, r.answered_on) for r in found.collect()} == {
        ("12", "Roads built", "https://sansad.in/a/one.pdf", "Ministry of Rural Development Roads built", dt.date(2025, 3, 5)), ("AU77", "Without number", "https://x.org/AU77.PDF?v=1", None, dt.date(2025, 4, 1)),
    }
    assert {r.page_id for r in empty.collect()} == {1, 2}


def test_what_schemes_used(spark):
    grid = [["Scheme", "Allocated 2023-24", "Utilised (Rs. in lakh)"], ["Roads", "9", "500"], ["Water", "9", "-"], ["Rails", "9", "many"], ["Total", "9", "500"]]
    undated, other = [["Scheme", "Amount spent"], ["Roads", "5"]], [["Scheme", "Allocated"], ["Roads", "5"]]
    cells = [(n, k, c) for n, g in enumerate((grid, undated, other)) for k, c in enumerate(g)]
    rows, errors = named.utilisation(spark.createDataFrame(cells, "t int, row_no int, cells array<string>"), ["t"])
    assert [(r.t, r.scheme, r.fy, float(r.amount)) for r in rows.collect()] == [(0, "Roads", "FY2024", 5.0)]
    assert {(r.t, r.scheme, r.reason) for r in errors.collect()} == {(0, "Rails", "letters that are no unit"), (1, None, "no fiscal year")}


def test_funds_and_connections(spark):
    table = "<table>" + row("Fund head", "Amount (Rs. in lakh)") + row("Central Share Released", "200") + row("State Share Release", "7") + row("Balance of central release", "1") + row("Total Exp.", "(50)") + row("Expenditure incurred", "5%") + "</table>"
    page = "<p>2024-25</p>" + table + '<div class="tile">Functional household <b>1,23,456</b> of 9</div><span class="count">Other 5</span>'
    funds, coverage, errors = named.water_mission(pages(spark, page, "<p>none"))
    assert {(r.label, r.stage, r.fy, float(r.amount)) for r in funds.collect()} == {("Central Share Released", "RELEASE", "FY2025", 2.0), ("Total Exp.", "UTILIZATION", "FY2025", -0.5)}
    assert [(r.page_id, r.n) for r in coverage.collect()] == [(0, 123456)] and [(r.label, r.reason) for r in errors.collect()] == [("Expenditure incurred", "percentage")]


def test_terms_as_typed():
    assert search.terms_of('"Rural  roads" OR health -tax -"old age"') == [[(True, " rural roads ")], [(True, " health "), (False, " tax "), (False, " old age ")]]
    assert search.terms_of(" - or or ") == [] and search.terms_of("-only") == [] and search.terms_of("M/o x") == [[(True, " m o "), (True, " x ")]]


def test_search_as_typed(spark):
    index = [("a", "Ministry of Rural Roads", "MoRR", "Transport"), ("b", "Roads of the rural kind", None, "Transport"), ("c", "Health", "Roads clinic", "Care"), ("d", "Helth", None, None), ("e", "Taxes", None, "roads")]
    rows = spark.createDataFrame([(i, "k", t, a, x) for i, t, a, x in index], "entity_id string, kind string, title string, aliases string, extra string")
    names = lambda text, n=20: [r.entity_id for r in search.web(rows, text, n).collect()]
    assert names('"rural roads"')[0] == "a"
    assert names("roads -rural") == ["c", "a", "b", "e"]  # two by their titles' likeness alone
    assert names("morr") == ["a"] and names("health or taxes")[:2] == ["c", "e"] and "d" in names("health")
    assert names("") == [] and names("roads", 1) == names("roads")[:1]
