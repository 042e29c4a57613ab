"""Manifests of downloaded files, and demand sheets read by position, on cases of our own."""

import json

import pytest
from pyspark.sql import functions as F

from khata.sources import intake, workbook

def now():
    return F.lit("2025-06-01T00:00:00Z").cast("timestamp")


GOOD = {"source_url": "https://data.example.org/a.pdf", "retrieved_at": "2025-05-31T23:59:59Z", "retrieved_by": "clerk"}


def judge(spark, *texts):
    rows = spark.createDataFrame([(k, t if t is None or isinstance(t, str) else json.dumps(t)) for k, t in enumerate(texts)], "k int, manifest string")
    good, bad = intake.manifests(rows, now())
    return {r.k: r for r in good.collect()}, {r.k: list(r.reasons) for r in bad.collect()}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"titel": "x", "a": 1}, "unknown fields: a, titel"), ({"source_url": None}, "no source_url"), ({"source_url": "https://user:pw@host.org/x"}, "source_url is not public"), ({"source_url": "http://localhost/x"}, "source_url is not public"),
        ({"retrieved_by": "  "}, "no retrieved_by"), ({"retrieved_at": "2025-05-31T10:00:00"}, "retrieved_at has no zone"), ({"retrieved_at": "yesterday"}, "retrieved_at is no time"), ({"retrieved_at": "2025-13-31T10:00:00Z"}, "retrieved_at is no time"),
        ({"retrieved_at": "2025-06-01T00:00:01Z"}, "retrieved_at is in the future"), ({"document_date": "01/02/2025"}, "document_date is no date"), ({"document_date": "2025-06-02"}, "document_date is in the future"),
    ],
)
def test_manifests_that_may_not_enter(spark, change, reason):
    assert judge(spark, GOOD | change) == ({}, {0: [reason]})


def test_manifests_that_may(spark):
    good, bad = judge(spark, GOOD, GOOD | {"retrieved_at": "2025-06-01T05:29:00+05:30", "document_date": "2025-06-01", "title": "  ", "note": "by hand"}, None, "[]", "no json", "{}")
    assert bad == {2: ["no manifest"], 3: ["not an object"], 4: ["not an object"], 5: ["no source_url", "no retrieved_by", "retrieved_at is no time"]}
    assert good[0].title is None and good[1].title is None and good[1].note == "by hand" and str(good[1].retrieved_at) == "2025-05-31 23:59:00" and str(good[1].document_date) == "2025-06-01"


def test_files_meet_their_manifests(spark):
    late, early = json.dumps(GOOD), json.dumps(GOOD | {"retrieved_at": "2024-01-01T00:00:00Z"})
    files = [("a.pdf", "x"), ("a.pdf.manifest.json", late), ("b.pdf", "x"), ("b.pdf.manifest.json", early), ("c.pdf", "x"), ("d.pdf.manifest.json", late), ("e.pdf", ""), ("e.pdf.manifest.json", late)]
    good, bad = intake.intake(spark.createDataFrame(files, "name string, content string"), now())
    assert [r.name for r in good.collect()] == ["b.pdf", "a.pdf"]
    assert {r.name: list(r.reasons) for r in bad.collect()} == {"c.pdf": ["no manifest"], "d.pdf": ["no file"], "e.pdf": ["empty file"]}
    good, bad = intake.intake(spark.createDataFrame([], "name string, content string"), now())
    assert good.count() == 0 and bad.count() == 0


SHEET = [
    ["", "Ministry of Farms\nand Fields\n\n Demand No. 7 \nDepartment of   Seeds"], ["(In ₹ Crores)"], [], ["", "", "Actuals 2023-2024", "", "", "Budget Estimates 2024-2025", "", "Revised Estimates 2024-25", "Budget Estimates 2025-2026"],
    ["", "", "Revenue", "Capital", "Total", "Revenue", "Total", "Total", "Revenue", "TOTAL"], ["", "Gross", "9", "9", "9", "9", "9", "9", "9", "9"], ["", "Net", "", "", "1,234.50", "", "...", "-3", "7", "12"],
    ["A. The Budget allocation"], ["", "Net", "5", "5", "5", "5", "5", "5", "5", "5"],
]


def read(spark, *sheets):
    rows = [(n, k, cells) for n, sheet in enumerate(sheets) for k, cells in enumerate(sheet)]
    out, errors = workbook.demand_sheets(spark.createDataFrame(rows, "sheet int, row_no int, cells array<string>").repartition(5), ["sheet"])
    return out.collect(), {r.sheet: r.reason for r in errors.collect()}


def changed(row, cells):
    return [cells if k == row else r for k, r in enumerate(SHEET)]


def test_stages_of_a_sheet(spark):
    out, errors = read(spark, SHEET)
    assert errors == {} and {(r.demand_no, r.entity, r.owner) for r in out} == {("7", "Department of Seeds", "Ministry of Farms and Fields")}
    # Dots are no figure; each stage's total is its own, wherever it stands.
    assert {(r.stage, r.fy, float(r.amount)) for r in out} == {("EXPENDITURE", "FY2024", 1234.5), ("RE", "FY2025", -3.0), ("BE", "FY2026", 12.0)}


@pytest.mark.parametrize(
    "row, cells, reason",
    [
        (1, ["(In ₹ Lakhs)"], "amounts in lakh"), (1, ["amounts"], "no unit"), (0, ["Ministry of Farms"], "no owner"), (3, ["", "Actuals 2023-2024"], "no header of stages"), (4, ["", "Sum"], "no header of stages"),
        (6, ["", "Nett", "1"], "no Net row"), (3, ["", "", "Actuals", "", "", "Budget Estimates"], "no header of stages"),
    ],
)
def test_sheets_that_cannot_be_read(spark, row, cells, reason):
    assert read(spark, changed(row, cells)) == ([], {0: reason})


def test_odd_sheets(spark):
    one_line = changed(0, ["Lok Sabha, Demand No 9"])
    out, errors = read(spark, one_line, [[None], [None, None]], changed(6, ["", "Net", "", "", "n/a"]))
    assert {(r.sheet, r.entity, r.owner) for r in out} == {(0, "Lok Sabha", "Lok Sabha")} and errors == {1: "no unit"}
