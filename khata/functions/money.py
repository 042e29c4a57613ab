"""Amounts as printed: three states (a value, not reported, an error), units, ratios and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from khata.functions.calendar import let

# What stands for a figure that is not reported.
NOT_REPORTED = ("", "-", "--", "---", "–", "—", ".", "..", "...", "*", "**", "na", "n.a.", "n.a", "n/a", "nr", "nil", "none", "not reported", "not available", "not applicable", "no data", "neg", "negligible")
# Units by name, longest first, and how many crore one is.
UNITS = {
    "lakhs crores": "100000", "lakhs crore": "100000", "lakh crores": "100000", "lakh crore": "100000", "lacs crores": "100000", "lacs crore": "100000", "lac crores": "100000", "lac crore": "100000",
    "thousand crores": "1000", "thousand crore": "1000", "crores": "1", "crore": "1", "cr.": "1", "cr": "1", "lakhs": "0.01", "lakh": "0.01", "lacs": "0.01", "lac": "0.01", "trillions": "100000", "trillion": "100000",
    "billions": "100", "billion": "100", "bn": "100", "millions": "0.1", "million": "0.1", "mn": "0.1", "thousands": "0.0001", "thousand": "0.0001", "rupees": "0.0000001", "rupee": "0.0000001",
}
# What a page without a unit is said to state, and the least confidence that needs no human.
UNSTATED, SURE = "unstated", 0.85
#: Digits of Devanagari, and characters of full width with those that they stand for.
FOLDED = ("०१२३४५६७८९\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F))), "0123456789 " + "".join(map(chr, range(0x21, 0x7F))))
VALUE, MISSING, ERROR = "value", "not_reported", "error"
NO_FIGURE = "Not reported"


def unit_of(text: Column) -> Column:
    """The unit that a heading or cell names, the longest first; NULL if none."""
    names = F.array(*map(F.lit, UNITS))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:^|[^a-z])({'|'.join(u.replace('.', '[.]') for u in UNITS)})(?=[^a-z]|$)"), F.lit(1))
    return F.get(names, F.array_min(F.transform(found, lambda u: F.array_position(names, u))).cast("int") - 1)


def factor_of(unit: Column) -> Column:
    """How many crore the unit is, looked up once: a chain of comparisons would work the unit out anew for each."""
    known = F.create_map(*[F.lit(x) if x is u else F.lit(x).cast("decimal(20,7)") for u, n in UNITS.items() for x in (u, n)])
    return F.try_element_at(known, unit)


def parse_crore(cell: Column, hint: Column | None = None) -> Column:
    """struct(status, value, reason) of a printed amount; value in crore with two places, half up.

    Brackets are a minus. A unit in the cell goes before the hint. Zero needs no unit; another bare number
    without one, a percentage, letters that are no unit, or grouping that is neither Indian nor Western
    are errors and never a missing figure.
    """
    given = factor_of(unit_of(hint)) if hint is not None else F.lit(None).cast("decimal(20,7)")
    names = "|".join(u.replace(".", "[.]") for u in UNITS)
    unit = rf"(?:^|[^a-z])({names})(?=[^a-z]|$)"

    def read(text: Column) -> Column:
        own = F.regexp_extract(text, unit, 1)
        bare = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(^|[^a-z])(?:{names})(?=[^a-z]|$)", "$1"), "₹|\\brs\\b[.]?|\\binr\\b|/-", ""))
        return let(F.struct(text.alias("text"), bare.alias("bare"), F.coalesce(factor_of(own), given).alias("factor"), F.trim(F.regexp_replace(bare, r"^\((.*)\)$|^[-+]", "$1")).alias("digits")), judge)

    def judge(x: Column) -> Column:
        grouped = x["digits"].rlike(r"^([0-9]+|[0-9]{1,3}(,[0-9]{2,3})*)([.][0-9]+)?$")
        return let(F.struct(x.alias("x"), F.when(grouped, F.regexp_replace(x["digits"], ",", "").try_cast("decimal(24,6)")).alias("number")), lambda y: finish(y["x"], y["number"]))

    def finish(x: Column, number: Column) -> Column:
        amount = F.when(number == 0, F.lit(0).cast("decimal(38,6)")).otherwise((number * x["factor"]).cast("decimal(38,6)"))
        value = F.round(amount, 2).cast("decimal(20,2)") * F.when(x["bare"].rlike(r"^(\(.*\)|-.*)$"), -1).otherwise(1)
        missing = x["text"].isNull() | x["text"].isin(*NOT_REPORTED)
        reason = (
            F.when(missing, None).when(x["text"].contains("%"), "percentage").when(x["digits"].rlike("[a-z]"), "letters that are no unit").when(number.isNull(), "not a number")
            .when((number != 0) & x["factor"].isNull(), "no unit")
        )
        status = F.when(missing, MISSING).when(reason.isNotNull(), ERROR).otherwise(VALUE)
        return F.struct(status.alias("status"), F.when(~missing & reason.isNull(), value.cast("decimal(20,2)")).alias("value"), reason.alias("reason"))

    return let(F.trim(F.lower(F.regexp_replace(F.translate(cell, *FOLDED), "[\u00a0\\s]+", " "))), read)


def unit_hint(header: Column, *captions: Column) -> Column:
    """The unit of a table's figures: of the first of its header's cells that names one, else of the first caption that does; NULL if none."""
    return F.coalesce(F.get(F.filter(F.transform(header, unit_of), lambda u: u.isNotNull()), F.lit(0)), *map(unit_of, captions))


def reviewed(cell: Column, unit: Column, confidence: Column) -> Column:
    """struct(amount, reason, needs_review) of a figure read off a page, with the unit that stands there ("unstated" if none does).

    Without a unit the amount is never guessed. A figure that can't be used, or was read with less than sure confidence, is
    for a human; so is one whose confidence is missing.
    """
    def judge(p: Column) -> Column:
        reason = F.when(unit.isNull() | (unit == UNSTATED), "no unit stated").when(p["status"] == MISSING, "no figure").otherwise(p["reason"])
        amount = F.when(reason.isNull(), p["value"])
        return F.struct(amount.alias("amount"), reason.alias("reason"), (amount.isNull() | F.coalesce(confidence < SURE, F.lit(True))).alias("needs_review"))

    return let(parse_crore(cell, unit), judge)


def group_indian(value: Column, places: int = 2) -> Column:
    """1234567.5 as 12,34,567.50; NULL stays NULL."""
    text = F.abs(value).cast(f"decimal(30,{places})").cast("string")
    whole = F.substring_index(text, ".", 1)
    rest = F.when(text.contains("."), F.concat(F.lit("."), F.substring_index(text, ".", -1))).otherwise("")
    head = F.when(F.length(whole) > 3, F.regexp_replace(F.left(whole, F.length(whole) - 3), r"\B(?=([0-9]{2})+(?![0-9]))", ","))
    tail = F.right(whole, F.lit(3))
    return F.concat(F.when(value < 0, "-").otherwise(""), F.when(head.isNotNull(), F.concat(head, F.lit(","), tail)).otherwise(tail), rest)


def format_crore(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), group_indian(value), F.lit(" cr")), F.lit(NO_FIGURE))


def sum_if_all(*parts: Column) -> Column:
    """The sum, unknown if any part is."""
    return reduce(lambda a, b: a + b, parts)


def null_ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def lakh_crore(crore: Column, places: int = 2) -> Column:
    """An amount in crore as lakh crore: ₹48.32 lakh cr."""
    return _with_signs(crore * F.lit("0.00001").cast("decimal(6,5)"), places, " lakh cr")


def auto(crore: Column) -> Column:
    """Lakh crore from one lakh crore on, whichever its sign, else crore, without places where the amount is whole."""
    whole = F.round(crore * 100) % 100 == 0
    small = F.when(whole, _with_signs(crore, 0, " cr")).otherwise(_with_signs(crore, 2, " cr"))
    return F.when(F.abs(crore) >= 100000, lakh_crore(crore)).otherwise(F.coalesce(small, F.lit(NO_FIGURE)))


def compact(crore: Column) -> Column:
    """For the labels of an axis: no sign of currency, places from one lakh crore on and below ten crore; empty if not reported."""
    size, text = F.abs(crore), lambda x, places: group_indian(_rounded(x, places), places)
    return F.coalesce(
        F.when(size >= 100000, F.concat(text(crore * F.lit("0.00001").cast("decimal(6,5)"), 2), F.lit(" lakh cr"))).when(size >= 10, F.concat(text(crore, 0), F.lit(" cr"))).otherwise(F.concat(text(crore, 2), F.lit(" cr"))),
        F.lit(""),
    )


def _rounded(value: Column, places: int) -> Column:
    return F.round(value, places).cast(f"decimal(30,{places})")


def _with_signs(value: Column, places: int, unit: str) -> Column:
    """The sign stands before that of the currency."""
    number = group_indian(F.abs(_rounded(value, places)), places)
    return F.coalesce(F.concat(F.when(value < 0, "-").otherwise(""), F.lit("₹"), number, F.lit(unit)), F.lit(NO_FIGURE))


def percent(value: Column, places: int = 1, signed: bool = False) -> Column:
    """A percentage, 42.35 as 42.4%."""
    plus = F.when(value >= 0, "+").otherwise("") if signed else F.lit("")
    return F.coalesce(F.concat(plus, group_indian(_rounded(value, places), places), F.lit("%")), F.lit(NO_FIGURE))
