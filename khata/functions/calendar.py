"""The fiscal calendar: years run from 1 April to 31 March and are named by the year in which they end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of period labels, by their number.
MONTHS = dict(zip("january february march april may june july august september october november december".split(), range(1, 13)))
# Ages in words, by language: never, under an hour, hours, a day, days, a month, months.
AGES = {
    "en": ("Not yet fetched", "Within the hour", "{}h ago", "Yesterday", "{} days ago", "Last month", "{} months ago"),
    "hi": ("अभी तक प्राप्त नहीं हुआ", "एक घंटे के भीतर", "{} घंटे पहले", "कल", "{} दिन पहले", "पिछले माह", "{} माह पहले"),
}


def let(value: Column, body) -> Column:
    """body(value), in which value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fy_of(day: Column) -> Column:
    """The fiscal year of a date: FY and the year, one more from April on."""
    return F.concat(F.lit("FY"), (F.year(day) + (F.month(day) > 3).cast("int")).cast("string"))


def fy_end_year(fy: Column, strict: bool = False) -> Column:
    """The ending year of FYnnnn (1950 to 2200); anything else is NULL, or an error if strict."""
    year = F.when(fy.rlike("^FY[0-9]{4}$"), F.substring(fy, 3, 4).cast("int"))
    year = F.when(year.between(1950, 2200), year)
    return F.when(fy.isNotNull() & year.isNull(), F.raise_error(F.concat(F.lit("not a fiscal year: "), fy)).cast("int")).otherwise(year) if strict else year


def fy_start(fy: Column) -> Column:
    return F.make_date(fy_end_year(fy) - 1, F.lit(4), F.lit(1))


def fy_end(fy: Column) -> Column:
    return F.make_date(fy_end_year(fy), F.lit(3), F.lit(31))


def fy_month_index(day: Column) -> Column:
    """April is 1, March is 12."""
    return ((F.month(day) + 8) % 12 + 1).cast("int")


def fy_quarter(day: Column) -> Column:
    return (F.floor((F.month(day) + 8) % 12 / 3) + 1).cast("int")


def quarter_start(fy: Column, quarter: Column) -> Column:
    return F.add_months(fy_start(fy), (quarter - 1) * 3)


def quarter_end(fy: Column, quarter: Column) -> Column:
    return F.last_day(F.add_months(fy_start(fy), quarter * 3 - 1))


def month_start(fy: Column, index: Column) -> Column:
    return F.add_months(fy_start(fy), index - 1)


def month_starts(fy: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.add_months(fy_start(fy), k - 1))


def is_within_fy(day: Column, fy: Column) -> Column:
    return day.between(fy_start(fy), fy_end(fy))


def fraction_elapsed(fy: Column, as_of: Column) -> Column:
    """Days gone, the day itself included, over the days of the year; 0 before and 1 after it."""
    gone, days = F.datediff(as_of, fy_start(fy)) + 1, F.datediff(fy_end(fy), fy_start(fy)) + 1
    return F.when(as_of < fy_start(fy), F.lit(0.0)).when(as_of > fy_end(fy), F.lit(1.0)).otherwise(gone.cast("double") / days)


def par_fraction(fy: Column, as_of: Column) -> Column:
    """As fraction_elapsed, but without the day itself on either side: 0 on 1 April, 1 on 31 March."""
    part = F.datediff(as_of, fy_start(fy)).cast("double") / F.datediff(fy_end(fy), fy_start(fy))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))


def shift_fy(fy: Column, by: int) -> Column:
    return F.concat(F.lit("FY"), (fy_end_year(fy) + by).cast("string"))


def recent_fys(fy: Column, count: int) -> Column:
    """The year and those before it, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.concat(F.lit("FY"), (fy_end_year(fy) - k).cast("string")))


def long_label(fy: Column) -> Column:
    """2025-26 for FY2026."""
    return F.concat((fy_end_year(fy) - 1).cast("string"), F.lit("-"), F.lpad((fy_end_year(fy) % 100).cast("string"), 2, "0"))


def short_label(fy: Column) -> Column:
    """FY26 for FY2026."""
    return F.concat(F.lit("FY"), F.lpad((fy_end_year(fy) % 100).cast("string"), 2, "0"))


def span_label(fy: Column) -> Column:
    """FY2026 (Apr 2025 to Mar 2026) for FY2026."""
    end = fy_end_year(fy)
    return F.concat(F.lit("FY"), end.cast("string"), F.lit(" (Apr "), (end - 1).cast("string"), F.lit(" to Mar "), end.cast("string"), F.lit(")"))


def month_label(day: Column) -> Column:
    """Apr 2025 for a day of that month."""
    return F.date_format(day, "MMM yyyy")


def age_label(hours: Column, language: str = "en") -> Column:
    """How long ago something was: by hours under a day, then by days, from thirty on by months of thirty; NULL was never."""
    never, hour, some_hours, day, some_days, month, some_months = AGES[language]
    days = F.floor(hours / 24)
    months = F.floor(days / 30)
    say = lambda text, n: F.replace(F.lit(text), F.lit("{}"), n.cast("string"))
    return (
        F.when(hours.isNull(), never).when(hours < 1, hour).when(hours < 24, say(some_hours, F.floor(hours))).when(days == 1, day)
        .when(days < 30, say(some_days, days)).when(months == 1, month).otherwise(say(some_months, months))
    )


def from_label(label: Column) -> Column:
    """FY2026 for 2025-26, 2025-2026 or 1999-00; NULL unless the years follow each other."""
    first = F.regexp_extract(label, r"^\s*((?:19|20)[0-9]{2})\s*[-/–]\s*([0-9]{2}|[0-9]{4})\s*$", 1)
    second = F.regexp_extract(label, r"^\s*((?:19|20)[0-9]{2})\s*[-/–]\s*([0-9]{2}|[0-9]{4})\s*$", 2)
    start = F.when(first != "", first.cast("int"))
    follows = F.when(F.length(second) == 4, second.cast("int") == start + 1).otherwise(F.when(second != "", second.cast("int")) == (start + 1) % 100)
    return F.when(follows, F.concat(F.lit("FY"), (start + 1).cast("string")))


def period_of(label: Column) -> Column:
    """struct(start, end, cumulative) of "April 2025", "April to December 2025", "April 2025 to January 2026" or "April-March 2025-26"; NULL where it can't be read.

    The last year belongs to the last month; a pair of years names the fiscal year in which the last month lies. The first
    month's own year goes before the one that follows from the last. A range is cumulative and may not leave the fiscal year.
    """
    low = F.lower(F.trim(F.regexp_replace(F.translate(label, "–—", "--"), r"\s+", " ")))
    names = "|".join(f"{m}|{m[:3]}" for m in MONTHS) + "|sept"
    to = r"(?:\s*-{1,2}\s*|\s+(?:to|through|till|upto|up to)\s+)"
    pattern = rf"^(?:(?:for|upto|up to)\s+)?({names})\.?(?:(?:[\s,]+((?:19|20)[0-9]{{2}}))?{to}({names})\.?)?[\s,]+((?:19|20)[0-9]{{2}})(?:\s*[-/]\s*([0-9]{{4}}|[0-9]{{2}}))?$"
    number = F.create_map(*[F.lit(x) for m, k in MONTHS.items() for x in (m[:3], k)])

    def place(parts: Column) -> Column:
        # first month, its own year, last month, year, second year of a pair; what does not match has one part.
        month = lambda k: F.try_element_at(number, F.substring(F.get(parts, F.lit(k)), 1, 3))
        year = lambda k: F.get(parts, F.lit(k)).try_cast("int")
        return let(F.struct(month(0).alias("a"), year(1).alias("own"), F.coalesce(month(2), month(0)).alias("b"), year(3).alias("year"), year(4).alias("pair"), month(2).isNotNull().alias("range")), years)

    def years(x: Column) -> Column:
        follows = (x["pair"] == x["year"] + 1) | (x["pair"] == (x["year"] + 1) % 100)
        last = F.when(x["pair"].isNull(), x["year"]).when(follows, x["year"] + (x["b"] <= 3).cast("int"))
        return let(F.struct(x.alias("x"), last.alias("last"), F.coalesce(x["own"], last - (x["a"] > x["b"]).cast("int")).alias("first")), days)

    def days(y: Column) -> Column:
        ends = F.struct(F.make_date(y["first"], y["x"]["a"], F.lit(1)).alias("start"), F.last_day(F.make_date(y["last"], y["x"]["b"], F.lit(1))).alias("end"), y["x"]["range"].alias("cumulative"))
        return let(ends, lambda p: F.when((p["start"] <= p["end"]) & (fy_of(p["start"]) == fy_of(p["end"])), p))

    return let(F.split(F.regexp_replace(low, pattern, r"$1|$2|$3|$4|$5"), "[|]"), place)


def parse_day(text: Column) -> Column:
    """The first of several formats that reads the text; NULL if none does."""
    # The formats, in the order in which they are tried.
    formats = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "dd-MM-yyyy HH:mm", "dd-MMM-yyyy hh:mm a", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def digest_day(moment: Column) -> Column:
    """The calendar day in India of an instant."""
    return F.to_date(F.from_utc_timestamp(moment, "Asia/Kolkata"))
