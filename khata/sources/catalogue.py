"""Catalogues of JSON resources: entries of an answer, search over them, and the shape of a resource's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that hold an entry's parts, in the order in which they are tried, and where the public publishes.
IDS = ("index_name", "resource_id", "id", "index")
TITLES = ("title", "desc", "description", "name")
ORGANISATIONS = ("org_type", "org", "source", "ministry")
UPDATED = ("updated_date", "updated", "created_date")
COMMUNITY = "visualize.data.gov.in"
UNTITLED, EMPTY, SAMPLE = "(untitled)", "(empty in the first record)", 60

ANSWER = "records array<string>, data array<string>, field array<struct<id:string,name:string>>, total string, count string, title string, desc string, updated_date string, updated string"


def _first(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that holds a text, or a list, whose members are joined; empty if none does."""
    def read(name):
        raw = F.get_json_object(record, f"$.{name}")
        members = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull() & (x != ""))
        return F.nullif(F.trim(F.when(raw.startswith("["), F.coalesce(F.array_join(members, ", "), raw)).otherwise(raw)), F.lit(""))

    return F.coalesce(*map(read, names), F.lit(""))


def entries(answers: DataFrame, json: str = "answer") -> DataFrame:
    """resource_id, title, organisation, sector, updated and source of every record of the answers that has an id.

    Records stand under records or, where that is empty or missing, under data. What isn't JSON has no entries.
    """
    read = F.from_json(json, ANSWER)
    listed = F.when(F.size(read["records"]) > 0, read["records"]).otherwise(read["data"])
    rows = answers.select(F.explode(listed).alias("r")).where(F.col("r").startswith("{"))
    r = F.col("r")
    out = rows.select(
        _first(r, IDS).alias("resource_id"), F.coalesce(F.nullif(_first(r, TITLES), F.lit("")), F.lit(UNTITLED)).alias("title"), _first(r, ORGANISATIONS).alias("organisation"),
        _first(r, ("sector",)).alias("sector"), _first(r, UPDATED).alias("updated"), _first(r, ("source",)).alias("source"),
    )
    return out.where("resource_id != ''")


def search(found: DataFrame, text: str = "", official_only: bool = True) -> DataFrame:
    """Entries whose titles hold the text, in any case; what the public publishes is left out unless asked for."""
    rows = found.where(F.lower("title").contains(text.lower())) if text else found
    return rows.where(F.col("source") != COMMUNITY) if official_only else rows


def shape(answers: DataFrame, key: str, json: str = "answer") -> DataFrame:
    """key, title, record_count, updated, place, name and sample: the fields of each answer's resource.

    Fields are those that the answer declares, in its order, else the keys of its first record, sorted; a sample is the first
    record's value, cut to SAMPLE characters. An answer without either has no rows.
    """
    rows = answers.select(key, F.from_json(json, ANSWER).alias("a")).withColumn("first", F.get("a.records", F.lit(0)))
    declared = F.filter(F.transform("a.field", lambda f: F.coalesce(F.nullif(f["id"], F.lit("")), F.nullif(f["name"], F.lit("")))), lambda x: x.isNotNull())
    names = F.when(F.size(declared) > 0, declared).otherwise(F.array_sort(F.json_object_keys("first")))
    count = F.coalesce("a.total", "a.count")
    about = rows.select(
        key, F.coalesce(F.nullif("a.title", F.lit("")), F.nullif("a.desc", F.lit("")), F.lit(UNTITLED)).alias("title"), F.when(count.rlike("^[0-9]+$"), count.cast("long")).alias("record_count"),
        F.coalesce("a.updated_date", "a.updated", F.lit("")).alias("updated"), F.from_json("first", "map<string,string>").alias("values"), F.posexplode(names).alias("place", "name"),
    )
    sample = F.substring(F.try_element_at("values", F.col("name")), 1, SAMPLE)
    return about.select(key, "title", "record_count", "updated", "place", "name", F.coalesce(F.nullif(sample, F.lit("")), F.lit(EMPTY)).alias("sample"))
