"""Intake of files that people have downloaded, each beside a manifest that says where it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.sources import web

# The fields of a manifest, the ending of its name, and the forms of its times.
FIELDS = ("source_url", "retrieved_at", "retrieved_by", "document_date", "title", "content_type", "note")
SUFFIX = ".manifest.json"
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?"
ZONE = r"([Zz]|[+-]\d{2}:?\d{2})$"
DAY = r"^\d{4}-\d{2}-\d{2}$"


def manifests(rows: DataFrame, now: Column, json: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows with a manifest's text: good has its fields in their types, bad has reasons, all of them.

    A manifest must be a JSON object of FIELDS alone. source_url must be public, retrieved_by must be there, retrieved_at must be an
    instant with its zone, and neither it nor document_date may lie after now. An empty field that isn't needed is missing.
    """
    keys = F.json_object_keys(json)
    text = lambda f: F.nullif(F.trim(F.get_json_object(json, f"$.{f}")), F.lit(""))
    read = rows.withColumn("__keys", keys)
    for f in FIELDS:
        read = read.withColumn(f"__{f}", text(f))
    when, day = F.col("__retrieved_at"), F.col("__document_date")
    zoned = when.rlike(INSTANT + ZONE)
    instant, date = F.when(zoned, when.try_cast("timestamp")), F.when(day.rlike(DAY), day.try_cast("date"))
    unknown = F.array_sort(F.array_except("__keys", F.array(*map(F.lit, FIELDS))))
    url = F.col("__source_url")
    checks = F.array(
        F.when(F.col(json).isNull(), "no manifest"),
        F.when(F.col(json).isNotNull() & F.col("__keys").isNull(), "not an object"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))),
        F.when(F.col("__keys").isNotNull(), F.when(url.isNull(), "no source_url").when(~web.is_public(url), "source_url is not public")),
        F.when(F.col("__keys").isNotNull() & F.col("__retrieved_by").isNull(), "no retrieved_by"),
        F.when(
            F.col("__keys").isNotNull(),
            F.when(when.isNotNull() & ~zoned & when.rlike(INSTANT + "$"), "retrieved_at has no zone").when(instant.isNull(), "retrieved_at is no time").when(instant > now, "retrieved_at is in the future"),
        ),
        F.when(day.isNotNull(), F.when(date.isNull(), "document_date is no date").when(date > F.to_date(now), "document_date is in the future")),
    )
    judged = read.withColumn("reasons", F.array_compact(checks))
    kept = [F.col(c) for c in rows.columns if c != json]
    values = {"retrieved_at": instant, "document_date": date}
    good = judged.where(F.size("reasons") == 0).select(*kept, *[values.get(f, F.col(f"__{f}")).alias(f) for f in FIELDS])
    return good, judged.where(F.size("reasons") > 0).select(*kept, "reasons")


def intake(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of files(name, content): each document with its manifest's fields, the oldest download first.

    A file's manifest has its name and SUFFIX. A file without one, a manifest without its file, and an empty file are errors.
    """
    is_manifest = F.col("name").endswith(SUFFIX)
    beside = files.where(is_manifest).select(F.expr(f"left(name, length(name) - {len(SUFFIX)})").alias("name"), F.col("content").cast("string").alias("manifest"))
    papers = files.where(~is_manifest).select("name", "content")
    both = papers.join(beside, "name", "full")
    good, bad = manifests(both.where("content is not null"), now)
    empty = good.where(F.octet_length("content") == 0).select("name", F.array(F.lit("empty file")).alias("reasons"))
    alone = both.where("content is null").select("name", F.array(F.lit("no file")).alias("reasons"))
    return good.where(F.octet_length("content") > 0).orderBy("retrieved_at", "name"), bad.select("name", "reasons").union(empty).union(alone)
