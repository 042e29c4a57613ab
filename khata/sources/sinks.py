"""What goes out: safe CSV cells, feed entries, JSON envelopes, partitioned files, guarded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables that may be written.
WRITABLE = ("anomaly_flag", "entity_alias", "alias_review_queue", "parse_error", "verification_report")


def safe_cell(value: Column) -> Column:
    """Not reported for NULL, a quote before what a sheet would take for a formula, RFC quoting."""
    text = F.coalesce(value.cast("string"), F.lit("Not reported"))
    guarded = F.when(text.rlike("^[=+\\-@\\t\\r]") & ~text.rlike("^-?[0-9.]+$"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[safe_cell(c) for c in cells])


def escaped(text: Column) -> Column:
    """For XML: control characters dropped, then & < > and quotes."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def feed_entry(ident: Column, title: Column, updated: Column, body: Column) -> Column:
    return F.concat(
        F.lit("<entry><id>"), escaped(ident), F.lit("</id><title>"), escaped(title), F.lit("</title><updated>"), F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('</updated><content type="text">'), escaped(body), F.lit("</content></entry>"),
    )


def envelope(data: Column, fy: Column, mode: str = "live") -> Column:
    return F.to_json(F.struct(data.alias("data"), F.struct(fy.alias("fy"), F.lit(mode).alias("dataMode")).alias("meta")), {"ignoreNullFields": "false"})


def write_table(rows: DataFrame, name: str, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append to an allowed table, by partition; any other name is an error."""
    if name not in WRITABLE:
        raise ValueError(f"not a writable table: {name}")
    rows.write.mode("append").partitionBy(*partition_by).parquet(f"{path}/{name}")
