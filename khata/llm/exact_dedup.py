"""Exact dedup (7): a tree-merge of digest runs.

Each input partition is a run of digests, sorted by them. In round r the runs of fan_in ** r neighbouring
partitions meet, a part of the digests in each task, and are merged in order: equal digests, which stand
together then, become one row with what is to retain and a count. Before each exchange a run is combined where it
lies, so of a group of copies one row per run travels. Spark sorts and merges here on both sides of an exchange: the
least of a struct is not kept in a hash table, but by sorted aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, keep, numbered, table, without_rows


def exact_dedup(docs: DataFrame, fan_in: int = 8, number: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text).

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; a null or empty text
    equals every text of white space alone. The row with the most code points stays, then the one of
    smallest doc_id. Rows that repeat a doc_id with the same text stay or go together, each counted
    in group_size. An empty table gives an empty result; other columns are not read. Digests are
    verified by a second, independent hash and the length: texts merge only if all three agree. With
    number, a column that tells rows apart, it is returned too and breaks the last ties: one row stays.
    """
    more = [number] if number else []
    text = F.translate("text", SPACES, "")
    runs = keep(
        documents(docs, *more)
        .select("doc_id", F.length("text").alias("size"), text.alias("bare"), F.spark_partition_id().alias("run"), *more)
        .select("doc_id", "size", "run", *more, F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), F.xxhash64("bare").alias("check"), F.length("bare").alias("bare_size"))
    )
    key = ["text_sha256", "check", "bare_size"]
    last = runs.agg(F.max("run")).first()[0] or 0
    merged = runs.select("run", *key, F.struct((-F.col("size")).alias("less"), "doc_id", *more).alias("best"), F.lit(1).cast("long").alias("n"))
    width = 1
    while True:
        width *= fan_in
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        merged = merged.groupBy("run", *key).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if width > last:
            break
    winners = merged.select(*(F.col(k).alias(f"w_{k}") for k in key), F.col("best.doc_id").alias("keep_id"), F.col("best.less").alias("less"), F.col("n").alias("group_size"), *(F.col(f"best.{m}").alias("w_number") for m in more))
    same = [F.col(k) == F.col(f"w_{k}") for k in key]
    kept = F.col(number) == F.col("w_number") if number else F.col("doc_id").eqNullSafe(F.col("keep_id")) & (-F.col("size") == F.col("less"))
    return runs.join(winners, same).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *more)


def unique_documents(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One row of docs, with all its columns, of each group of equal texts; ids may be null or clash. stored: see numbered()."""
    rows, number = numbered(docs, stored)
    return without_rows(rows, number, exact_dedup(rows, number=number).where("not kept").select(F.col(number).alias("gone")))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
}
