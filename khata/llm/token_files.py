"""Token ids in ORC files (4).

Documents are range-partitioned and sorted by id, and each partition writes one ORC file, so files and
rows lie in ascending order. Ids are a list of integers (run-length encoded); stripes hold a row index
and a Bloom filter on doc_id, by which readers skip stripes and row groups, and splits read stripes
in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, keep, scratch, table
from .tokens import encoder, in_parts

#: ORC settings: bytes of a stripe, rows of a row group, and the Bloom filter; run lengths are all the compression.
ORC = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "NONE"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Write doc_id and ids (the text's, then the end id) of every document, in ascending order of doc_id.

    A null or empty text has the end id alone. Rows that repeat a doc_id are all written, by text.
    """
    def encode(batches):
        tool = encoder(tokenizer, "byte")
        for batch in batches:
            for a, b in in_parts(pc.utf8_length(batch.column(1)).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), tool.encode_column(batch.column(1).slice(a, b - a), end)], names=["doc_id", "ids"])

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "doc_id long, ids array<int>").write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""

    def sums(batches):
        for batch in batches:
            ids = batch.column(1)
            flat, ends = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4"), np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - starts, "int64"), pa.array([zlib.crc32(flat[a:b]) for a, b in zip(starts, ends)], "int64"), batch.column(2), batch.column(3)],
                names=["doc_id", "n_tokens", "ids_crc32", "file", "place"],
            )

    rows = (
        spark.read.schema("doc_id long, ids array<int>").orc(path)
        .select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))
        .mapInArrow(sums, "doc_id long, n_tokens long, ids_crc32 long, file string, place long")
    )
    rows = keep(rows)
    # One row a file: a window over all of them is small.
    files = rows.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, F.col("file") == F.col("__file")).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, *doc_ids: int) -> DataFrame:
    """The rows of some documents; the filter reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path).where(F.col("doc_id").isin(*doc_ids))


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
