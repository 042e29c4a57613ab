"""What the operators share: scratch tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been measured and holds at most so many bytes; beyond
#: it the same join is a shuffle join.
BROADCAST_BYTES = 16 << 20

#: Rows of the batches that go to Python workers: texts are long, and two batches are held at a time.
BATCH_ROWS = 1000

#: The bytes of the class [\x20\x09-\x0D], which separate words throughout.
SPACES = " \t\n\x0b\x0c\r"


_REMEMBERED: dict = {}


def remembered(owner, make):
    """make() of the operator that last ran in this Python worker; workers live on, so others' memories go."""
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        pa.default_memory_pool().release_unused()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names; a local one only in local mode where none is set."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='khata-')}"
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/khata-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = scratch(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The (kept) table with a broadcast hint if its values take up so many bytes at most, else as it is."""
    wide = [F.sum(F.octet_length(f.name)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, *more = df.agg(F.count("*"), *wide).first()
    size = n * 8 * len(df.columns) + sum(x or 0 for x in more)
    return F.broadcast(df) if size <= most else df


def numbered(docs: DataFrame, stored: bool = False) -> tuple[DataFrame, str]:
    """docs with a number of its own for every row, and the name of that column.

    Doc ids may be null or stand on several rows, so what is decided for a row is told by this number. docs are written with
    their numbers, so that these stay. stored says that docs is a table as read from Parquet files: then a row's file and
    its place there are its number, and nothing is written again.
    """
    name = "__row"
    while name in docs.columns:
        name += "_"
    file, place = f"{name}file", f"{name}place"
    if not stored:
        return keep(docs.withColumn(name, F.monotonically_increasing_id())), name
    rows = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    files = rows.select(F.col(file).alias("__file")).distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file")))  # a row a file
    files = small(keep(files))
    number = (F.col("__number").cast("long") * F.lit(1 << 40) + F.col(place)).alias(name)
    return rows.join(files, F.col(file) == F.col("__file")).select(*[F.col(f"`{c}`") for c in docs.columns], number), name


def without_rows(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """numbered() rows but for those of gone(gone), without their numbers; texts are not shuffled while few go."""
    gone = keep(gone.select(F.col("gone").alias("__gone")))
    return rows.join(small(gone), rows[name] == F.col("__gone"), "left_anti").drop(name)


def short_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to BATCH_ROWS rows, so that a worker's memory doesn't follow its partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty), so that other columns can't clash; batches of them are short."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def remainder(column, modulus: int):
    """crc32 of the id as text, modulo modulus: the rule by which rows are held out."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of every node of edges(a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is two aggregations and joins over the
    edges left, and their number grows with the logarithm of the largest component.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        joined = pairs.join(least, F.col("a") == F.col("k"))
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a > b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = mark(e)
    while True:
        e = keep(stars(stars(e, True), False))
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
