"""Best-fit packing (10), bulk-synchronous.

Documents of over half the capacity open a sequence each. The others follow in a few classes of length,
longest first. In a superstep the documents of a class and the gaps left in sequences are range-sorted by size,
and every partition sweeps its own from the largest down: a document takes the smallest gap at hand that
holds it, which is the one last met (successor). What a partition can't match, documents and gaps, goes by
rank: partitions say only how many they have left, these numbers are swept the same way, and the k-th
document of one partition takes the k-th gap from the end of another. So every gap is given to one
document, and the whole match is that of one sweep over all. Gaps are updated, as many empty sequences are
opened as the tokens left need beyond the gaps left, and the superstep repeats. Only numbers of the
partitions reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, keep, table
from .tokens import encoder, in_parts

CAPACITY = 2048
#: Parts of the capacity up to which documents wait until all longer ones are placed.
PARTS = (2, 8, 32)
#: Places that a gap offers in a superstep at most; rows of a range partition, at least and at most (about).
PLACES, LEAST_ROWS, ROWS = 64, 20_000, 500_000


def pieces(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and the end id, cut only beyond capacity."""
    last = end.to_bytes(4, "little")

    def cut(batches):
        tool = encoder(tokenizer, kind)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in in_parts(texts):
                rows = [x + last for x in tool.encode(texts[a:b])]
                sizes = np.array([len(x) // 4 for x in rows])
                count = -(-sizes // capacity)
                own = np.repeat(np.arange(len(rows)), count)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[own] - start, capacity)
                crc = [zlib.crc32(rows[k][s * 4 : (s + n) * 4]) for k, s, n in zip(own, start, length)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(own)), pa.array(piece, "int32"), pa.array(start, "int64"), pa.array(length, "int64"), pa.array(crc, "int64")],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(batches):
    """Matches of one partition of rows (size, kind, id, slot), largest first, slots (kind 0) before documents (kind 1) of one size.

    Gives rows (kind, part, rank, item, length, seq, slot): matches (0), documents left (1) and slots left (2), these two by rank.
    """
    part, open_slots, left = TaskContext.get().partitionId(), [], 0

    def told(rows):
        columns = zip(*rows)
        kinds = ("int32", "int32", "int64", "int64", "int64", "int64", "int32")
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["kind", "part", "rank", "item", "length", "seq", "slot"])

    for batch in batches:
        out = []
        for size, kind, number, slot in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                open_slots.append((number, slot))
            elif open_slots:
                out.append((0, part, 0, number, size, *open_slots.pop()))
            else:
                out.append((1, part, left, number, size, 0, 0))
                left += 1
        if out:
            yield told(out)
    for at in range(0, len(open_slots), 10_000):
        yield told([(2, part, at + k, 0, 0, *x) for k, x in enumerate(open_slots[at : at + 10_000])])


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (part, first, after, of, top) for partitions (part, documents left, slots left), largest sizes first.

    Document `rank` of part, from first until after, takes slot top - (rank - first) of the partition `of`. There are
    at most twice as many intervals as partitions.
    """
    stack: list[list[int]] = []
    found = []
    for part, documents_left, slots_left in left:
        rank = 0
        while rank < documents_left and stack:
            of, slots = stack[-1]
            n = min(slots, documents_left - rank)
            found.append((part, rank, rank + n, of, slots - 1))
            rank += n
            if n == slots:
                stack.pop()
            else:
                stack[-1][1] -= n
        if slots_left:
            stack.append([part, slots_left])
    return found


def superstep(waiting: DataFrame, gaps: DataFrame, least: int, most: int, parts: int):
    """One match of waiting(item, length), of lengths least to most, to gaps(seq, gap), each place matched once.

    Returns the matches (item, length, seq, slot), what is left (item, length), and their numbers.
    """
    # A gap that holds several documents of any length waiting offers as many places.
    places = F.least(F.lit(PLACES), F.greatest(F.lit(1), F.floor(F.col("gap") / most))).cast("int")
    offered = gaps.where(F.col("gap") >= least).withColumn("n", places).select("seq", "gap", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    size = F.when(F.col("slot") < F.col("n"), F.lit(most).cast("long")).otherwise(F.col("gap") - (F.col("n") - 1) * most)
    rows = waiting.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("item").alias("id"), F.lit(0).alias("slot"))
    rows = rows.union(offered.select(size.alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot"))
    order = [F.desc("size"), F.asc("kind"), F.asc("id"), F.asc("slot")]
    events = keep(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(sweep, "kind int, part int, rank long, item long, length long, seq long, slot int"))
    told = sorted(events.groupBy("part").agg(*(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(3))).collect())  # a row a partition
    spans = across([(part, n1, n2) for part, _, n1, n2 in told])
    n_matched, n_left = sum(r["n0"] for r in told), sum(r["n1"] for r in told)
    matched, left = events.where("kind = 0").select("item", "length", "seq", "slot"), events.where("kind = 1").select("part", "rank", "item", "length")
    if spans:
        # Written once: what is left is matched, counted, range-sampled and sorted after this.
        met = keep(left.mapInArrow(placed_across(spans), "item long, length long, of int, place long"))
        free = events.where("kind = 2").select(F.col("part").alias("__p"), F.col("rank").alias("__r"), "seq", "slot")
        asked = met.where("of is not null")
        matched = matched.union(asked.join(free, (F.col("of") == F.col("__p")) & (F.col("place") == F.col("__r"))).select("item", "length", "seq", "slot"))
        left = met.where("of is null")
        n_matched, n_left = (x + sign * sum(s[2] - s[1] for s in spans) for x, sign in ((n_matched, 1), (n_left, -1)))
    return matched, left.select("item", "length"), n_matched, n_left


def placed_across(spans: list[tuple[int, int, int, int, int]]):
    """A map of documents left (part, rank, item, length) to the partition and the place of the slot that spans give them, or none."""
    first, count, start, of, top = (np.array(x, np.int64) for x in zip(*((part << 40 | a, b - a, a, of, top) for part, a, b, of, top in sorted(spans))))

    def run(batches):
        for batch in batches:
            part, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            at = part << 40 | rank
            k = np.maximum(np.searchsorted(first, at, "right") - 1, 0)
            found = (at >= first[k]) & (at < first[k] + count[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), pa.array(of[k], "int32", mask=~found), pa.array(top[k] - (rank - start[k]), "int64", mask=~found)], names=["item", "length", "of", "place"]
            )

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items(doc_id, piece, length, ...), each of 1 to capacity tokens, with sequence_id and offset.

    Best fit, longest class first. Repeated rows are packed each for itself. No item: no row.
    """
    spark = items.sparkSession
    rows = keep(items.withColumn("__item", F.monotonically_increasing_id()))
    lengths = rows.select(F.col("__item").alias("item"), "length")
    highs = [capacity, *(capacity // k for k in PARTS)]
    of_class = sum((F.when(F.col("length") <= high, 1).otherwise(0) for high in highs[1:]), F.lit(0))
    sums = [F.count("*").alias("n"), F.sum("length").alias("tokens"), F.min("length").alias("least"), F.max("length").alias("most")]
    told = {r["k"]: r for r in lengths.groupBy(of_class.alias("k")).agg(*sums, F.max("item").alias("last")).collect()}  # a row a class
    smallest, made = min((r["least"] for r in told.values()), default=0), max((r["last"] for r in told.values()), default=-1) + 1
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Documents of over half the capacity have a sequence each, of their own number.
    long = lengths.where(F.col("length") > highs[1])
    placed = long.select("item", F.col("item").alias("seq"), F.lit(0).cast("long").alias("offset"))
    gaps = long.select(F.col("item").alias("seq"), (capacity - F.col("length")).alias("gap")).where(F.col("gap") >= smallest)
    for k, (low, high) in enumerate(zip([*highs[1:], 0], highs)):
        if not k or k not in told:
            continue
        waiting, now = lengths.where((F.col("length") > low) & (F.col("length") <= high)), told[k]
        while now["n"]:
            parts = max(min(usual, now["n"] // LEAST_ROWS + 1), 2 * now["n"] // ROWS)
            matched, left, n_matched, n_left = superstep(waiting, gaps, now["least"], now["most"], parts)
            if n_matched:
                earlier = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
                inside = F.coalesce(F.sum("length").over(earlier), F.lit(0))
                met = keep(matched.withColumn("inside", inside).join(gaps, "seq").select("item", "length", "seq", (capacity - F.col("gap") + F.col("inside")).alias("offset")))
                placed = placed.union(met.select("item", "seq", "offset"))
                used = met.groupBy("seq").agg(F.sum("length").alias("used"))
                gaps = keep(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where(F.col("gap") >= smallest))
            if not n_left:
                break
            waiting = left
            room = gaps.where(F.col("gap") > low).select(F.col("gap").alias("length"), F.lit(0).alias("k"))
            both = {r["k"]: r for r in waiting.select("length", F.lit(1).alias("k")).union(room).groupBy("k").agg(*sums).collect()}  # two rows
            now = both[1]
            more = -(-(now["tokens"] - (both[0]["tokens"] if 0 in both and n_matched else 0)) // capacity)
            if more > 0:
                gaps = gaps.union(spark.range(made, made + more).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
                made += more
    at = placed.select(F.col("item").alias("__at"), F.col("seq").alias("__seq"), F.col("offset").alias("__offset"))
    return rows.join(at, F.col("__item") == F.col("__at")).select(*items.columns, F.col("__seq").alias("sequence_id"), F.col("__offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents packed into sequences of at most capacity tokens.

    A null or empty text is one piece, its end id. Repeated rows are packed each for itself; an empty
    table gives an empty result; other columns are not read.
    """
    return pack(pieces(docs, tokenizer, capacity=capacity), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
