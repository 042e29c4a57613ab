"""Approximate nearest neighbours (9) by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation) turn vectors into binary codes, which are
split into substrings. The vectors are dealt into blocks by a hash of their id; each block indexes
every substring of its codes. A query probes each index for all values within radius / substrings of its
own substring: by the pigeonhole principle this retrieves every code within the Hamming radius. What is
retrieved is ranked again by the inner product of the original vectors in double precision.
The radius is learned with the rotations: the smallest that keeps RECALL of the sample's true neighbours.
Queries meet blocks in tiles of bounded size, and each tile gives k rows a query at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Vectors that rotations and radius are learned from, at most (about).
SAMPLE = 20_000
#: Rotations, each giving one bit a dimension; bits of a substring.
ROTATIONS, SUBSTRING = 2, 16
#: Part of the sample's true neighbours that the radius must hold.
RECALL = 0.98
BLOCK, QUERIES = 8192, 4096


def rotation(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """An orthogonal matrix that brings centred x near the corners of a cube."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))[0]
    for _ in range(rounds):
        turned = x @ q
        u, _, v = np.linalg.svd(np.where(turned >= 0, 1.0, -1.0).T @ x)
        q = (u @ v).T
    return q


@dataclass
class Coder:
    mean: np.ndarray
    turns: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Substrings (rows of 16-bit numbers) of the vectors' codes."""
        bits = (x - self.mean) @ self.turns >= 0
        spare = -bits.shape[1] % SUBSTRING
        packed = np.packbits(np.pad(bits, ((0, 0), (0, spare))), axis=1)
        return packed.view(np.uint16)


def learn(sample: np.ndarray, k: int) -> Coder:
    x = np.asarray(sample, float)
    mean = x.mean(0)
    turns = np.hstack([rotation(x - mean, seed) for seed in range(ROTATIONS)])
    coder = Coder(mean, turns, 0)
    codes = coder.codes(x)
    asked = np.arange(0, len(x), max(1, len(x) // 500))
    far = []
    for i in asked:
        near = np.argsort(-(x @ x[i]), kind="stable")
        near = near[near != i][:k]
        far.append(np.bitwise_count(codes[near] ^ codes[i]).sum(1, dtype=np.int64))
    coder.radius = int(np.quantile(np.concatenate(far), RECALL)) if far and len(x) > 1 else turns.shape[1]
    return coder


def search_block(coder: Coder, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query_id, vec_id, score) of each query's k nearest in the block among the codes within the radius."""
    codes = coder.codes(x)
    substrings = codes.shape[1]
    index = [np.unique(codes[:, s], return_inverse=True) for s in range(substrings)]  # values, and each row's
    asked = coder.codes(queries)
    out = [], [], []
    for number, q, code in zip(query_ids, queries, asked):
        radius = coder.radius
        while True:
            found = np.zeros(len(x), bool)
            for s, (values, entries) in enumerate(index):
                found |= (np.bitwise_count(values ^ code[s]) <= radius // substrings)[entries]
            near = np.flatnonzero(found)
            near = near[np.bitwise_count(codes[near] ^ code).sum(1, dtype=np.int64) <= radius]
            near = near[ids[near] != number]
            if len(near) >= k or radius >= substrings * SUBSTRING:
                break
            radius = min(substrings * SUBSTRING, radius + substrings)  # too few: a wider radius
        scores = (x[near] * q).sum(1)  # row by row, so that equal vectors score the same
        best = np.lexsort((ids[near], -scores))[:k]
        out[0].append(np.full(len(best), number))
        out[1].append(ids[near][best])
        out[2].append(scores[best])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of vectors(vec_id, embedding) to each row for which is_query holds.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
    than most. The query's own row is no candidate; ties go to the smaller vec_id. Repeated rows: the same
    vec_id is found as often as it stands there. No vector or no query: no row.
    """
    spark = vectors.sparkSession
    value = F.col("embedding")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.cast("array<double>").alias("embedding")).where(
        F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(value, lambda v: v != 0)
    )
    good = keep(good)
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths[0]["d"], lengths[0]["count"]
    good = good.where(F.size("embedding") == d)
    part = max(1, n // SAMPLE)
    sample = good.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(part)) == 0) if part > 1 else good
    rows = sample.orderBy("vec_id").limit(2 * SAMPLE).collect() or good.limit(1).collect()
    coder = spark.sparkContext.broadcast(learn(np.array([r["embedding"] for r in rows]), k))
    queries = good.where(is_query)
    blocks, chunks = -(-n // BLOCK), max(1, -(-queries.count() // QUERIES))
    dealt = lambda df, m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    held = good.withColumn("block", dealt(good, blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", dealt(queries, chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "score": pa.array([], "float64")})
        left, right = left.sort_by("vec_id"), right.sort_by("vec_id")
        grid = lambda t: t["embedding"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, d)
        a, b, c = search_block(coder.value, left["vec_id"].to_numpy(), grid(left), right["vec_id"].to_numpy(), grid(right), k)
        return pa.table({"query_id": pa.array(a, "int64"), "vec_id": pa.array(b, "int64"), "score": pa.array(c, "float64")})

    found = held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
