"""Hard-negative mining (13) by segment summary filtering.

The written index holds, beside each row's integer components, the mean and the deviation of every segment at several
lengths of segment. Of two segments of m components the product of means plus or minus the product of deviations, times m,
bounds the inner product from both sides, and the sum over segments bounds the score. Within a tile of anchors and
rows, an anchor's rows are bounded by long segments first; those that can still rank are bounded by shorter ones, and only
what the shortest leave is scored exactly, in integers. The bar to reach is the exact score of the rows with the highest bounds.

Anchors meet all rows of their label for positives, and all rows for negatives, in tiles of bounded size; a tile
gives a few rows an anchor. Labels and lengths are dealt by their counts, so a frequent label is many tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, short_batches, small, table

#: Lengths of segments, longest first.
SEGMENTS = (16, 4, 2)
#: Rows and anchors of a tile, at most about.
BLOCK, CHUNK = 32_768, 4096
#: Rows of a tile below which it isn't cut further for the sake of idle cores.
LEAST = 1024
#: Share of the product of norms by which bounds in single precision are widened.
SLACK = 1e-5
POSITIVES, NEGATIVES = 5, 5

INDEX = "num long, vec_id long, label long, d int, v array<long>, means array<float>, deviations array<float>"
_VALUES = pa.schema([("num", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("d", pa.int32()), ("v", pa.list_(pa.int64())), ("means", pa.list_(pa.float32())), ("deviations", pa.list_(pa.float32()))])


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all SEGMENTS, in that order; both times the root of the segment's length."""
    means, deviations = [], []
    for m in SEGMENTS:
        cut = np.pad(v, ((0, 0), (0, -v.shape[1] % m))).astype(float).reshape(len(v), -1, m)
        mean = cut.mean(2)
        means.append(mean * np.sqrt(m))
        deviations.append(np.sqrt(np.square(cut - mean[:, :, None]).sum(2)))
    return np.hstack(means).astype(np.float32), np.hstack(deviations).astype(np.float32)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _grid(column, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def index(vectors: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """The written table of rows that take part: num (a number of its own), vec_id, label, d, v, means, deviations.

    No part take rows with a null vec_id, label or vector, with a null or non-finite component, or whose integer components
    have a sum of squares of 2^62 or more (their scores would not fit a long).
    """
    spark = vectors.sparkSession
    short_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**31 / scale)))
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.select(F.monotonically_increasing_id().alias("num"), "vec_id", moved.alias("label"), F.size("embedding").alias("d"), v.alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x) < 2.0**62)

    def summarise(batches):
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for d in np.unique(lengths):
                some = batch.take(pa.array(np.flatnonzero(lengths == d)))
                yield pa.RecordBatch.from_arrays([*some.columns, *map(_lists, summaries(_grid(some.column(4), int(d))))], schema=_VALUES)

    return keep(rows.mapInArrow(summarise, INDEX))


@dataclass
class Rows:
    """A tile's rows of one length, in the order of vec_id and num."""

    ids: np.ndarray
    nums: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    norms: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, d: int) -> Rows:
        rows = rows.sort_by([("vec_id", "ascending"), ("num", "ascending")])
        v, at, levels = _grid(rows["v"], d), 0, []
        ends = np.cumsum([-(-d // m) for m in SEGMENTS])
        means, deviations = _grid(rows["means"], int(ends[-1])), _grid(rows["deviations"], int(ends[-1]))
        for end in ends:
            levels.append((means[:, at:end], deviations[:, at:end]))
            at = end
        return cls(rows["vec_id"].to_numpy(), rows["num"].to_numpy(), rows["label"].to_numpy(), v, levels, np.sqrt(np.square(v.astype(float)).sum(1)))

    def scores(self, which: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return (self.v[which] * anchor).sum(1)  # in 64-bit integers, which hold every score

    def bounds(self, level: int, which: np.ndarray, anchor: Rows, a: int) -> tuple[np.ndarray, np.ndarray]:
        """From below and from above, of the scores with the anchor."""
        (means, deviations), (mean, deviation) = self.levels[level], anchor.levels[level]
        middle, reach = means[which] @ mean[a], deviations[which] @ deviation[a]
        slack = SLACK * self.norms[which] * anchor.norms[a] + 1
        return middle - reach - slack, middle + reach + slack

    def best(self, which: np.ndarray, anchor: Rows, a: int, k: int, windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most) of scores, the rows among which with the k highest scores in it, and these scores."""
        bars = [least for least, _ in windows]
        for level in range(len(SEGMENTS)):
            below, above = self.bounds(level, which, anchor, a)
            if len(which) > 8 * k:
                highest = which[np.argpartition(-above, 8 * k)[: 8 * k]]
                known = self.scores(highest, anchor.v[a])
                for n, (least, most) in enumerate(windows):
                    inside = known[(known >= least) & (known <= most)]
                    if len(inside) >= k:
                        bars[n] = max(bars[n], int(np.partition(inside, len(inside) - k)[len(inside) - k]))
            stay = np.zeros(len(which), bool)
            for bar, (_, most) in zip(bars, windows):
                stay |= (above >= bar) & (below <= most)
            which = which[stay]
        scores = self.scores(which, anchor.v[a])
        out = []
        for least, most in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            inside = inside[np.argsort(-scores[inside], kind="stable")[:k]]  # rows lie in the order of ties
            out.append((which[inside], scores[inside]))
        return out


FAR = 1 << 62


def _tiles(rows: DataFrame, anchors: DataFrame, key: list[str]):
    """Both sides dealt so that each anchor meets all rows of its key, grouped for cogroup."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held, asked = rows.groupBy(*key).agg(F.count("*").alias("n_rows")), anchors.groupBy(*key).agg(F.count("*").alias("n_anchors"))
    blocks = F.greatest(F.ceil(F.col("n_rows") / BLOCK), F.least(F.lit(cores), F.ceil(F.col("n_rows") / LEAST)))
    sizes = keep(held.join(asked, key).select(*key, blocks.cast("int").alias("blocks"), F.ceil(F.col("n_anchors") / CHUNK).cast("int").alias("chunks")))
    deal = lambda name, seed: F.pmod(F.xxhash64("num", F.lit(seed)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own beside the rows'
    left = rows.join(small(sizes), key).withColumn("block", deal("blocks", 1)).withColumn("chunk", every("chunks"))
    right = anchors.join(small(sizes), key).withColumn("chunk", deal("chunks", 2)).withColumn("block", every("blocks"))
    return left.drop("blocks", "chunks").groupBy(*key, "block", "chunk").cogroup(right.drop("blocks", "chunks").groupBy(*key, "block", "chunk"))


def positives(rows: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchor (its num), place (from 1), positive_id, positive_score: the k rows of the same label with the highest scores."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            d = right["d"][0].as_py()
            held, asked = Rows.of(left, d), Rows.of(right, d)
            for a in range(len(asked.ids)):
                others = np.flatnonzero(held.nums != asked.nums[a])
                which, scores = held.best(others, asked, a, k, [(-FAR, FAR)])[0]
                out += zip([int(asked.nums[a])] * len(which), held.ids[which].tolist(), held.nums[which].tolist(), scores.tolist())
        return pa.Table.from_arrays([pa.array(c, "int64") for c in zip(*out)] or [pa.array([], "int64")] * 4, names=["anchor", "positive_id", "other", "positive_score"])

    found = _tiles(rows, anchors, ["d", "label"]).applyInArrow(tile, "anchor long, positive_id long, other long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("anchor", "place", "positive_id", "positive_score")


def negatives(rows: DataFrame, asked: DataFrame, k: int = NEGATIVES, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the k best negatives of each anchor and positive.

    asked: the index's rows of anchors with positives, an array of (place, positive_id, positive_score).
    """

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            d = right["d"][0].as_py()
            held = Rows.of(left, d)
            right = right.sort_by([("vec_id", "ascending"), ("num", "ascending")])
            anchors, wanted = Rows.of(right, d), right["positives"].to_pylist()
            for a, own in enumerate(wanted):
                windows = [(-(-least * p["positive_score"] // 100), most * p["positive_score"] // 100) for p in own]
                for p, (which, scores) in zip(own, held.best(np.flatnonzero(held.labels != anchors.labels[a]), anchors, a, k, windows)):
                    n = len(which)
                    ids = [[int(x)] * n for x in (anchors.ids[a], anchors.nums[a], p["place"], p["positive_id"], p["positive_score"])]
                    out += zip(*ids, held.ids[which].tolist(), held.nums[which].tolist(), scores.tolist())
        names = ["anchor_id", "anchor", "place", "positive_id", "positive_score", "negative_id", "other", "negative_score"]
        return pa.Table.from_arrays([pa.array(c, "int64") for c in zip(*out)] or [pa.array([], "int64")] * 8, names=names)

    schema = "anchor_id long, anchor long, place long, positive_id long, positive_score long, negative_id long, other long, negative_score long"
    found = _tiles(rows, asked, ["d"]).applyInArrow(tile, schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The hard negatives of the rows of vectors(vec_id, embedding, label) whose vec_id is divisible by every.

    Only vectors of one length meet. Repeated rows each count; those that repeat a vec_id are told apart by their place
    in the table, also as an anchor's positives. An anchor without another row of its label, or whose positives have negative
    scores, has no row. No rows: none. Other columns are not read.
    """
    rows = index(vectors)
    anchors = rows.where(F.col("vec_id") % every == 0)
    found = keep(positives(rows, anchors))
    own = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))  # POSITIVES at most
    asked = keep(anchors.join(own, anchors["num"] == own["anchor"]).drop("anchor"))
    return negatives(rows, asked)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


SQL = {
    "op13_hard_negatives": """
with r as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join scored s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 5
"""
}
