"""N-gram Jaccard join (3): documents whose sets of word 5-grams overlap by 0.8 of their union.

Equal sets become one node first. Of each node only the rarest shingles are looked at, as many as two
linked sets must share one of (prefix filtering). To order by rarity without counting every shingle,
the order begins with those whose hash lies below a fixed quantile, by their number of nodes, and
goes on by hash; a prefix nearly always ends within the first part, so only that part is shuffled.

Nodes that share a shingle of their prefixes are candidates: every such shingle makes a star of its nodes
around the smallest of them, and stars that share nodes a family. A family whose stars overlap much is
compared as a whole, so that each pair is met once, another one star by star. Either is cut into size
bands, a band into blocks of bounded rows and bytes, and blocks of the same or of neighbouring bands
meet in tiles; small families share a tile. In a tile, hashed bitmap signatures bound the overlap of all
pairs from above by their bit counts; of those that pass, pairs not yet connected are verified by the exact
intersection of their sorted arrays, likely ones first, so a tile yields a spanning forest of its links and
not all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, documents, keep, numbered, remembered, small, table, without_rows

WORDS, PERCENT = 5, 80
#: Part of all hashes that comes first in the order, by rarity.
FIRST = 0.3
#: Nodes and shingles of a block at most (a tile is two blocks); a family with so few of both shares a tile.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
LIGHT, LIGHT_SHINGLES = 64, 500_000
#: One node in so many is looked at to find keys of about HOT rows, which are aggregated apart.
SAMPLED, HOT = 16, 512

#: Words whose hashes a worker keeps; beyond it the memory starts anew.
MEMORY = 200_000


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different word n-grams (the whole sequence, if shorter)."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], np.uint64)
    known = remembered("shingles", Hashes)
    if len(known) > MEMORY:
        known.clear()
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def least_overlap(n):
    """What a set of n must share at least with any that it links to."""
    return -(-n * PERCENT // 100)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of size bits, a power of two."""
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _sets(docs: DataFrame, more: list[str] = ()) -> DataFrame:
    """doc_id, n, digest of the set, the prefix to look at (signed hashes), how many of it lie in the first part, and more columns (longs)."""
    limit = np.uint64(int(FIRST * 2**64))

    def run(batches):
        for batch in batches:
            n, digest, keys, first = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                prefix, inside = len(own) - least_overlap(len(own)) + 1, int(np.searchsorted(own, limit))
                n.append(len(own))
                digest.append(xxhash.xxh128_digest(own.tobytes()))
                first.append(inside)
                keys.append(own[: max(prefix, inside)].view(np.int64) if len(own) else own.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, "int64"), pa.array(digest, "binary"), pa.array(first, "int64"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), *batch.columns[2:]],
                names=["doc_id", "n", "digest", "first", "keys", *more],
            )

    return docs.mapInArrow(run, ", ".join(["doc_id long, n long, digest binary, first long, keys array<long>", *(f"{m} long" for m in more)]))


def _arrays(docs: DataFrame) -> DataFrame:
    """doc_id, digest and the sorted shingles."""

    def run(batches):
        for batch in batches:
            own = [shingles(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh128_digest(k.tobytes()) for k in own], "binary"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64)))],
                names=["doc_id", "digest", "shingles"],
            )

    return docs.mapInArrow(run, "doc_id long, digest binary, shingles array<long>")


def per_key(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """The (kept) rows(key, node, ...) with aggregates over all rows of their key.

    A key of very many rows is never collected in one task: such keys are found among one node in SAMPLED, aggregated
    where their rows lie, and their exact results joined back. Which way a key goes doesn't change its result.
    """
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)
    hot = keep(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT // SAMPLED).select(F.col("key").alias("__key")))
    here = F.col("key") == F.col("__key")
    # Rows of other keys make one group of their own, a row a task before the shuffle.
    told = keep(rows.join(small(hot), here, "left").groupBy("__key").agg(F.count("*").alias("__n"), *(agg.alias(f"__{name}") for name, agg in aggregates.items())))
    told = told.where("__key is not null")
    # A hot key's rows are dealt to groups of about HOT, which take the result as it is.
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("__n") / HOT)), F.lit(0))
    own = Window.partitionBy("key", "__part")
    beside = rows.join(small(told), here, "left").withColumn("__part", part)
    return beside.select(*rows.columns, *(F.coalesce(f"__{name}", agg.over(own)).alias(name) for name, agg in aggregates.items()))


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(key, node, n) of the shingles in nodes' prefixes that more than one node looks at."""
    rows = nodes.select("node", "n", "first", F.explode("keys").alias("key"))
    shared = per_key(rows, df=F.count("*")).where("df > 1")
    own = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("long") + 1
    # Shingles that no other node has come first in the order; they use up part of the prefix.
    left = F.when(F.col("first") < prefix, F.size("keys")).otherwise(prefix - (F.col("first") - F.size("keys")))
    return own.withColumn("left", left).where("left > 0").select("node", "n", F.explode(F.slice("keys", 1, F.col("left").cast("int"))["key"]).alias("key"))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays without repeats overlap by PERCENT of their union."""
    if len(x) < len(y):
        x, y = y, x
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def tile_links(node: np.ndarray, side: np.ndarray, arrays: list[np.ndarray]) -> tuple[list, list, int, int]:
    """Edges a, b that connect what is linked across the two sides of a tile, or within its one side.

    Also how many pairs of fitting sizes met, and how many of them the bitmaps' bound cut.
    """
    n = np.array([len(x) for x in arrays])
    order = np.lexsort((node, n))
    node, side, n, arrays = node[order], side[order], n[order], [arrays[k] for k in order]
    # One size for the tile: about eight bits a shingle of its larger sets.
    size = max(64, 1 << int(8 * int(np.quantile(n, 0.9)) - 1).bit_length())
    bits = np.array([signature(x, size) for x in arrays]).view(np.uint64)
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    one_side = bool((side == side[0]).all())
    root = np.arange(len(node))
    a, b, met, cut = [], [], 0, 0
    for i in range(len(node) - 1):
        # Sizes are in order, so those that can link with i end where theirs gets too large.
        after = int(np.searchsorted(n, n[i] * 100 // PERCENT, "right"))
        others = np.arange(i + 1, after)
        others = others[(root[others] != root[i]) & (one_side | (side[others] != side[i]))]
        if not len(others):
            continue
        both = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
        most = np.minimum(n[i] - ones[i] + both, n[others] - ones[others] + both)
        union = n[i] + n[others] - most
        fits = 100 * most >= PERCENT * union
        met, cut = met + len(others), cut + len(others) - int(fits.sum())
        for j in others[fits][np.argsort(-(most[fits] / union[fits]), kind="stable")]:
            if root[j] != root[i] and linked(arrays[i], arrays[j]):
                a.append(int(node[i]))
                b.append(int(node[j]))
                root[root == root[j]] = root[i]
    return a, b, met, cut


def _tile(rows: pa.Table) -> pa.Table:
    """Edges (a, b) of a tile: of two blocks, or of the families that share it, each for itself."""
    family, part, node, side = (rows[c].to_numpy() for c in ("family", "part", "node", "side"))
    flat = rows["shingles"].combine_chunks()
    values, ends = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
    order = np.lexsort((part, family))
    new = np.flatnonzero((np.diff(family[order]) != 0) | (np.diff(part[order]) != 0)) + 1
    a, b = [], []
    for own in np.split(order, new):
        if len(own) > 1:
            x, y, _, _ = tile_links(node[own], side[own], [values[ends[k] : ends[k + 1]] for k in own])
            a += x
            b += y
    return pa.table({"a": pa.array(a, "int64"), "b": pa.array(b, "int64")})


def _families(rows: DataFrame) -> DataFrame:
    """(family, part, node, n) of rows(node, n, centre): part is -1 where the family is compared as a whole, else the star."""
    stars = keep(rows.select("node", "n", "centre").distinct())
    found = keep(components(stars.select(F.col("node").alias("a"), F.col("centre").alias("b"))).select(F.col("node").alias("__n"), F.col("component").alias("family")))
    # Pairs of the whole family against those of its stars.
    star = stars.groupBy(F.col("centre").alias("__n")).agg(F.count("*").alias("c")).join(small(found), "__n")
    pairs = star.groupBy(F.col("family").alias("__f")).agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    whole = found.groupBy(F.col("family").alias("__f")).agg(F.count("*").alias("v")).join(pairs, "__f").select("__f", (F.col("v") * F.col("v") <= F.col("pairs")).alias("whole"))
    placed = stars.join(small(found), F.col("node") == F.col("__n")).join(small(keep(whole)), F.col("family") == F.col("__f"))
    return placed.select("family", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("centre")).alias("part"), "node", "n").distinct()


def _tiles(members: DataFrame) -> DataFrame:
    """The (kept) members(family, part, node, n) with the tile (f, p, b1, s1, b2, s2) and the side of it at which they stand."""
    group, tile = ["family", "part"], ["f", "p", "b1", "s1", "b2", "s2"]
    sizes = keep(members.groupBy(*group).agg(F.count("*").alias("v"), F.sum("n").alias("shingles")).where("v > 1").withColumn("light", (F.col("v") <= LIGHT) & (F.col("shingles") <= LIGHT_SHINGLES)))
    bins = max(1, -(-(sizes.where("light").agg(F.sum("shingles")).first()[0] or 0) // BLOCK_SHINGLES))
    sized = members.join(small(sizes.select(F.col("family").alias("__f"), F.col("part").alias("__p"), "light")), (F.col("family") == F.col("__f")) & (F.col("part") == F.col("__p"))).drop("__f", "__p")
    zero = F.lit(0)
    shared = sized.where("light").select(*group, "node", zero.alias("side"), F.pmod(F.xxhash64(*group), F.lit(bins)).alias("f"), F.lit(-2).cast("long").alias("p"), *(zero.alias(c) for c in tile[2:]))
    # Two sets link only if neither is larger than 1.25 times the other: they lie in one band or in two that meet.
    banded = keep(sized.where("not light").withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT + 1e-6))).cast("int")).drop("light"))
    cuts = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int")
    bands = keep(banded.groupBy(*group, "band").agg(F.count("*").alias("c"), F.sum("n").alias("m")).select(F.col("family").alias("f"), F.col("part").alias("p"), F.col("band").alias("b"), cuts.alias("cuts")))
    of_band = (F.col("family") == F.col("f")) & (F.col("part") == F.col("p")) & (F.col("band") == F.col("b"))
    blocked = banded.join(small(bands), of_band).select(*group, "band", "node", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("block"))
    block = F.explode(F.sequence(zero, F.col("cuts") - 1))
    first = bands.select("f", "p", F.col("b").alias("b1"), block.alias("s1"))
    second = lambda up: bands.select(F.col("f").alias("f2"), F.col("p").alias("p2"), (F.col("b") - up).alias("at"), F.col("b").alias("b2"), block.alias("s2"))
    beside = lambda up, fits: first.join(second(up), (F.col("f") == F.col("f2")) & (F.col("p") == F.col("p2")) & (F.col("b1") == F.col("at")) & fits).select(*tile)
    pairs = keep(beside(0, F.col("s1") <= F.col("s2")).union(beside(1, F.lit(True))))
    same = (F.col("b1") == F.col("b2")) & (F.col("s1") == F.col("s2"))
    ends = pairs.select(*tile, F.col("b1").alias("b"), F.col("s1").alias("s"), zero.alias("side")).union(pairs.where(~same).select(*tile, "b2", "s2", F.lit(1)))
    met = blocked.join(ends, (F.col("family") == F.col("f")) & (F.col("part") == F.col("p")) & (F.col("band") == F.col("b")) & (F.col("block") == F.col("s")))
    return shared.select(*group, "node", "side", *tile).union(met.select(*group, "node", "side", *tile))


def _links(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified edges (a, b) that connect all nodes that are linked."""
    of_tile = tiles.join(sets, "node").select("family", "part", "node", "side", "shingles", "f", "p", "b1", "s1", "b2", "s2")
    return of_tile.groupBy("f", "p", "b1", "s1", "b2", "s2").applyInArrow(_tile, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A null, empty or wordless text has no shingles and is
    its own component. Equal sets are linked, so repeated rows share a component; with equal doc_ids the smallest is theirs.
    An empty table gives an empty result; other columns are not read.
    """
    return _told(docs)


def _told(docs: DataFrame, number: str | None = None) -> DataFrame:
    """What jaccard_components gives; with number, a column that tells rows apart, also that and whether the row stays."""
    more = [number] if number else []
    rows = documents(docs, *more)
    docs = documents(docs)
    sets = keep(_sets(rows, more).withColumn("row", F.monotonically_increasing_id()))
    heads = keep(sets.where("n > 0").groupBy("digest").agg(F.min("row").alias("node")))
    nodes = sets.join(small(heads.select("node")), F.col("row") == F.col("node"))
    prefixes = keep(_prefixes(keep(nodes.select("node", "n", "first", "keys"))))
    stars = keep(per_key(prefixes, df=F.count("*"), centre=F.min("node")).where("df > 1").select("node", "n", "centre").distinct())
    wanted = keep(stars.select("node").distinct().join(nodes.select("node", "doc_id", "digest"), "node"))
    ids = small(wanted.select(F.col("node").alias("node"), F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest")))
    some = docs.join(small(keep(wanted.select(F.col("doc_id").alias("__doc")).distinct()), 64 << 20), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    arrays = _arrays(some).join(ids, (F.col("doc_id").eqNullSafe(F.col("__doc"))) & (F.col("digest") == F.col("__digest")))
    arrays = keep(arrays.select("node", "shingles").dropDuplicates(["node"]))
    edges = keep(_links(_tiles(keep(_families(stars))), arrays))
    labels = keep(components(edges))
    of_row = sets.select("row", "doc_id", "n", "digest", *more).join(heads, "digest", "left").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node", "row"))
    of_row = keep(of_row.select("doc_id", "n", "c", *more))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *more)  # ids first, the smallest before all
    least = of_row.groupBy("c").agg(F.min(first).alias("first"))
    stays = [F.col(number), (F.col(number) == F.col(f"first.{number}")).alias("stays")] if number else []
    return of_row.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), *stays)


def one_of_each(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest id; ids may be null or clash. stored: see numbered()."""
    rows, number = numbered(docs, stored)
    return without_rows(rows, number, _told(rows, number).where("not stays").select(F.col(number).alias("gone")))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
