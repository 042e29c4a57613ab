"""Line dedup (2) by a segment-partition edit join, in DataFrame functions alone.

A line that lies within `edits` edits of an earlier one is dropped. Lines are cut into edits + 1 segments;
of two lines that close, the later holds one of the other's segments unchanged, shifted by few places
(pigeonhole). Every different line is indexed by its segments and probes, for each length that it can
match, the substrings at which such a segment may stand. Candidates are verified by banded bit-parallel
edit distance.

Where one segment is shared by very many lines (templates), pairs within the group are not made. With one
edit, all of two lines but the window that holds it is unchanged, so the lines of such groups are keyed
anew by all that lies outside each of a few windows; the windows of groups that are large even so are cut
again, down to single characters. Lines equal but for one place are then paired with the earliest of them
alone, and lines with one character taken out with the one line that they equal so: the pairs number no
more than the lines. They are verified as all others are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, keep, small, table

EDITS = 1
#: Shorter lines are only compared for equality: an edit would be over a tenth of them.
LEAST = 10
#: Lines that share a key, beyond which the group is keyed more finely; parts that a window is cut into then.
HOT, WINDOWS = 64, 32


def normalised(line: Column) -> Column:
    """Lower-cased, every run of [\\x20\\x09-\\x0D] one space, none at the ends."""
    low = F.lower(line)
    odd = reduce(lambda a, b: a | b, [line.contains(c) for c in SPACES[1:]])
    spaced = F.trim(F.when(odd, F.translate(low, SPACES, " " * len(SPACES))).otherwise(low))
    return F.when(spaced.contains("  "), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, number (from 0), the normalised line and its length n, of every line of every text, cut at line feeds."""
    rows = documents(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "raw")).select("doc_id", "number", normalised(F.col("raw")).alias("line"))
    return rows.withColumn("n", F.length("line"))


def let(value: Column, body) -> Column:
    """body(value), in which value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(pattern: Column, text: Column, edits: int) -> Column:
    """Whether two lines lie within so many edits, by a bit-parallel column of the band |i - j| <= edits.

    Bit b of the state of column j stands for row j - edits + b. First the band's matches with each of the
    text's characters are set as bits; then each step moves the vertical differences (up, down) down one row.
    """
    band = 2 * edits + 1
    full, top = (1 << band) - 1, 1 << (band - 1)
    n, m = F.length(pattern), F.length(text)
    flip = lambda x: x.bitwiseXOR(F.lit(full))
    some = lambda x: F.when(x != 0, 1).otherwise(0)

    def matches(p: Column, t: Column) -> Column:
        bit = lambda c, j, b: F.when(F.get(p, F.when(j + (b - edits) >= 0, j + (b - edits)).otherwise(F.lit(2**30))) == c, 1 << b).otherwise(0)
        return F.transform(t, lambda c, j: reduce(lambda x, y: x + y, [bit(c, j, b) for b in range(band)]))

    def step(state: Column, equal: Column, n: Column) -> Column:
        up, down, j = state["up"], state["down"], state["j"] + 1
        d = ((equal.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(equal).bitwiseOR(down).bitwiseAND(F.lit(full))

        def move(d: Column) -> Column:
            rise, fall, moved = down.bitwiseOR(flip(d.bitwiseOR(up))), d.bitwiseAND(up), F.shiftright(d, 1)
            # The cost on the band's lower edge follows the diagonal and, from the last row on, that row.
            bend = n + edits - j
            last = lambda x: F.call_function("shiftright", x, bend).bitwiseAND(F.lit(1))
            cost = state["cost"] + F.when(j + edits <= n, 1 - some(d.bitwiseAND(F.lit(top)))).otherwise(last(rise) - last(fall))
            return F.struct(fall.bitwiseOR(flip(moved.bitwiseOR(rise))).alias("up"), rise.bitwiseAND(moved).alias("down"), cost.alias("cost"), j.alias("j"))

        return let(d, move)

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("up"), F.lit(0).alias("down"), F.least(F.lit(edits), n).alias("cost"), F.lit(0).alias("j"))
    bits = let(F.split(pattern, ""), lambda p: matches(p, F.split(text, "")))
    cost = let(n, lambda k: F.aggregate(bits, start, lambda state, equal: step(state, equal, k))["cost"])
    return F.when(F.abs(n - m) > edits, F.lit(False)).when((n == 0) | (m == 0), F.greatest(n, m) <= edits).otherwise(cost <= edits)


def _start(length: Column, k: int, edits: int) -> Column:
    """Where segment k of a line of this length starts (from 1); segment edits + 1 is past its end."""
    return F.floor(length * k / (edits + 1)).cast("int") + 1


def segments(line: Column, n: Column, edits: int) -> Column:
    """Keys of the segments of a line of length n: hashes of length, segment number and segment."""
    return F.array(*[F.xxhash64(n, F.lit(k), F.substring(line, _start(n, k, edits), _start(n, k + 1, edits) - _start(n, k, edits))) for k in range(edits + 1)])


def probes(line: Column, n: Column, edits: int) -> Column:
    """Keys of the substrings that may be a segment of a line as long or shorter by up to edits.

    By the multi-match rule a match in segment k (from 0) has at most k edits before it and at most
    edits - k after it, so it starts within those of its own place, from either end.
    """
    keys = []
    for shorter in range(edits + 1):
        m = n - shorter
        for k in range(edits + 1):
            place, size = _start(m, k, edits), _start(m, k + 1, edits) - _start(m, k, edits)
            for shift in range(max(-k, shorter - (edits - k)), min(k, shorter + (edits - k)) + 1):
                at = place + shift
                keys.append(F.when((at >= 1) & (at + size - 1 <= n), F.xxhash64(m, F.lit(k), F.substring(line, at, size))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _last_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) within crowded groups of rows(id, shorter, s, e, line, place) whose window is one place at most."""
    line, n, s = F.col("line"), F.length("line"), F.col("s").cast("int")
    without = lambda p, mark="": F.md5(F.concat(F.substring(line, F.lit(1), p), F.lit(mark), F.substring(line, p + 2, n)))
    same = keep(rows.where("shorter = 0 and e > s").select(without(s, "\n").alias("key"), "id", "place"))
    least = keep(same.groupBy("key").agg(F.min(F.struct("place", "id"))["id"].alias("a")))
    changed = same.join(small(least), "key").where("a != id").select("a", F.col("id").alias("b"))
    whole = rows.where("shorter = 0").select(F.md5("line").alias("key"), F.col("id").alias("a")).distinct()
    cut = rows.where("shorter = 1").select(F.explode(F.transform(F.sequence(s, F.col("e").cast("int")), lambda p: without(p))).alias("key"), F.col("id").alias("b"))
    return changed.union(whole.join(cut, "key").select("a", "b"))


def _crowded_pairs(own: DataFrame, hot: int, count: int) -> DataFrame:
    """Pairs (a, b) of own(id, line, place), of which those within one edit are a part; of the lines of a group of more than hot no pairs are made.

    Rows stand for a line, as one of its own length (shorter 0) or as one with a character more than another
    (shorter 1), and a window from s to e of the other's places, outside which both are equal.
    """
    line, n = F.col("line"), F.length("line")
    wide = own.select("id", "line", F.explode(F.array(F.lit(0), F.lit(1))).alias("shorter")).select("*", F.lit(0).cast("long").alias("s"), (n - F.col("shorter")).cast("long").alias("e"))
    found = None
    while True:
        size, parts = F.col("e") - F.col("s"), F.least(F.col("e") - F.col("s"), F.lit(count).cast("long"))
        at = lambda q: F.col("s") + F.floor(size * q / parts)
        finer = wide.where("e > s").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("id", "line", "shorter", at(F.col("q")).alias("s"), at(F.col("q") + 1).alias("e"))
        outside = F.xxhash64(n - F.col("shorter"), "s", "e", F.substring(line, F.lit(1), F.col("s").cast("int")), F.substring(line, (F.col("e") + F.col("shorter") + 1).cast("int"), n))
        level = keep(finer.select("id", "shorter", "s", "e", outside.alias("key")))
        crowd = keep(level.where("shorter = 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        none = crowd.isEmpty()
        crowd = small(crowd)
        calm = level if none else level.join(crowd, "key", "left_anti")
        pairs = _meet(calm.where("shorter = 0").select("key", F.col("id").alias("a")), calm.select("key", F.col("id").alias("b")))
        found = pairs if found is None else found.union(pairs)
        if none:
            return found
        full = keep(level.join(crowd, "key", "left_semi").drop("key").join(own, "id"))
        found = found.union(_last_pairs(full.where("e - s <= 1")))
        wide = full.where("e - s > 1").drop("place")


def _meet(index: DataFrame, asks: DataFrame) -> DataFrame:
    """Different ids a, b of index(key, a) and asks(key, b) that share a key, the smaller as a."""
    return index.join(asks, "key").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_lines(lines: DataFrame, keys: DataFrame, edits: int = EDITS, hot: int = HOT) -> DataFrame:
    """Ids of those within edits of a line of an earlier place.

    keys(id, place, segments, probes) are of different lines; lines(id, line) gives the text of some ids.
    """
    index = keys.select(F.explode("segments").alias("key"), F.col("id").alias("a"))
    asks = keys.select(F.explode("probes").alias("key"), F.col("id").alias("b"))
    fine = None
    if edits == 1:
        crowd = keep(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        if not crowd.isEmpty():
            crowd = small(crowd)
            inside = keep(index.join(crowd, "key", "left_semi").select(F.col("a").alias("id")).union(asks.join(crowd, "key", "left_semi").select("b")).distinct())
            fine = _crowded_pairs(keep(lines(inside).join(keys.select("id", "place"), "id")), hot, WINDOWS)
            index = index.join(crowd, "key", "left_anti")
    pairs = _meet(index, asks)
    if fine is not None:
        pairs = pairs.union(fine.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = keep(pairs.distinct())
    text = keep(lines(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()).join(keys.select("id", "place"), "id"))
    side = lambda c: text.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"), F.col("place").alias(f"place_{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(within(F.col("line_a"), F.col("line_b"), edits))
    return close.select(F.when(F.col("place_a") < F.col("place_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def line_dedup(docs: DataFrame, edits: int = EDITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_lines, n_repeated, n_near and kept_lines (numbers of the lines that stay) of every document.

    Lines are cut at line feeds and compared normalised (lower-cased, white space runs one space). A line
    is repeated if an equal one stands before it, by doc_id and number, and near if its first copy lies within
    edits of a different line that stands before it; both are dropped. Empty lines never are, and those under
    LEAST characters only as repeated. A null text is one empty line. Documents that repeat a doc_id count as
    one, whose lines stand together.
    """
    lines = keep(lines_of(docs))
    places = lines.select("doc_id", "number", F.when(F.col("line") != "", F.md5("line")).alias("digest"), F.struct("doc_id", "number").alias("place"))
    long = F.col("n") >= max(LEAST, edits + 1)
    keyed = lines.where("line != ''").select(
        F.md5("line").alias("digest"), F.struct("doc_id", "number").alias("place"),
        F.when(long, segments(F.col("line"), F.col("n"), edits)).alias("segments"), F.when(long, probes(F.col("line"), F.col("n"), edits)).alias("probes"),
    )
    # The keys are the same for all copies of a line.
    firsts = keyed.groupBy("digest").agg(F.min("place").alias("place"), F.first("segments").alias("segments"), F.first("probes").alias("probes"))
    firsts = keep(firsts.withColumn("id", F.monotonically_increasing_id()))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = keep(ids.join(firsts.select("id", "digest", "place"), "id").select("id", "digest", F.col("place.doc_id").alias("d"), F.col("place.number").alias("k")))
        own = lines.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("number") == F.col("k")) & (F.md5("line") == F.col("digest")))
        return own.select("id", "line").dropDuplicates(["id"])

    near = near_lines(texts, firsts.where("segments is not null").select("id", "place", "segments", "probes"), edits, hot)
    fate = firsts.select("digest", "id", F.col("place").alias("first")).join(near.withColumn("is_near", F.lit(True)), "id", "left").drop("id")
    told = places.join(fate, "digest", "left")
    repeated = F.coalesce(F.col("place") != F.col("first"), F.lit(False))
    told = told.select("doc_id", "number", repeated.alias("repeated"), (F.coalesce("is_near", F.lit(False)) & ~repeated).alias("near"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("repeated") & ~F.col("near"), F.col("number"))))
    return told.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("repeated").alias("n_repeated"), F.count_if("near").alias("n_near"), kept.alias("kept_lines"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
