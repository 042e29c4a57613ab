"""Spelling variant grouping (11) by asymmetric q-chunks.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The shorter of a pair (of
two as long, either) is cut into two disjoint chunks that cover it; the other contributes its positional grams of a
chunk's length. One edit leaves one of the chunks whole, moved by no more than the difference of the lengths, so that
words meet where a chunk equals a gram within shift one; grams elsewhere can't meet a chunk and are not made.

A key that more than PAIRS pairs share is not joined: its words go one level down with what is left of them beside
the chunk, which one edit apart is again cut into two chunks, under that key. At the last level all but one
or two code points are fixed, so no group grows with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points and occurrences that a word has at least; a form has so many times its variant's occurrences.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: Pairs under one key beyond which its words are told apart by more than that key.
PAIRS = 4096


def damaged(docs: DataFrame, modulus: int = 199) -> DataFrame:
    """word and n: the runs of letters in every whole text, A-Z in lower case, and how often each stands there.

    Where crc32 of `<doc_id>:<run>` is a multiple of modulus, the run loses the code point at that checksum modulo its
    length. A null text has no runs; a null doc_id reads as an empty one. Other columns are not read.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(LETTERS), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).select("id", run.alias("run"))
    rows = rows.where(F.char_length("run") >= LENGTH)  # none grows
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _chunks(level: DataFrame) -> DataFrame:
    """Two disjoint chunks of what is left of each word: key, word, n, and left without the chunk."""
    length, half = F.char_length("rest"), (F.char_length("rest") / 2).cast("int")
    # (which, where, how long)
    cuts = F.array(*[F.struct(F.lit(w).alias("w"), p.alias("p"), c.alias("c")) for w, p, c in ((0, F.lit(0), half), (1, half, length - half))])
    return _cut(level.withColumn("own", length).withColumn("cut", F.explode(cuts)))


def _grams(level: DataFrame) -> DataFrame:
    """Grams of what is left of each word that chunks of a word as long, or of one shorter by one, can meet."""
    length = F.char_length("rest")
    cuts = []
    for shorter in (0, 1):
        own, half = length - shorter, ((length - shorter) / 2).cast("int")
        for w, p, c in ((0, F.lit(0), half), (1, half, own - half)):
            cuts += [F.struct(own.alias("own"), F.lit(w).alias("w"), (p + shift).alias("p"), c.alias("c")) for shift in range(shorter + 1)]
    rows = level.withColumn("cut", F.explode(F.array(*cuts))).withColumn("own", F.col("cut.own"))
    return _cut(rows.where("own > 0 and cut.p + cut.c <= char_length(rest)"))


def _cut(rows: DataFrame) -> DataFrame:
    text, p, c = F.col("rest"), F.col("cut.p"), F.col("cut.c")
    key = F.xxhash64("key", "own", "cut.w", text.substr(p + 1, c))
    return rows.select(key.alias("key"), "word", "n", F.concat(text.substr(F.lit(1), p), text.substr(p + c + 1, F.char_length(text))).alias("rest"))


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of words(word, n) once."""
    left = right = words.select(F.lit(0).cast("long").alias("key"), "word", "n", F.col("word").alias("rest"))
    found = []
    while True:
        chunks, grams = keep(_chunks(left)), keep(_grams(right))
        sizes = chunks.groupBy("key").agg(F.count("*").alias("n_left")).join(grams.groupBy("key").agg(F.count("*").alias("n_right")), "key")
        crowd = keep(sizes.where(F.col("n_left") * F.col("n_right") > pairs).select("key"))
        if crowd.isEmpty():
            found.append(_verified(chunks, grams))
            return reduce(DataFrame.union, found).distinct()
        # Where a chunk leaves a code point or none, its group can't be told apart further and is no larger than letters allow.
        crowd, last = small(crowd), F.char_length("rest") <= 1
        left, done = chunks.where(~last).join(crowd, "key", "left_semi"), chunks.join(crowd, "key", "left_anti")
        right = grams.join(crowd, "key", "left_semi")
        found += [keep(_verified(done, grams)), keep(_verified(chunks.where(last).join(crowd, "key", "left_semi"), grams.where(F.char_length("rest") <= 2)))]


def _verified(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    a = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = grams.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, "key").where("char_length(a) < char_length(b) or (char_length(a) = char_length(b) and a < b)")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of words(word, n), whose words are distinct.

    form is the near word of largest n (ties: smallest), if that is ratio times the word's n or more; root is where
    forms lead. A word without near words has no form and is its own root. Forms grow by ratio, so they never turn in a circle.
    """
    pairs = keep(near_words(words))
    both = pairs.select(F.col("a").alias("of"), F.col("n_a").alias("own"), F.col("b").alias("other"), "n_b").union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("of", "own").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "other")).alias("best"))
    is_form = -F.col("best.m") >= F.col("own") * ratio
    best = keep(best.select("of", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")))
    roots = keep(best.where("form is not null").select("of", F.col("form").alias("root")))
    while True:  # forms double their reach each round
        on = roots.select(F.col("of").alias("at"), F.col("root").alias("further"))
        step = roots.join(on, roots["root"] == on["at"], "left").select("of", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = keep(step)
        roots = step.select("of", "root")
        if step.where("moved").isEmpty():
            break
    rows = words.join(best, words["word"] == best["of"], "left").drop("of").join(roots, words["word"] == roots["of"], "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    words = damaged(table(spark, sf_dir, "documents")).where((F.char_length("word") >= LENGTH) & (F.col("n") >= OCCURRENCES))
    return groups(keep(words))


#: Checksums of the runs by the table of CRC-32 (polynomial 0xEDB88320), byte by byte of their UTF-8.
_CRC = """
with recursive step(i, c, k) as (
    select range, range, 0 from range(256)
    union all select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from step where k < 8),
crcs as (select list(c order by i) as t from step where k = 8)
"""
_RUNS = """
, runs as (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) as run from documents),
counted as (select id, run, count(*) as k from runs where length(run) >= 6 group by 1, 2),
bytes as (
    select id, run, k, flatten(list_transform(string_split(id || ':' || run, ''),
        lambda ch: case when unicode(ch) < 128 then [unicode(ch)] else [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] end)) as b from counted),
sums as (
    select run, k, xor(list_reduce(list_transform(b, lambda x: x::bigint), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::bigint), 4294967295) as h from bytes, crcs),
words as (
    select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n from sums group by 1),
w as (select word, n, length(word) as len from words where length(word) >= 6 and n >= 5)
"""
#: Near words have the same text once a code point is taken out of the longer, or the same place out of both.
_NEAR = """
, cut as (select word, n, len, p, substr(word, 1, p - 1) || substr(word, p + 1) as v from w, lateral (select unnest(range(1, len + 1)) as p)),
pairs as (
    select a.word as a, a.n as n_a, b.word as b, b.n as n_b from cut a join cut b on a.v = b.v and a.p = b.p and a.word <> b.word
    union select a.word, a.n, w.word, w.n from cut a join w on a.v = w.word
    union select w.word, w.n, a.word, a.n from cut a join w on a.v = w.word),
best as (select a, count(*) as n_near, first(b order by n_b desc, b) as b, max(n_b) as m from pairs group by a),
forms as (
    select word, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then b end as form, case when m >= 5 * n then m end as form_n from w left join best on a = word),
walk(word, place, deep) as (
    select word, word, 0 from forms union all select walk.word, forms.form, deep + 1 from walk join forms on forms.word = walk.place where forms.form is not null)
select f.word, form, r.root, n, n_near, form_n from forms f join (select word, arg_max(place, deep) as root from walk group by 1) r on r.word = f.word
"""
SQL = {"op11_spelling_variants": _CRC + _RUNS + _NEAR}
