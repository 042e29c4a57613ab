"""LM scoring (8) with a sharded Elias-Fano n-gram trie of order three.

The model interpolates trigrams with bigrams, and these with an add-one unigram, by absolute discounting:

    p(w | h) = max(c(h, w) - d, 0) / c(h) + d * t(h) / c(h) * p(w | h without its first word)
    p(w) = (c(w) + 1) / (N + V + 1)

where h is a context of two words or one, c(h) the number of tokens that follow it in training and t(h) that of different
ones. A context without followers gives the shorter one's probability; the first token of a text has one word before it, its start.

Texts are cut into batches whose tokens are numbered from 0 and kept. Words are dealt to shards by their hash. A batch
sends each shard that holds some of its words these, their successors, what follows these in turn, and its training
counts, each different n-gram once; the shard adds the counts up, builds a trie of them, and answers every batch by
looking up what it asked for: counts of words, and 8-bit codes of the two factors above. Nothing grows on the driver,
and a frequent word costs a shard one list per batch.

A trie has three levels, all Elias-Fano coded in memory maps and searched as they are: sorted 64-bit hashes of words, and
twice 32-bit fingerprints of successors, which the place of their context in the level above makes one monotone
sequence, so that pointers and successors are found by a successor search relative to the context. The maps are
anonymous: a file on the machine would be lost with it, and no later task reads them.

Fingerprints err so: of t different successors of a context, an unseen word is taken for one with a chance of t / 2 ** 32,
and seen ones merge in t * t / 2 ** 33 pairs (for a context of 100,000 successors 1 word in 43,000, and about one pair).
"""

from __future__ import annotations

import json
import mmap

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep, remainder, table

DISCOUNT = 0.75
#: Characters of the texts of one batch; tokens of the corpus for each shard.
BATCH_CHARS, SHARD_TOKENS = 8_000_000, 2_000_000
#: Steps of the 8-bit codes in a factor of two.
STEPS = 8.0
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # stand for the start and the end of a text


def shrink(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def grow(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


class Index(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


#: Bytes of a block of the unary code whose zeros are counted ahead; look-ups made at a time.
BLOCK, LOOK_UPS = 16, 1 << 14
#: Place of the k-th zero (column) of a byte (row), from its highest bit.
ZERO = np.argsort(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, kind="stable")


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bytes in a row, high parts in unary.

    Both stay packed: a look-up selects in the unary code, by a count of zeros for every BLOCK bytes, and
    searches among the low bytes in place.
    """

    def __init__(self, values: np.ndarray):
        n, top = len(values), int(values[-1]) if len(values) else 0
        spare = max(0, top.bit_length() - max(1, n).bit_length() + 2)
        self.n, self.low_bytes = n, min(7, -(-spare // 8))
        high = (values >> np.uint64(8 * self.low_bytes)).astype(np.int64)
        self.buckets = (int(high[-1]) if n else 0) + 1
        bits = np.zeros(-(-(self.buckets + n) // (8 * BLOCK)) * 8 * BLOCK, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits)
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : self.low_bytes] if n else np.zeros((0, 0), np.uint8)
        self.low_at = packed.nbytes
        self.memory = mmap.mmap(-1, packed.nbytes + low.nbytes + 8)  # the last low part is read as 8 bytes, too
        self.memory[: self.low_at] = packed.tobytes()
        self.memory[self.low_at : self.low_at + low.nbytes] = low.tobytes()
        zeros = 8 * BLOCK - np.bitwise_count(packed.reshape(-1, BLOCK)).sum(1, dtype=np.int64)
        self.ahead = np.cumsum(zeros) - zeros

    def first_of(self, bucket: np.ndarray) -> np.ndarray:
        """How many elements lie in buckets before these: the ones before the zero that ends the one before."""
        blocks = np.frombuffer(self.memory, np.uint8, self.low_at).reshape(-1, BLOCK)
        out = np.zeros(len(bucket), np.int64)
        for at in range(0, len(bucket), LOOK_UPS):
            zero = bucket[at : at + LOOK_UPS] - 1
            own = np.maximum(np.searchsorted(self.ahead, zero, "right") - 1, 0)
            held = blocks[own]
            upto = np.cumsum(np.bitwise_count(~held), axis=1, dtype=np.int16)
            rest = zero - self.ahead[own]
            byte = np.minimum((upto <= rest[:, None]).sum(1), BLOCK - 1)
            row = np.arange(len(zero))
            rest = rest - np.where(byte > 0, upto[row, byte - 1], 0)
            place = (own * BLOCK + byte) * 8 + ZERO[held[row, byte], np.clip(rest, 0, 7)]
            out[at : at + LOOK_UPS] = np.where(zero >= 0, place - zero, 0)
        return out

    def low(self, place: np.ndarray) -> np.ndarray:
        """Low parts of the elements at these places."""
        if not self.low_bytes:
            return np.zeros(len(place), np.uint64)
        return np.ndarray((self.n,), "<u8", self.memory, self.low_at, (self.low_bytes,))[place] & np.uint64((1 << 8 * self.low_bytes) - 1)

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each number, the place of the first element not below it, and whether that is the number itself."""
        if not self.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        shift = np.uint64(8 * self.low_bytes)
        high = wanted >> shift
        rest = wanted - (high << shift)
        past = high >= np.uint64(self.buckets)
        bucket = np.minimum(high, np.uint64(self.buckets - 1)).astype(np.int64)
        after = self.first_of(bucket + 1)
        first = np.where(past, self.n, self.first_of(bucket))
        end = after.copy()
        while len(open_ := np.flatnonzero(first < after)):
            middle = (first[open_] + after[open_]) >> 1
            less = self.low(middle) < rest[open_]
            first[open_[less]] = middle[less] + 1
            after[open_[~less]] = middle[~less]
        hit = first < end
        hit[hit] = self.low(first[hit]) == rest[hit]
        return first, hit


class Level:
    """Successors by the place of their context (sorted), and quantised factors of both."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: int):
        """keys: the context's place and the fingerprint, sorted; counts of them; how many contexts there are."""
        own = (keys >> np.uint64(32)).astype(np.int64)
        self.keys = EliasFano(keys)
        followed, kinds = np.bincount(own, weights=counts, minlength=contexts), np.bincount(own, minlength=contexts)
        self.shares = quantise(np.maximum(counts - DISCOUNT, 0) / np.maximum(followed[own], 1))
        self.backoffs = np.where(followed > 0, quantise(DISCOUNT * kinds / np.maximum(followed, 1)), 0).astype(np.uint8)

    def look_up(self, known: np.ndarray, place: np.ndarray, owners: np.ndarray, successors: np.ndarray):
        """Back-off codes of contexts; share codes of the successors of contexts[owners], and where these are in the level."""
        backoffs, shares = np.zeros(len(place), np.uint8), np.zeros(len(owners), np.uint8)
        found, hit = np.zeros(len(owners), np.int64), np.zeros(len(owners), bool)
        backoffs[known] = self.backoffs[place[known]]
        if self.keys.n:
            asked = np.flatnonzero(known[owners])
            found[asked], hit[asked] = self.keys.successor(place[owners[asked]].astype(np.uint64) << np.uint64(32) | successors[asked].astype(np.uint64))
            shares[hit] = self.shares[found[hit]]
        return backoffs, shares, hit, found


class Trie:
    """Words (sorted hashes) with counts, their successors, and the successors of these."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray):
        self.words, self.counts = EliasFano(words), counts
        self.pairs, self.triples = Level(pairs, pair_counts, len(words)), Level(triples, triple_counts, len(pairs))

    def look_up(self, words: np.ndarray, owners: np.ndarray, successors: np.ndarray, pair_owners: np.ndarray, thirds: np.ndarray):
        """Counts and back-off codes of words, share and back-off codes of the pairs words[owners], successors, share codes of what follows pairs[pair_owners]."""
        place, known = self.words.successor(words)
        counts = np.zeros(len(words), np.int64)
        counts[known] = self.counts[place[known]]
        backoffs, shares, hit, found = self.pairs.look_up(known, place, owners, successors)
        pair_backoffs, pair_shares, _, _ = self.triples.look_up(hit, found, pair_owners, thirds)
        return counts, backoffs, shares, pair_backoffs, pair_shares


def quantise(x: np.ndarray) -> np.ndarray:
    """8-bit codes of numbers of 0 to 1; 0: none."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.clip(np.round(-np.log2(x) * STEPS) + 1, 1, 255), 0).astype(np.uint8)


def factors(unseen: float) -> np.ndarray:
    return np.concatenate([[unseen], 2.0 ** (-np.arange(255) / STEPS)])


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def batch_pairs(vocabulary: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, trained: np.ndarray):
    """Of a batch: the number of each token and of the one before it, and whether its text is trained on.

    tokens hold no starts; numbers are places in vocabulary, whose first two are start and end.
    """
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = 0
    return before, np.repeat(trained, sizes)


def tokenise(docs: DataFrame) -> DataFrame:
    """Batches of docs(doc_id, text, trained): their words' hashes and their tokens by number."""

    def pack(seq, ids, sizes, trained, tokens, index):
        words = list(index)[2:]
        hashes = np.concatenate([[START, END], np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))])
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() << 24 | seq], "int64")]
            + [pa.array([zstandard.compress(json.dumps(ids).encode())], "binary")]
            + [pa.array([shrink(x)], "binary") for x in (np.array(sizes, "<i4"), np.array(trained, "?"), hashes.astype("<u8"), np.concatenate(tokens).astype("<i4"))]
            + [pa.array([sum(sizes)], "int64")],
            names=["batch", "ids", "sizes", "trained", "hashes", "tokens", "n"],
        )

    def run(batches):
        seq, size, held = 0, 0, ([], [], [], [])
        fresh = lambda: Index({None: 0, True: 1})  # noqa: E731  start and end
        index = fresh()
        for batch in batches:
            for doc, text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().lower().split()
                tokens = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                for part, x in zip(held, (doc, len(words) + 1, train, np.append(tokens, np.int32(1)))):
                    part.append(x)
                size += len(text) + 1
                if size >= BATCH_CHARS:
                    yield pack(seq, *held, index)
                    seq, size, held, index = seq + 1, 0, ([], [], [], []), fresh()
        if held[0]:
            yield pack(seq, *held, index)

    return docs.mapInArrow(run, "batch long, ids binary, sizes binary, trained binary, hashes binary, tokens binary, n long")


class Lists:
    """A batch's words by hash, their training counts, and its different bigrams and trigrams."""

    def __init__(self, row: dict):
        hashes, self.tokens, self.sizes, trained = grow(row["hashes"], "<u8"), grow(row["tokens"], "<i4"), grow(row["sizes"], "<i4"), grow(row["trained"], "?")
        before, train = batch_pairs(hashes, self.sizes, self.tokens, trained)
        n, order = len(hashes), np.argsort(hashes, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.words = hashes[order]
        self.counts = np.bincount(self.tokens[train], minlength=n)[order]
        by_print = np.argsort(fingerprints(hashes), kind="stable")
        print_rank = np.empty(n, np.int64)
        print_rank[by_print] = np.arange(n)
        prints = fingerprints(hashes)[by_print]

        def different(contexts, followers, weights):
            """Of n-grams by context and fingerprint: the context, the fingerprint, the training count; and which each token is."""
            grams, inverse = np.unique(contexts * n + print_rank[followers], return_inverse=True)
            return grams // n, prints[grams % n], np.bincount(inverse, weights=weights, minlength=len(grams)).astype(np.int64), inverse

        self.owner, self.second, self.pair_counts, self.pair = different(self.rank[before], self.tokens, train)
        later = np.ones(len(self.tokens), bool)
        later[np.cumsum(self.sizes) - self.sizes] = False
        self.later = np.flatnonzero(later)  # tokens after two words
        self.pair_owner, self.third, self.triple_counts, self.triple = different(self.pair[self.later - 1], self.tokens[self.later], train[self.later])

    def by_shard(self, shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of words, bigrams and trigrams: their order by shard, and where each shard begins in it."""
        shard = (self.words % np.uint64(shards)).astype(np.int64)
        kinds = (shard, shard[self.owner], shard[self.owner][self.pair_owner])
        orders = [np.argsort(x, kind="stable") for x in kinds]
        return [(o, np.searchsorted(x[o], np.arange(shards + 1))) for x, o in zip(kinds, orders)]


#: What a batch asks of a shard, and what it is answered.
ASKED = {"words": "<u8", "counts": "<u4", "lengths": "<u4", "successors": "<u4", "pair_counts": "<u4", "pair_lengths": "<u4", "thirds": "<u4", "triple_counts": "<u4"}
ANSWERED = {"counts": "<i8", "backoffs": "u1", "shares": "u1", "pair_backoffs": "u1", "pair_shares": "u1"}


def asked(batches: DataFrame, shards: int) -> DataFrame:
    """What each batch asks of each shard that holds words of it: (shard, batch) and the columns of ASKED."""

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                own = Lists(row)
                (words, word_at), (pairs, pair_at), (triples, triple_at) = own.by_shard(shards)
                lengths, pair_lengths = np.bincount(own.owner, minlength=len(own.words)), np.bincount(own.pair_owner, minlength=len(own.owner))
                there, rows = np.flatnonzero(np.diff(word_at)), []
                for s in there:
                    w, p, t = words[word_at[s] : word_at[s + 1]], pairs[pair_at[s] : pair_at[s + 1]], triples[triple_at[s] : triple_at[s + 1]]
                    lists = (own.words[w], own.counts[w], lengths[w], own.second[p], own.pair_counts[p], pair_lengths[p], own.third[t], own.triple_counts[t])
                    rows.append([shrink(x.astype(kind)) for x, kind in zip(lists, ASKED.values())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there, "int32"), pa.array(np.full(len(there), row["batch"]), "int64"), *(pa.array(list(c), "binary") for c in zip(*rows))], names=["shard", "batch", *ASKED]
                )

    return batches.mapInArrow(run, ", ".join(["shard int, batch long", *(f"{c} binary" for c in ASKED)]))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys that have counts, sorted, and the sums of these."""
    seen = np.flatnonzero(counts)
    seen = seen[np.argsort(keys[seen], kind="stable")]
    keys, counts = keys[seen], counts[seen]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def answer(table: pa.Table) -> pa.Table:
    """One shard: build its trie from all batches, then answer each."""
    rows = table.sort_by("batch").to_pylist()
    lists = [[grow(r[c], kind) for c, kind in ASKED.items()] for r in rows]
    every = lambda k: np.concatenate([x[k] for x in lists])
    place_of = lambda places, lengths: np.repeat(places, lengths).astype(np.uint64) << np.uint64(32)
    words, place = np.unique(every(0), return_inverse=True)
    counts = np.bincount(place, weights=every(1), minlength=len(words)).astype(np.int64)
    asked_pairs = place_of(place, every(2)) | every(3).astype(np.uint64)
    pairs, pair_counts = added(asked_pairs, every(4).astype(np.int64))
    # A trigram that was trained on follows a bigram that was.
    triples, triple_counts = added(place_of(np.searchsorted(pairs, asked_pairs), every(5)) | every(6).astype(np.uint64), every(7).astype(np.int64))
    del asked_pairs
    # Only what was trained on is in the trie: words that were counted, and contexts (the start has no count).
    contexts = (pairs >> np.uint64(32)).astype(np.int64)
    there = counts > 0
    there[contexts] = True
    renumbered = (np.cumsum(there) - 1)[contexts].astype(np.uint64) << np.uint64(32)
    trie = Trie(words[there], counts[there], renumbered | (pairs & np.uint64(0xFFFFFFFF)), pair_counts, triples, triple_counts)
    total, kinds = int(counts.sum()), int((counts > 0).sum())
    told = []
    for x in lists:
        found = trie.look_up(x[0], np.repeat(np.arange(len(x[0])), x[2]), x[3], np.repeat(np.arange(len(x[3])), x[5]), x[6])
        told.append([shrink(y.astype(kind)) for y, kind in zip(found, ANSWERED.values())])
    n = len(rows)
    return pa.table(
        {
            "batch": pa.array([r["batch"] for r in rows], "int64"), "shard": pa.array([r["shard"] for r in rows], "int32"),
            **{c: pa.array(list(x), "binary") for c, x in zip(ANSWERED, zip(*told))},
            "total": pa.array([total] + [0] * (n - 1), "int64"), "kinds": pa.array([kinds] + [0] * (n - 1), "int64"),
        }
    )


def score(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score and score of docs(doc_id, text, trained), whose other columns are not read.

    Words are runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased, and one end per text; a null or
    empty text is its end alone. With nothing trained on, every count is 0 and scores come from the unseen
    share alone. Repeated rows are each counted and scored; a null in trained counts as false. There is a shard for
    every SHARD_TOKENS tokens unless shards says how many.
    """
    docs = documents(docs, F.coalesce(F.col("trained"), F.lit(False)).alias("trained"))
    batches = keep(tokenise(docs))
    shards = shards or max(1, -(-(batches.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))
    answers = keep(asked(batches, shards).groupBy("shard").applyInArrow(answer, ", ".join(["batch long, shard int", *(f"{c} binary" for c in ANSWERED), "total long, kinds long"])))
    sums = answers.agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = int(sums[0] or 0), int(sums[1] or 0)

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Lists(row)
        sizes, tokens = own.sizes, own.tokens
        words, pairs, triples = (order for order, _ in own.by_shard(shards))
        got = right.sort_by("shard").to_pylist()
        put = lambda name, places: _scatter([grow(r[name], ANSWERED[name]) for r in got], places)
        by_number = put("counts", words)[own.rank]
        chance = (by_number + 1) / (total + kinds + 1)
        known = (by_number > 0)[tokens]
        p = factors(0.0)[put("shares", pairs)][own.pair] + factors(1.0)[put("backoffs", words)][own.owner][own.pair] * chance[tokens]
        p[own.later] = factors(0.0)[put("pair_shares", triples)][own.triple] + factors(1.0)[put("pair_backoffs", pairs)][own.pair[own.later - 1]] * p[own.later]
        starts = np.cumsum(sizes) - sizes
        return pa.table(
            {
                "doc_id": pa.array(json.loads(zstandard.decompress(row["ids"])), "int64"), "trained": pa.array(grow(row["trained"], "?")),
                "n_tokens": pa.array(sizes, "int64"), "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts), "int64"),
                "train_tokens": pa.array(np.full(len(sizes), total), "int64"),
                "base_score": pa.array(np.add.reduceat(np.log10(chance)[tokens], starts), "float64"),
                "score": pa.array(np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts), "float64"),
            }
        )

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(judge, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scatter(parts: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    flat = np.concatenate(parts)
    out = np.empty(len(places), flat.dtype)
    out[places] = flat
    return out


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    scored = score(docs.withColumn("trained", remainder(F.col("doc_id"), 7) != 2))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
