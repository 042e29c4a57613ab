"""Secret scans (5).

Three kinds of spans come from patterns: assignments, access keys and runs of hexadecimal digits. Beyond
them the values of a wider credential context are judged by the cost of guessing them: the cheapest way to
cut a value into words, dates, repeats, keyboard walks and brute-force spans, found by dynamic
programming, as a password guesser would try them. A value that costs enough guesses is a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keep, remembered, short_batches, table

# The three base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

# Names that make a credential context, the separators after them, names that may stand between (a scheme, or a
# name again), and a value.
NAMES = r"pwd|passphrase|passcode|password|passwd|pass|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|authorization|bearer"
SEPARATOR = r"(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)"
VALUE = r"""[^\x00-\x20"'`<>\#,;()\[\]{}\x7f-\U0010ffff]{6,}"""
CONTEXT = re.compile(rf"""(?<![A-Za-z])(?:{NAMES})["']?{SEPARATOR}["']?(?:(?:{NAMES}|basic|digest)["']?(?:{SEPARATOR}|\x20+)["']?)*({VALUE})""", re.I | re.A)
CONTEXT_HINTS = ("pwd", "pass", "secret", "token", "key", "credential", "authorization", "bearer")
# Words that guessers try first, most likely first; a word's rank is its place.
WORDS = (
    "password passwd pass secret admin root user test guest login welcome letmein master dragon monkey shadow sunshine princess "
    "football baseball iloveyou trustno hello freedom whatever michael jordan superman batman charlie daniel jessica summer winter "
    "spring autumn monday friday january default changeme example sample token key demo temp none null true false public private "
    "server client data base mail web home work love god the and for you not this that with from your have are was but all can"
).split()
#: Words of the documents that guessers try after them: the most frequent ones, which stand in so many texts at least.
KNOWN, LEAST_TEXTS, LONGEST = 50_000, 2, 32
#: Steps of the counts of texts in a factor of two, by which the least count of a known word is set.
STEPS = 64
WORD = re.compile(r"[^\W\d_]+")


class Words:
    """Words by rank, from 1, and how long those are that begin with two characters."""

    def __init__(self, more: list[str] = ()):
        self.rank: dict[str, int] = {}
        self.longest: dict[str, int] = {}
        for w in (*WORDS, *more):
            if w not in self.rank:
                self.rank[w] = len(self.rank) + 1
                self.longest[w[:2]] = max(len(w), self.longest.get(w[:2], 0))

    def reach(self, *heads: str) -> int:
        return max(self.longest.get(h, 0) for h in heads)


GUESSERS = Words()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
LEET = str.maketrans("4@310$57!", "aaeiosstl")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: log10 of the guesses from which a value is taken for a secret; characters of a unit that may repeat, at most.
GUESSES, UNIT = 10.0, 64


def _class(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def guess_cost(value: str, least: float = GUESSES, words: Words | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation of value, or inf once that can't be below least; 0 for the empty value.

    With k parts the guesses are the product of the parts' guesses times k factorial, which bounds k. A repeat costs what
    its unit does, by the unit's own cheapest segmentation, times how often it stands there. One
    pass keeps the costs at an end, those of spans that end later, and the repeats that are still open.
    """
    n = len(value)
    if not n:
        return 0.0
    words = words or GUESSERS
    orders = [0.0, 0.0]  # log10 of k factorial
    while orders[-1] + math.log10(len(orders)) < least:
        orders.append(orders[-1] + math.log10(len(orders)))
    room = [least - x for x in orders]  # what k parts may cost
    parts, inf = range(1, len(orders)), math.inf
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    cost = [0.0] + [inf] * (len(orders) - 1)  # by parts: cheapest cut of value[:e], a brute-force span being one part
    brute = [inf] * len(orders)  # the last part is a brute-force span
    later: dict[int, list[float]] = {}  # costs at later ends
    runs: dict[tuple[int, int], list[list[tuple[float, int]]]] = {}  # open repeats by size and place modulo size; by parts: costs of units and starts
    prices: dict[str, float] = {}  # of units
    ends: dict[int, int] = {}  # where the repetition of a size that was met last ends

    def to(end: int, more: float) -> None:
        own = later.get(end)
        for k in parts:
            if (c := cost[k - 1] + more) < room[k]:
                if own is None:
                    own = later[end] = [inf] * len(orders)
                if c < own[k]:
                    own[k] = c

    for e in range(n + 1):
        if e:
            rate = math.log10(_class(value[e - 1]))
            brute = [inf] + [c if (c := min(brute[k], cost[k - 1]) + rate) < room[k] else inf for k in parts]
            cost = brute if (own := later.pop(e, None)) is None else [min(x, y) for x, y in zip(brute, own)]
            for size in sorted({s for s, at in runs if at == e % s}) if runs else ():
                if (open_runs := runs.get((size, e % size))) is None:
                    continue
                if value[e - size : e] != value[e - 2 * size : e - size]:  # ended; one that begins here goes on
                    if any(own_run := [[x for x in by if x[1] == e - size] for by in open_runs]):
                        runs[size, e % size] = own_run
                    else:
                        del runs[size, e % size]
                    continue
                cost, some = list(cost), False
                for k in parts:
                    if not open_runs[k]:
                        continue
                    left: list[tuple[float, int]] = []
                    best = inf
                    for base, i in open_runs[k]:  # by start; once an earlier start is as cheap, it stays so
                        repeats = (e - i) // size
                        now = base + math.log10(repeats)
                        if now < room[k] and now < best:
                            best = now
                            if repeats > 1:
                                while left and left[-1][0] >= base:
                                    left.pop()
                                cost[k] = min(cost[k], now)
                            left.append((base, i))
                    open_runs[k] = left
                    some |= bool(left)
                if not some:
                    del runs[size, e % size]
            if not later and not runs and min(cost) == inf:
                return inf
        if e == n:
            break
        if min(cost) == inf:
            continue
        for j in range(e + 2, min(n, e + words.reach(low[e : e + 2], plain[e : e + 2])) + 1):  # words, in any case or with look-alikes
            if (rank := words.rank.get(low[e:j])) or (rank := words.rank.get(plain[e:j])):
                changes = sum(c.isupper() for c in value[e:j]) + sum(a != b for a, b in zip(low[e:j], plain[e:j]))
                to(j, math.log10(rank) + math.log10(2) * changes)
        if m := DATE.match(value, e):  # some day of a century, or a year
            to(m.end(), math.log10(365 * 100 if len(m[0]) > 4 else 100))
        inside = 0  # up to here the value repeats a shorter unit, which units of a square inside are made of
        for size in range(1, min(UNIT, (n - e) // 2) + 1):  # repeats of a unit that is none itself
            if e + 2 * size <= inside:
                continue
            unit = value[e : e + size]
            if not value.startswith(unit, e + size) or (unit + unit).find(unit, 1) != size:
                continue
            if e + 2 * size > ends.get(size, 0):
                end = e + 2 * size
                while end < n and value[end] == value[end - size]:
                    end += 1
                ends[size] = end
            inside = max(inside, ends[size])
            if (rate := prices.get(unit)) is None:
                rate = prices[unit] = guess_cost(unit, least, words)
            if rate < least:
                own_run = runs.setdefault((size, e % size), [[] for _ in orders])
                for k in parts:
                    if (c := cost[k - 1] + rate) < room[k]:
                        own_run[k].append((c, e))
                if not any(own_run):
                    del runs[size, e % size]
        for step in (1, -1):  # walks along a row of the keyboard, or up and down the codes
            for near in (True, False):
                j = e + 1
                while j < n and _follows(low[j - 1], low[j], step, near):
                    j += 1
                    if j - e >= 3:
                        to(j, math.log10(len(PLACE) * 2 * (j - e)))
    return min(c + x for c, x in zip(cost, orders))


def _follows(a: str, b: str, step: int, near: bool) -> bool:
    if near:
        return a in PLACE and b in PLACE and PLACE[a][0] == PLACE[b][0] and PLACE[b][1] - PLACE[a][1] == step
    return a.isalnum() and b.isalnum() and ord(b) - ord(a) == step


_HEXES = bytes(ord("h") if chr(b) in "0123456789abcdef" else 0 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points, by start and kind."""
    found = []
    raw = text.encode()
    low = raw.lower()
    if any(w in low for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"h" * HEX_LEAST in raw.translate(_HEXES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def credentials(text: str):
    """Matches of CONTEXT."""
    low = text.lower()
    return CONTEXT.finditer(text) if any(w in low for w in CONTEXT_HINTS) else ()


def guess_spans(text: str, least: float = GUESSES, words: Words | None = None) -> list[tuple[int, int, int]]:
    """Values of a credential context whose guess cost is at least 10 ** least.

    Without the documents' words prose can't be told from secrets, and only values with a letter and a digit count.
    """
    found = []
    for m in credentials(text):
        value = m[1].rstrip(".,;:!?)]}")
        judged = value
        if words is None:
            if not (LETTER.search(value) and DIGIT.search(value)):
                continue
        elif value == m[1] and (rest := WORD.match(text, m.end(), m.end() + LONGEST)):
            judged += rest[0]  # the value ends inside a word, before a letter beyond ASCII
        if guess_cost(judged, least, words) >= least:
            found.append((m.start(1), 3, m.start(1) + len(value)))
    return found


def words_of(docs: DataFrame) -> Words:
    """The guessers' words and the most frequent ones of all texts, at most KNOWN, by the number of texts that hold them.

    Values of a credential context are not counted, so that secrets don't become words.
    """

    def count(batches):
        seen: Counter[str] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), "string"), pa.array(list(seen.values()), "int64")], names=["word", "n"])
        for batch in batches:
            for text in batch.column(1).to_pylist():
                parts, at = [], 0
                for m in credentials(text):
                    parts.append(text[at : m.start(1)])
                    at = m.end()
                seen.update({w for w in WORD.findall("".join([*parts, text[at:]]).lower()) if 1 < len(w) <= LONGEST})
            if len(seen) > 200_000:
                yield told()
                seen.clear()
        yield told()

    counts = documents(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    counts = keep(counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    # The least count that KNOWN words reach, in steps of a few per cent: one row a step comes to the driver, then at most KNOWN words.
    least, room = 0, KNOWN
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            least = r["step"] + 1
            break
    most = counts.where(F.col("step") >= least).collect()
    return Words([r["word"] for r in sorted(most, key=lambda r: (-r["n"], r["word"]))])


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, least: float = GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_spans of every row of docs(doc_id, text).

    Spans are kind:start:end in code points, by start, then kind. A null or empty text has none (the
    digest is that of the empty string). Repeated rows are each scanned; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(words_of(docs))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = sorted(base + guess_spans(text, least, known.value))
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = ("int64", "int64", "int64", "string", "string", "int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, least: float = GUESSES, mask: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by mask; overlapping spans by one. A null text stays null."""

    short_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(words_of(docs))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        remembered("secrets", dict)  # nothing to keep, and nothing of others

        def one(text):
            if text is None:
                return None
            spans = sorted(base_spans(text) + guess_spans(text, least, known.value))
            if not spans:
                return text
            out, at, end = [], 0, -1
            for a, _, b in spans:
                if a >= end:
                    out += [text[at:a], mask]
                at = end = max(end, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    cleaned = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
