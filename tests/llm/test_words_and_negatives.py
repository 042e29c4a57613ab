"""Spelling variants, tree concatenation and hard negatives against plain versions, on odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from khata.llm import hard_negatives, spelling, tree_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "the spelling of internationalization isn't 'settled' they're"), (2, None), (3, ""), (4, " \t\n"), (5, "a" * 300), (6, "日本語テキスト" * 30), (7, "é é ́x 각ᆨ हिन्दी क्षि"),
    (8, "x'" * 80 + "'re 's''ve"), (9, "<|endoftext|> and <|STARTOFTEXT|>" * 9), (10, "".join(random.Random(1).choice("etaoinshr") for _ in range(2000))), (11, "!?-" * 100 + "😀" * 50),
    (11, "repeated id " * 20), (None, "no id, 　 wide space İstanbul ﬁn" * 9), (12, "https://example.org/" + "a1b2c3" * 60), (12, "repeated id " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return rows.select(*[F.lit("x").alias(c) for c in ("row", "part", "parts", "ids", "n", "word", "head", "h")], "*")


# -- tree concatenation


@pytest.mark.parametrize("leaf", [1, 7, 40, 1000])
def test_ids_of_every_leaf_size_are_the_librarys(docs, leaf):
    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS)
    rows = tree_bpe.decode(tree_bpe.encode(docs, PATH, leaf), PATH).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in rows)


def test_joins_agree_with_the_library_on_random_texts(monkeypatch):
    tool, r = tree_bpe.Tree(PATH), random.Random(3)
    words = "the 's 're don't 日本語 😀 é ́ 　 123 ''' ---- 각 हिन्दी \x1c internationalization '''s 'vent".split(" ")
    for n in range(600):
        monkeypatch.setattr(tree_bpe, "WINDOW", r.choice([4, 8, 32]))
        text = r.choice(["", " ", "\n"]).join(r.choice(words) for _ in range(r.randrange(1, 40)))
        leaf = r.choice([1, 2, 5, 13])
        ids = np.frombuffer(tool.encode([tool.leaf(text[k : k + leaf]) for k in range(0, len(text), leaf)]), "<u4").tolist()
        assert ids == tool.library.encode(text, add_special_tokens=False).ids, (leaf, text)


def test_long_unsplit_text_is_joined_by_windows_alone(monkeypatch):
    tool = tree_bpe.Tree(PATH)
    text = "".join(random.Random(2).choice("etaoinshrdlu") for _ in range(60_000))
    parts = [tool.leaf(text[k : k + 4096]) for k in range(0, len(text), 4096)]
    widest, run = [0], tool.run
    monkeypatch.setattr(tool, "run", lambda t, start=0: widest.append(len(t)) or run(t, start))
    ids = np.frombuffer(tool.encode(parts), "<u4").tolist()
    assert max(widest) <= 1024
    assert ids == tool.library.encode(text, add_special_tokens=False).ids


def test_marks_that_meet_only_one_case_of_a_letter_are_composed_before_lower_case(spark):
    words = "H\u0331 J\u030c T\u0308 T\u0344 W\u030a Y\u030a W\u0327\u030a I\u0307\u093c <|STARTOFTEXT|>J\u030c The\x1cH\u0331".split(" ")
    texts = [(k, t) for k, w in enumerate(words) for t in (w, f"The {w}The {w.lower()}! AND {w}'s")]
    library = Tokenizer.from_file(PATH)
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in texts)
    for leaf in (2, 1000):
        rows = tree_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), PATH, leaf).collect()
        assert sorted((r.doc_id, list(r.ids)) for r in rows) == want


def test_digests_and_an_empty_table(docs):
    rows = tree_bpe.digests(tree_bpe.decode(tree_bpe.encode(docs.where("doc_id = 2"), PATH), PATH)).collect()
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert [tuple(r) for r in rows] == [(2, 0, empty, empty)]
    assert tree_bpe.encode(docs.limit(0), PATH, 5).count() == 0


# -- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def vocabulary():
    r, words = random.Random(8), {}
    for stem in ["spelling", "colour", "naïveté", "éléphant", "aaaaaa", "international", "ÀÀÿÿÀÀ"]:
        words[stem] = 4000
        for _ in range(25):
            w = stem
            for _ in range(r.randrange(1, 3)):
                k = r.randrange(len(w) + 1)
                w = w[:k] + r.choice(["", "x", "é", "a"]) + w[k + r.randrange(2) :]
            if len(w) >= 6:
                words.setdefault(w, r.choice([5, 30, 30, 170, 900]))
    for k in range(40):  # one half in common
        words["prefix" + "".join(r.choice("ab") for _ in range(6))] = r.choice([5, 50])
        words["".join(r.choice("ab") for _ in range(7)) + "suffix"] = r.choice([5, 50])
    return words


@pytest.mark.parametrize("pairs", [20, spelling.PAIRS])
def test_groups_agree_with_all_pairs(spark, monkeypatch, pairs):
    counts = vocabulary()
    if pairs == spelling.PAIRS:
        counts["m" * 3000], counts["m" * 2999 + "n"], counts["m" * 2999] = 100, 7, 7
    monkeypatch.setattr(spelling.near_words, "__defaults__", (pairs,))
    rows = spelling.groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == plain_groups(counts) and len(rows) == len(counts)


def test_runs_lose_a_letter_by_their_checksum(spark):
    r = random.Random(4)
    texts = [(k, " ".join(r.choice(["Spelling", "colour,", "été-élan", "ÀBCDEF×÷", "short", "don't_internationalise"]) for _ in range(200))) for k in range(40)] + [(None, "without identity"), (50, None), (51, "")]
    want = collections.Counter()
    for k, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("run", F.lit(1))
    got = {x.word: x.n for x in spelling.damaged(docs, 7).collect() if len(x.word) >= 6}
    assert got == {w: n for w, n in want.items() if len(w) >= 6}


def test_no_words_no_groups(spark):
    nothing = spark.createDataFrame([], "word string, n long")
    assert spelling.groups(nothing).count() == 0
    assert spelling.damaged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- hard negatives


def plain_negatives(rows, every):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    held = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and good(v):
            held.append((i, n, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a in held:
        if a[0] % every:
            continue
        met = [(-sum(x * y for x, y in zip(a[3], b[3])), b[0], b[1], b[2]) for b in held if len(a[3]) == len(b[3]) and b[1] != a[1]]
        for p in sorted(m for m in met if m[3] == a[2])[:5]:
            own = sorted(m for m in met if m[3] != a[2] and 80 * -p[0] <= 100 * -m[0] <= 100 * -p[0])[:5]
            out += [(a[0], p[1], k + 1, m[1], -p[0], -m[0]) for k, m in enumerate(own)]
    return sorted(out)


def vectors():
    r = np.random.default_rng(5)
    centres = r.standard_normal((10, 20)) / 4
    rows = [(int(k), (centres[k % 10] + r.standard_normal(20) / 6).astype(np.float32).tolist(), int(min(k % 10, 4))) for k in range(900)]
    rows += [(1000 + k, rows[50][1], k % 3) for k in range(30)]  # ties
    rows += [(1100, rows[60][1], 2), (1100, rows[60][1], 2), (1101, None, 1), (1102, [1.0, None] + [0.0] * 18, 1), (1103, [float("nan")] * 20, 1), (1104, [float("inf")] * 20, 1), (1105, rows[3][1], None)]
    rows += [(1110, [0.5, 0.25, 1.5], 1), (1120, [0.5, 0.25, 1.0], 1), (1121, [0.5, 0.25, 1.25], 4), (1200, [], 1), (1201, [], 1), (1202, [], 3), (1300, [0.0] * 20, 4), (None, rows[60][1], 2)]
    rows += [(1400, [3e5] * 20, 4), (1402, [2.9e5] * 20, 4), (1403, [2.5e5] * 20, 5)]
    return rows


@pytest.mark.parametrize("block, chunk", [(32_768, 4096), (100, 7)])
def test_hard_negatives_agree_with_all_scores(spark, monkeypatch, block, chunk):
    for name, value in (("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select(*[F.lit(1).alias(c) for c in ("num", "d", "v", "block", "anchor", "place")], "*")
    float_rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    got = sorted(map(tuple, hard_negatives.hard_negatives(table, 10).collect()))
    assert got == plain_negatives(float_rows, 10) and len(got) > 500


def test_bounds_hold_and_tighten():
    v = np.random.default_rng(1).integers(-90, 90, (300, 21))
    means, deviations = hard_negatives.summaries(v)
    scores, at, seen = v @ v.T, 0, []
    for m in hard_negatives.SEGMENTS:
        end = at + -(-21 // m)
        middle, reach = means[:, at:end] @ means[:, at:end].T, deviations[:, at:end] @ deviations[:, at:end].T
        slack = hard_negatives.SLACK * np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)) + 1
        assert (middle + reach + slack >= scores).all() and (middle - reach - slack <= scores).all()
        seen.append(float((middle + reach).mean()))
        at = end
    assert seen == sorted(seen, reverse=True)


def test_no_vectors_no_negatives(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0
