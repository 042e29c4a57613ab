"""The pipeline's stages on the smallest table, against plain versions of their decisions."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from khata.llm import secrets

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "12 34 -- 5"), (10**6 + 2, ""), (10**6 + 3, "pwd: x7Kq9vTz2Lm4 in prose of the text")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.keep(stage(spark, out[-1], SF)))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    for before, after in zip(stages, stages[1:-1]):
        assert set(after.columns) == set(before.columns)


def test_decisions(stages):
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in stages[:-1]]
    gone = set(texts[0]) - set(texts[1])
    assert {10**6, 10**6 + 1, 10**6 + 2} <= gone and all(len(words(texts[0][i])) < 8 for i in gone)
    groups = {}
    for i, t in texts[1].items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert set(texts[2]) == {min(g)[1] for g in groups.values()}
    sets = {i: shingles(t) for i, t in texts[2].items()}
    root = {i: i for i in sets}
    while True:
        new = {i: min(root[j] for j in sets if j == i or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))) for i in sets}
        if new == root:
            break
        root = new
    assert set(texts[3]) == {i for i in sets if root[i] == i}
    assert set(texts[4]) == set(texts[3])
    for i, t in texts[4].items():
        assert not secrets.base_spans(t) and (t == texts[3][i]) == (not secrets.base_spans(texts[3][i]) and not secrets.guess_spans(texts[3][i]))
    assert "x7Kq" not in texts[4][10**6 + 3]


def test_packed(stages):
    packed = stages[-1]
    assert packed.select("doc_id").distinct().count() == stages[-2].count()
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n > 2048 or n != end").count() == 0


def test_gibberish_goes(spark):
    r = random.Random(4)
    letters, mash = "abcdefghijklmnopqrstuvwxyz ", "asdfghjkl;qwer uiop"
    odd = [*("".join(r.choice(kind) for _ in range(400)) for kind in (letters, mash, "абвгдежзиклмнопрст ") for _ in range(20)), *(base64.b64encode(r.randbytes(300)).decode() for _ in range(20)), "q" * 400]
    short = ["the house and the garden", "der Mann und die Frau sind nicht hier", "les enfants et la maison", "el perro y los gatos de la casa", "Yes."]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate([*odd, *short, "12 -- 5"])], "doc_id long, text string, lang string")
    left = corpus_pipeline.by_language(spark, docs.unionByName(more), SF)
    ids = {x.doc_id for x in left.select("doc_id").collect()}
    assert sum(10**6 + k in ids for k in range(len(odd))) <= 0.02 * len(odd) and 10**6 + len(odd) - 1 not in ids
    assert all(10**6 + len(odd) + k in ids for k in range(len(short))) and len([i for i in ids if i < 10**6]) >= 0.99 * docs.where("text rlike '[a-zA-Z]'").count()
    few = corpus_pipeline.by_language(spark, docs.where("lang in ('en', 'de')").unionByName(more), SF)
    assert {x.doc_id for x in few.where("doc_id >= 1000000").collect()}.isdisjoint({10**6 + len(odd) - 1, 10**6 + len(odd) + len(short)})
    bare = corpus_pipeline.by_language(spark, more, SF)
    assert {x.doc_id for x in bare.collect()} == set(range(10**6, 10**6 + len(odd) + len(short)))
