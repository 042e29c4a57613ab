"""Language ID (6) with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of its
letters, permuted (rotated) by place; a profile bundles (adds) the vectors of its trigrams, and
a document goes to the language whose centred prototype has the largest cosine with its own bundle. As a
bundle is a sum, its product with a prototype is the sum over trigrams of the prototype's products with
their vectors, which are tabulated once per model: documents are scored by table look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import documents, remainder, remembered

DIMENSIONS = 4096
SYMBOLS = 32  # 0: no letter, 1-26: a-z, 27-31: other letters, by a hash of the lower-case letter
SHARPNESS = 20.0
STEP = 1_000_000  # characters looked at at once
#: Lengths of the beginnings by which texts are judged, and the share of labelled ones that may fall below the bound.
LENGTHS, TAIL = (16, 64, 256, 1024, 4096), 0.005


def letter_codes() -> np.ndarray:
    codes = np.zeros(65537, np.int32)
    for cp in range(65536):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            codes[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5
    codes[65536] = 31  # letters beyond
    return codes


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts of all trigrams of symbols that hold a letter; None if the text has no letter."""
    table = remembered("letters", letter_codes)
    total, letters, tail = np.zeros(SYMBOLS**3, np.int64), False, np.zeros(1, np.int32)
    for at in range(0, len(text), STEP):
        part = text[at : at + STEP]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        if part.isascii() or points.max(initial=0) < 65536:
            codes = table[points]
        else:
            wide = points >= 65536
            codes = table[np.minimum(points, 65536)]
            codes[wide] = [31 * chr(p).isalpha() for p in points[wide]]
        letters |= bool(codes.any())
        codes = np.concatenate([tail, codes, np.zeros(int(at + STEP >= len(text)), np.int32)])
        total += np.bincount(codes[:-2] << 10 | codes[1:-1] << 5 | codes[2:], minlength=SYMBOLS**3)
        tail = codes[-2:]
    total[0] = 0
    return total if letters else None


def places(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as first, second and third of a trigram."""
    letters = np.random.default_rng(seed).choice([-1.0, 1.0], (SYMBOLS, dimensions))
    return np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters


def bundle(counts: np.ndarray, vectors) -> np.ndarray:
    """The sum of the trigrams' bound vectors, by their counts; exact in integers below 2 ** 53."""
    a, b, c = vectors
    ends = (counts.reshape(SYMBOLS * SYMBOLS, SYMBOLS).astype(float) @ c).reshape(SYMBOLS, SYMBOLS, -1)
    return np.einsum("xd,xd->d", a, np.einsum("yd,xyd->xd", b, ends))


@dataclass
class Profiles:
    """Languages and, per trigram, the products of its vector with their unit prototypes."""

    languages: list[str]
    products: np.ndarray
    dimensions: int

    def cosines(self, text: str | None) -> np.ndarray | None:
        """With the prototypes; None without a letter or a language."""
        counts = trigram_counts(text or "") if self.languages else None
        if counts is None:
            return None
        some = counts.nonzero()[0]
        own = counts[some].astype(float)
        # Random vectors are almost orthogonal: the bundle's squared norm is near dimensions * sum of squares.
        return own @ self.products[some] / np.sqrt(self.dimensions * (own @ own))

    def predict(self, text: str | None) -> tuple[str, float]:
        cosines = self.cosines(text)
        if cosines is None:
            return "und", 0.0
        chances = np.exp(SHARPNESS * (cosines - cosines.max()))
        best = int(cosines.argmax())
        return self.languages[best], float(chances[best] / chances.sum())

    def recognised(self, text: str | None, bounds: dict[tuple[int, int], float]) -> bool:
        """Whether the best cosine reaches the bound of its language and the text's length; never without a letter."""
        cosines = self.cosines(text)
        if cosines is None:
            return False
        best = int(cosines.argmax())
        own = [bounds[best, size] for size in LENGTHS if size <= len(text) and (best, size) in bounds]
        return not own or bool(cosines[best] >= own[-1])


def train(rows: DataFrame, dimensions: int = DIMENSIONS, seed: int = 7) -> Profiles:
    """Profiles from all rows(text, lang) whose lang is not null; one bundle per task and language is summed.

    What comes to the driver is one vector per language.
    """

    def bundles(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if (own := trigram_counts(text)) is not None:
                    counts[lang] = counts[lang] + own if lang in counts else own
        vectors = places(dimensions, seed)
        for lang, own in counts.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": bundle(own, vectors).astype("int64")})

    common.short_batches(rows.sparkSession)
    labelled = rows.where("lang is not null and text is not null").select("text", "lang")
    sums = labelled.mapInPandas(bundles, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).orderBy("lang").collect()
    languages = [r["lang"] for r in found]
    if not languages:
        return Profiles([], np.zeros((SYMBOLS**3, 0)), dimensions)
    unit = np.array([[x["value"] for x in r["v"]] for r in found], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    if len(languages) > 1:
        unit -= unit.mean(0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    a, b, c = places(dimensions, seed)
    products = np.empty((SYMBOLS, SYMBOLS, SYMBOLS, len(languages)))
    for k in range(len(languages)):
        for x in range(SYMBOLS):
            products[x, :, :, k] = (b * (a[x] * unit[k])) @ c.T
    return Profiles(languages, products.reshape(SYMBOLS**3, -1), dimensions)


def least_cosines(rows: DataFrame, profiles: Profiles) -> dict[tuple[int, int], float]:
    """Bounds by place of the best language and length: the TAIL quantile of the best cosines of the texts' beginnings.

    From all rows(text, lang) whose lang is not null; what comes to the driver is one number per language and length.
    """
    model = rows.sparkSession.sparkContext.broadcast(profiles)

    def measure(batches):
        for batch in batches:
            told = []
            for text in batch["text"]:
                for size in LENGTHS:
                    if size <= len(text) and (cosines := model.value.cosines(text[:size])) is not None:
                        told.append((int(cosines.argmax()), size, float(cosines.max())))
            yield pd.DataFrame(told, columns=["best", "size", "cosine"])

    common.short_batches(rows.sparkSession)
    labelled = rows.where("lang is not null and text is not null").select("text")
    told = labelled.mapInPandas(measure, "best int, size int, cosine double").groupBy("best", "size")
    return {(r["best"], r["size"]): r["least"] for r in told.agg(F.percentile_approx("cosine", TAIL, 100_000).alias("least")).collect()}


def recognisable(docs: DataFrame) -> DataFrame:
    """Rows of docs(text, lang) whose text is in a language known from the labelled rows, each row by itself.

    Letterless and null texts go, whatever is labelled; with no labelled rows every other one stays, and so do
    texts too short to be told from chance (under the first of LENGTHS).
    """
    profiles = train(docs)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    model = docs.sparkSession.sparkContext.broadcast((profiles, least_cosines(docs, profiles)))

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        known, bounds = model.value
        return texts.map(lambda t: known.recognised(t, bounds)).astype(bool)

    return docs.where(told("text"))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of docs(doc_id, text).

    A null, empty or letterless text is "und" with score 0. Repeated rows are each predicted.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # SYMBOLS ** 3 rows of one number per language

    def guess(batches):
        for batch in batches:
            said = [model.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], "string"), pa.array([s for _, s in said], "float64")], names=["doc_id", "lang_pred", "score"])

    return documents(docs).mapInArrow(guess, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    profiles = train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    return predict(docs, profiles).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
