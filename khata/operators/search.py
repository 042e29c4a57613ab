"""Search over titles and descriptions by weighted words."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions.text import similarity

# Weights of a title, of other names and of the context, and the similarity from which a name is a hit by itself.
WEIGHTS, ALIKE = {"title": 1.0, "aliases": 0.4, "extra": 0.2}, 0.3
TITLE, EXTRA = 2, 1


def words_of(column: Column) -> Column:
    return F.split(F.lower(column), "[^a-z0-9]+")


def find(index: DataFrame, words: list[str]) -> DataFrame:
    """entity_id, kind, title and score of rows(…, title, extra) that have every word; a title's word weighs twice."""
    title, extra = words_of(F.col("title")), words_of(F.col("extra"))
    weight = lambda w: F.when(F.array_contains(title, w), TITLE).when(F.array_contains(extra, w), EXTRA).otherwise(0)
    each = [weight(w.lower()) for w in words]
    every = reduce(lambda a, b: a & b, [e > 0 for e in each])
    return index.where(every).select("entity_id", "kind", "title", (2 * reduce(lambda a, b: a + b, each)).alias("score"))


def terms_of(text: str) -> list[list[tuple[bool, str]]]:
    """What a reader typed, as groups of which one must hold; of a group every term must hold, or not if it is False.

    Words stand for themselves, words in quotes for a phrase, a minus before either shuts it out, and `or` parts groups.
    """
    found: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not minus and word.lower() == "or":
            found.append([])
        elif words := " ".join(re.findall("[a-z0-9]+", (phrase or word).lower())):
            found[-1].append((not minus, f" {words} "))
    return [group for group in found if any(wanted for wanted, _ in group)]


def web(index: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """entity_id, kind, title and score of the best rows of index(entity_id, kind, title, aliases, extra) for what a reader typed.

    A row is a hit where a group of terms_of(text) holds, or where its title is similar enough to the whole text. Its score is twice
    the mean of its terms' weights, each by the heaviest field that holds it, of the best group that holds, and the similarity of
    its title. Missing fields are empty. A text without words finds nothing. Ties: by entity_id.
    """
    groups = terms_of(text)
    if not groups:
        return index.select("entity_id", "kind", "title", F.lit(0.0).alias("score")).limit(0)
    padded = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    rows = index.select("entity_id", "kind", "title", *[padded(c).alias(f"__{c}") for c in WEIGHTS])
    weight = lambda term: F.greatest(*[F.when(F.contains(F.col(f"__{c}"), F.lit(term)), F.lit(w)).otherwise(0.0) for c, w in WEIGHTS.items()])

    def rank(group):
        holds = reduce(lambda a, b: a & b, [(weight(t) > 0) == F.lit(wanted) for wanted, t in group])
        wanted = [weight(t) for w, t in group if w]
        return F.when(holds, reduce(lambda a, b: a + b, wanted) / len(wanted)).otherwise(0.0)

    best = F.greatest(*map(rank, groups), F.lit(0.0))
    rows = rows.withColumn("__rank", best).withColumn("__alike", F.coalesce(similarity(F.col("title"), F.lit(text.strip())), F.lit(0.0)))
    hits = rows.where((F.col("__rank") > 0) | (F.col("__alike") >= ALIKE))
    return hits.select("entity_id", "kind", "title", (2 * F.col("__rank") + F.col("__alike")).alias("score")).orderBy(F.round("score", 9).desc(), "entity_id").limit(limit)
