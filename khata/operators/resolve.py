"""Names to entities: exact on the normal form, then trigram candidates, then a queue for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions.text import jaccard, normalise_name, token_set, trigrams
from khata.operators.upsert import merge

# Least similarity of a candidate, of a sure one, its lead, candidates kept, least confidence.
CANDIDATE, DOMINANT, MARGIN, TOP, ACCEPT = 0.35, 0.92, 0.08, 8, 0.90
# Least Jaccard of words of what is suggested to a reviewer, and how many are.
SUGGESTED, SUGGESTIONS = 0.34, 5


def candidates(names: DataFrame, entities: DataFrame, least: float = CANDIDATE, top: int | None = TOP) -> DataFrame:
    """(name, entity_id, similarity, place) by trigram similarity; top None: all of them, without place.

    Blocked by trigram: a name meets only the entities with which it shares one of the rarest trigrams that it
    must share (prefix filtering), so common trigrams join nothing.
    """
    a = names.select("name").distinct().withColumn("ta", trigrams(F.col("name")))
    b = entities.select("entity_id", F.col("name").alias("entity_name"), trigrams(F.col("name")).alias("tb"))
    counts = b.select(F.explode("tb").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def prefixes(rows, key, grams):
        each = rows.select(key, F.size(grams).alias("s"), F.explode(grams).alias("t")).join(counts, "t", "left")
        order = Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "t")
        return each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("s") - F.ceil(F.col("s") * least) + 1).select(key, "t")

    pairs = prefixes(a, "name", "ta").join(prefixes(b, "entity_id", "tb"), "t").select("name", "entity_id").distinct()
    scored = pairs.join(a, "name").join(b, "entity_id").select("name", "entity_id", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= least)
    if top is None:
        return scored
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "entity_id"))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, entity_id, confidence, method: exact, trigram or review (entity_id then is the best guess)."""
    exact = entities.groupBy(normalise_name(F.col("name")).alias("norm")).agg(F.min("entity_id").alias("exact_id"))
    found = candidates(names, entities)
    order = Window.partitionBy("name").orderBy("place")
    best = found.withColumn("next", F.lead("similarity").over(order)).where("place = 1").select("name", F.col("entity_id").alias("best_id"), "similarity", "next")
    rows = names.select("name").distinct().withColumn("norm", normalise_name(F.col("name"))).join(exact, "norm", "left").join(best, "name", "left")
    sure = (F.col("similarity") >= DOMINANT) & (F.col("similarity") - F.coalesce("next", F.lit(0.0)) >= MARGIN)
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(sure, "trigram").otherwise("review")
    confidence = F.when(method == "exact", F.lit(1.0)).otherwise(F.round(F.least(F.col("similarity"), F.lit(0.99)), 2))
    return rows.select("name", F.coalesce("exact_id", "best_id").alias("entity_id"), confidence.alias("confidence"), method.alias("method"))


def _by_words(names: DataFrame, entities: DataFrame, least: float) -> DataFrame:
    """(name, entity_id, entity_name, same, score) of pairs whose normal forms are equal or whose words' Jaccard is this at least.

    Blocked by word: of its words a name meets others by the rarest alone that it must share (prefix filtering), so that a
    word of very many names joins nothing unless a name has no rarer one.
    """
    a = names.select("name").where("name is not null").distinct().select("name", normalise_name(F.col("name")).alias("norm"), token_set(F.col("name")).alias("ta"))
    b = entities.select("entity_id", F.col("name").alias("entity_name"), normalise_name(F.col("name")).alias("norm_b"), token_set(F.col("name")).alias("tb"))
    counts = b.select(F.explode("tb").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rarest(rows, keys, words):
        each = rows.select(*keys, F.size(words).alias("s"), F.explode(words).alias("w")).join(counts, "w", "left")
        ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")))
        grouped = each.groupBy(*keys).agg(ranked.alias("ranked"), F.first("s").alias("s"))
        return grouped.select(*keys, F.explode(F.slice("ranked", F.lit(1), (F.col("s") - F.ceil(F.col("s") * least - 1e-9) + 1).cast("int"))).alias("r")).select(*keys, "r.w")

    pairs = rarest(a, ["name"], "ta").join(rarest(b, ["entity_id", "entity_name"], "tb"), "w").select("name", "entity_id", "entity_name")
    equal = a.where("norm != ''").join(b, F.col("norm") == F.col("norm_b")).select("name", "entity_id", "entity_name")
    scored = pairs.union(equal).distinct().join(a, "name").join(b, ["entity_id", "entity_name"])
    score, same = jaccard(F.col("ta"), F.col("tb")), F.col("norm") == F.col("norm_b")
    return scored.select("name", "entity_id", "entity_name", same.alias("same"), score.alias("score")).where(F.col("same") | (F.col("score") >= least))


def match_tokens(names: DataFrame, entities: DataFrame, least: float = 0.6) -> DataFrame:
    """name, entity_id, match: high where normal forms are equal, medium from this Jaccard of words, else none."""
    scored = _by_words(names, entities, least).withColumn("score", F.when(F.col("same"), 2.0).otherwise(F.col("score")))
    best = scored.groupBy("name").agg(F.min_by("entity_id", F.struct(-F.col("score"), "entity_id")).alias("entity_id"), F.max("score").alias("score"))
    return names.select("name").distinct().join(best, "name", "left").select("name", "entity_id", F.when(F.col("score") == 2, "high").when(F.col("score").isNotNull(), "medium").otherwise("none").alias("match"))


def best_matches(names: DataFrame, entities: DataFrame, least: float = SUGGESTED, limit: int = SUGGESTIONS) -> DataFrame:
    """(name, entity_id, entity_name, score, place): for each name the entities whose words are most like its own, ties by their names."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "entity_name", "entity_id"))
    found = _by_words(names, entities, least).where(F.col("score") >= least)
    return found.withColumn("place", place).where(F.col("place") <= limit).select("name", "entity_id", "entity_name", "score", "place")


def by_alias(names: DataFrame, aliases: DataFrame, least: float = ACCEPT) -> DataFrame:
    """name, entity_id and outcome of every row of names(name), by aliases(alias, entity_id, confidence).

    Names and aliases are equal when their letters and digits are. An alias of at least this confidence resolves a name (the surest,
    then the smallest id, where several do); one of less gives what a reviewer is to look at; else the name is unknown.
    """
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    keyed = aliases.groupBy(key("alias").alias("key")).agg(
        F.min(F.when(F.col("confidence") >= least, F.struct((-F.col("confidence")).alias("less"), "entity_id"))).alias("sure"),
        F.max(F.when(F.col("confidence") < least, F.col("entity_id"))).alias("weak"),
    )
    found = names.join(keyed, key("name") == F.col("key"), "left")
    outcome = F.when(F.col("sure").isNotNull(), "alias").when(F.col("weak").isNotNull(), "review").otherwise("unknown")
    return found.select("name", F.coalesce("sure.entity_id", "weak").alias("entity_id"), outcome.alias("outcome"))


def shortlist(names: DataFrame, entities: DataFrame, aliases: DataFrame, top: int = TOP) -> DataFrame:
    """(name, entity_id, entity_name, similarity, via, place): the entities most like each name, by their own names or by aliases.

    entities(entity_id, name) hold each entity once; aliases(alias, entity_id) of entities that aren't there are left out. Of
    an entity's hits the most similar counts, its own name before an alias that is as similar; ties go to the smaller entity_id.
    """
    known = entities.select("entity_id", F.col("name").alias("entity_name"))
    own = candidates(names, entities, top=None).select("name", "entity_id", "similarity", F.lit("reference").alias("via"))
    spelled = aliases.select("alias", F.col("entity_id").alias("of")).distinct()
    hits = candidates(names, spelled.select(F.col("alias").alias("entity_id"), F.col("alias").alias("name")).distinct(), top=None)
    met = hits.join(spelled, hits["entity_id"] == spelled["alias"]).select("name", F.col("of").alias("entity_id"), "similarity", F.lit("alias").alias("via"))
    best = own.union(met).groupBy("name", "entity_id").agg(F.max("similarity").alias("similarity"), F.max_by("via", F.struct("similarity", "via")).alias("via"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "entity_id"))
    return best.join(known, "entity_id").withColumn("place", place).where(F.col("place") <= top).select("name", "entity_id", "entity_name", "similarity", "via", "place")


def ladder(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, queue): each name goes down the steps until one of them decides.

    An alias that is the name letter by letter decides as it stands, whatever its confidence, for it may be a human's. Else, of the
    shortlist: the first entity whose normal form is the name's (confidence 1), then one that alone is similar enough (DOMINANT,
    MARGIN before the next). What is left is queued with its shortlist as suggestions, and has no entity.

    aliases(alias, entity_id, confidence, resolved_by), each alias once. resolved(name, entity_id, confidence, resolved_by) has
    every name once, null entity_id and resolved_by "queued" where it is in queue(name, suggestions), an array of
    (entity_id, entity_name, similarity, via). Null names take no part.
    """
    asked = names.select("name").where("name is not null").distinct()
    settled = asked.join(aliases, F.col("name") == F.col("alias"), "left")
    origin = F.when(F.col("resolved_by").isin("exact", "trigram", "agent"), F.col("resolved_by")).otherwise("exact")
    known = settled.where("alias is not null").select("name", "entity_id", F.col("confidence").cast("double").alias("confidence"), origin.alias("resolved_by"))
    open_names = settled.where("alias is null").select("name")
    found = shortlist(open_names, entities, aliases)
    norm = normalise_name(F.col("name"))
    hit = (norm != "") & (norm == normalise_name(F.col("entity_name")))
    by_place = lambda c: F.struct("place", *c)
    sums = found.groupBy("name").agg(
        F.min(F.when(hit, by_place(["entity_id"]))).alias("exact"), F.min(F.when(F.col("place") == 1, by_place(["entity_id", "similarity"]))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.col("similarity"))).alias("next"),
        F.sort_array(F.collect_list(F.struct("place", "entity_id", "entity_name", F.round("similarity", 3).alias("similarity"), "via"))).alias("all"),
    )
    top = F.col("first.similarity")
    sure = (top >= DOMINANT) & (top - F.coalesce("next", F.lit(0.0)) >= MARGIN)
    method = F.when(F.col("exact").isNotNull(), "exact").when(sure, "trigram").otherwise("queued")
    judged = open_names.join(sums, "name", "left").withColumn("resolved_by", method)
    confidence = F.when(method == "exact", 1.0).when(method == "trigram", F.round(F.least(top, F.lit(0.99)), 2)).otherwise(0.0)
    entity = F.when(method == "exact", F.col("exact.entity_id")).when(method == "trigram", F.col("first.entity_id"))
    resolved = known.unionByName(judged.select("name", entity.alias("entity_id"), confidence.alias("confidence"), "resolved_by"))
    shown = F.transform(F.coalesce("all", F.array()), lambda c: F.struct(c["entity_id"].alias("entity_id"), c["entity_name"].alias("entity_name"), c["similarity"].alias("similarity"), c["via"].alias("via")))
    return resolved, judged.where("resolved_by = 'queued'").select("name", shown.alias("suggestions"))


def remember(aliases: DataFrame, resolved: DataFrame, least: float = ACCEPT) -> DataFrame:
    """aliases after what was resolved with this confidence; a mapping that a human made stays, others are replaced. With action."""
    new = resolved.where((F.col("entity_id").isNotNull()) & (F.col("confidence") >= least)).select(F.col("name").alias("alias"), "entity_id", "confidence", "resolved_by")
    human = aliases.where("resolved_by = 'human'").select("alias")
    return merge(aliases.select("alias", "entity_id", F.col("confidence").cast("double").alias("confidence"), "resolved_by"), new.join(human, "alias", "left_anti"), ["alias"])


def queue_up(old: DataFrame, new: DataFrame) -> DataFrame:
    """old(name, suggestions, status) after new(name, suggestions): suggestions change while pending alone. With action."""
    settled = old.where("status != 'pending'").select("name")
    return merge(old, new.join(settled, "name", "left_anti").withColumn("status", F.lit("pending")), ["name"])
