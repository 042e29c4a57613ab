"""Names and prose: normal forms, token sets, trigrams, cosine, figures in sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Accents folded, abbreviations spelled out, spellings made alike, and words without weight in names.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
SLASHED = {"m/o": "ministry of", "d/o": "department of"}
SHORT = {
    "dept": "department", "deptt": "department", "min": "ministry", "govt": "government", "goi": "government of india", "&": "and", "dev": "development", "devt": "development", "corpn": "corporation",
    "corp": "corporation", "ltd": "limited", "pvt": "private", "natl": "national", "nat": "national", "auth": "authority", "comm": "commission", "org": "organisation", "affrs": "affairs", "edn": "education",
    "engg": "engineering", "admn": "administration",
}
SPELLING = {
    "organization": "organisation", "organizations": "organisations", "utilization": "utilisation", "labor": "labour", "defense": "defence", "programme": "program", "programmes": "programs", "centre": "center",
}
NOISE = ("the", "of", "for", "and", "india", "indian", "government", "govt", "goi", "republic", "union", "central", "office", "o")
# Stems that published prose may not use; a word may begin with them.
BANNED = ("scam", "fraud", "fraudulent", "siphon", "siphoned", "siphoning", "corrupt", "corruption", "embezzle", "embezzled", "embezzlement", "loot", "looted", "misappropriat")


def normalise_name(name: Column) -> Column:
    """Lower case, no accents, abbreviations spelled out (those with a slash first), signs to spaces, one spelling."""
    low = F.translate(F.lower(name), *ACCENTS)
    for short, long in SLASHED.items():
        low = F.regexp_replace(low, rf"\b{short}\b", long)
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(low, "&", " and "), "[^a-z0-9]+", " ")), " ")
    table = F.create_map(*[F.lit(x) for kv in (SHORT | SPELLING).items() for x in kv])
    return F.array_join(F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), lambda w: w != ""), " ")


def token_set(name: Column) -> Column:
    return F.array_distinct(F.array_except(F.split(normalise_name(name), " "), F.array(*map(F.lit, NOISE + ("",)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Different trigrams of each word, two spaces before it and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts."""
    return jaccard(trigrams(a), trigrams(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(normalise_name(name), "[^a-z0-9]+", "-"), F.lit("-"))


def clean_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# What holds digits but is no figure, and what a figure is. Citations and year labels go first: what they part may be a date.
# Word edges, spaces and letters in either case are those of SQL's patterns ("ſ" is a small s), which Java's "\b" and "\s" are not.
# First letters are looked at before edges, to save time.
EDGE, GAP = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))", r"[ \t\n\f\r]+"
MONTHS = "(?:January|February|March|April|May|June|July|Augu[sſ]t|[sſ]eptember|October|November|December)"
NO_FIGURES = (
    rf"\[(?:[sſ]ource|tender|evidence):[^\]]*\]|(?=F){EDGE}FY[0-9]{{4}}{EDGE}",
    rf"(?=[0-9ADFJMNOQSſ]){EDGE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}{GAP}{MONTHS}{GAP}[0-9]{{4}}|{MONTHS}{GAP}[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}|Q[1-4]){EDGE}",
)
#: Groups are never given back ("++"), so lists of any length cost no stack.
NUMBER = r"([-+]?[0-9]{1,3}(?:,[0-9]{2,3})++(?:\.[0-9]+)?|[-+]?[0-9]+(?:\.[0-9]+)?)"
# What stands for a secret, and the length under which a value is none.
REDACTED, SECRET_LEAST = "[redacted]", 6
#: Places after the point that printed figures are compared at; beyond them they must be equal.
PLACES = 10


def figures(prose: Column) -> Column:
    """Numbers of a text, with their sign, as printed without grouping, apart from citations, year labels, dates and quarters."""
    bare = reduce(lambda c, pattern: F.regexp_replace(c, f"(?i){pattern}", " "), NO_FIGURES, prose)
    found = F.transform(F.regexp_extract_all(bare, F.lit(NUMBER), 1), lambda x: F.regexp_replace(x, ",", ""))
    return F.when(prose.rlike("[0-9]"), found).when(prose.isNotNull(), F.array().cast("array<string>"))


def unsupported(printed: Column, allowed: Column) -> Column:
    """Printed figures that no allowed value equals or rounds to (half to even) at their own number of places."""
    def known(x):
        places = F.when(x.contains("."), F.length(F.substring_index(x, ".", -1))).otherwise(0)
        at = F.least(places, F.lit(PLACES)).cast("int") + 1
        near = lambda a: F.abs(a - x.try_cast("double")) < 1e-9
        return F.exists(allowed, lambda v: near(F.element_at(F.array(*[F.bround(v, k) for k in range(PLACES)], v), at)) | near(v))

    return F.filter(printed, lambda x: ~known(x))


def redact(value: Column, kind: DataType, secrets: list[str]) -> Column:
    """value with every secret in its strings masked, however deep in structs, arrays and maps' values these stand; keys stay.

    Secrets under six characters are left alone, for they would mask plain words.
    """
    hidden = [s for s in secrets if len(s) >= SECRET_LEAST]
    if isinstance(kind, StringType):
        return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(REDACTED)), hidden, value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redact(v, kind.elementType, secrets))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: redact(v, kind.valueType, secrets))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[redact(value[f.name], f.dataType, secrets).alias(f.name) for f in kind.fields]))
    return value


def redact_rows(rows: DataFrame, secrets: list[str]) -> DataFrame:
    """rows with every secret in any column masked."""
    return rows.select(*[redact(F.col(f"`{f.name}`"), f.dataType, secrets).alias(f.name) for f in rows.schema.fields])


def banned_words(prose: Column) -> Column:
    """Stems that the text uses at the beginning of a word, in their order."""
    found = F.array_compact(F.array(*[F.when(prose.rlike(rf"(?i)\b{w}"), F.lit(w)) for w in BANNED]))
    return F.when(prose.rlike(rf"(?i)\b(?:{'|'.join(BANNED)})"), found).when(prose.isNotNull(), F.array().cast("array<string>"))
