"""Queries on names, prose, pages and printed amounts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khata.functions import calendar as cal
from khata.functions import money, text
from khata.operators import narrative, resolve, search, variance
from khata.oracle import M, SUMMARY, fy, with_parts
from khata.plans import fiscal_queries as fiscal
from khata.plans import projection as p
from khata.sources import sinks, web

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def grams(name: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({name}), '[^a-z0-9]+'), lambda w: w != '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


PARTS = f"WITH part_name AS (SELECT 'part-' || min(p_partkey) AS entity_id, p_name AS name FROM part GROUP BY p_name), g AS (SELECT *, {grams('name')} AS t FROM part_name)"


def part_names(spark, sf_dir) -> DataFrame:
    return p.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("part-"), F.min("p_partkey").cast("string")).alias("entity_id"))


@query(PARTS + """, s AS (SELECT a.name, b.entity_id, len(list_intersect(a.t, b.t)) AS n, len(a.t) AS x, len(b.t) AS y FROM g a JOIN g b ON TRUE),
    r AS (SELECT name, entity_id, CAST(n AS DOUBLE) / (x + y - n) AS similarity FROM s WHERE CAST(n AS DOUBLE) / (x + y - n) >= 0.35)
    SELECT name, entity_id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY name ORDER BY similarity DESC, entity_id) AS INTEGER) AS place FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, entity_id) <= 8""")
def trigram_candidates(spark, sf_dir) -> DataFrame:
    """For every part name the eight most similar names, itself included."""
    names = part_names(spark, sf_dir)
    return resolve.candidates(names, names).select("name", "entity_id", F.round("similarity", 6).alias("similarity"), "place")


@query("""WITH n AS (SELECT DISTINCT lower(array_to_string(list_reverse(string_split(p_name, ' ')), ' ')) AS name FROM part), e AS (SELECT 'part-' || min(p_partkey) AS entity_id, p_name FROM part GROUP BY p_name),
    t AS (SELECT name, list_distinct(string_split(name, ' ')) AS a FROM n), u AS (SELECT entity_id, lower(p_name) AS norm, list_distinct(string_split(lower(p_name), ' ')) AS b FROM e),
    s AS (SELECT name, entity_id, CASE WHEN name = norm THEN 2.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS score FROM t JOIN u ON TRUE),
    best AS (SELECT name, entity_id, score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, entity_id) = 1)
    SELECT n.name, entity_id, CASE WHEN score = 2 THEN 'high' WHEN score IS NOT NULL THEN 'medium' ELSE 'none' END AS match FROM n LEFT JOIN best ON n.name = best.name""")
def match_names(spark, sf_dir) -> DataFrame:
    """Part names with their words turned round, matched by words."""
    turned = p.table(spark, sf_dir, "part").select(F.lower(F.array_join(F.reverse(F.split("p_name", " ")), " ")).alias("name")).distinct()
    return resolve.match_tokens(turned, part_names(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT lower(array_to_string(list_reverse(string_split(p_name, ' ')), ' ')) AS name FROM part), e AS (SELECT 'part-' || min(p_partkey) AS entity_id, p_name FROM part GROUP BY p_name),
    t AS (SELECT name, list_distinct(string_split(name, ' ')) AS a FROM n), u AS (SELECT entity_id, p_name, list_distinct(string_split(lower(p_name), ' ')) AS b FROM e),
    s AS (SELECT name, entity_id, p_name, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS score FROM t JOIN u ON TRUE)
    SELECT name, entity_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, p_name, entity_id) AS INTEGER) AS place FROM s WHERE score >= 0.34
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, p_name, entity_id) <= 5""")
def suggested_names(spark, sf_dir) -> DataFrame:
    """Part names with their words turned round, and the five names whose words are most like theirs."""
    turned = p.table(spark, sf_dir, "part").select(F.lower(F.array_join(F.reverse(F.split("p_name", " ")), " ")).alias("name")).distinct()
    return resolve.best_matches(turned, part_names(spark, sf_dir)).select("name", "entity_id", F.round("score", 6).alias("score"), "place")


@query("""WITH i AS (SELECT 'min-' || n_nationkey AS entity_id, 'ministry' AS kind, n_name AS title, r_name AS extra FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'part-' || p_partkey, 'part', p_name, p_type || ' ' || p_brand FROM part),
    w AS (SELECT *, regexp_split_to_array(lower(title), '[^a-z0-9]+') AS a, regexp_split_to_array(lower(extra), '[^a-z0-9]+') AS b FROM i)
    SELECT entity_id, kind, title, CAST(CASE WHEN list_contains(a, 'small') THEN 4 WHEN list_contains(b, 'small') THEN 2 ELSE 0 END + CASE WHEN list_contains(a, 'gear') THEN 4 WHEN list_contains(b, 'gear') THEN 2 ELSE 0 END AS INTEGER) AS score
    FROM w WHERE (list_contains(a, 'small') OR list_contains(b, 'small')) AND (list_contains(a, 'gear') OR list_contains(b, 'gear'))""")
def search_entities(spark, sf_dir) -> DataFrame:
    """Entities whose title or description has all the words asked for, titles weighing twice."""
    nations = p.ministries(spark, sf_dir).select(F.col("ministry_id").alias("entity_id"), F.lit("ministry").alias("kind"), F.col("name").alias("title"), F.col("sector").alias("extra"))
    goods = p.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("part").alias("kind"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("extra"))
    return search.find(nations.union(goods), ["small", "gear"])


DATES = "January|February|March|April|May|June|July|August|September|October|November|December"
BARE = r"regexp_replace(regexp_replace(text, '(?i)\[(?:source|tender|evidence):[^\]]*\]', ' ', 'g'), '(?i)\bFY[0-9]{4}\b', ' ', 'g')"
BARE = rf"regexp_replace({BARE}, '(?i)\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b|\b[0-9]{{1,2}}\s+(?:{DATES})\s+[0-9]{{4}}\b|\b(?:{DATES})\s+[0-9]{{4}}\b|\b[0-9]{{4}}-[0-9]{{2}}\b', ' ', 'g')"
BARE = rf"regexp_replace({BARE}, '(?i)\bQ[1-4]\b', ' ', 'g')"


@query(rf"""SELECT doc_id, len(regexp_extract_all({BARE}, '[-+]?[0-9]{{1,3}}(?:,[0-9]{{2,3}})+(?:\.[0-9]+)?|[-+]?[0-9]+(?:\.[0-9]+)?')) AS n_figures FROM documents""")
def figures_in_prose(spark, sf_dir) -> DataFrame:
    """How many figures every document states, apart from dates, years and citations."""
    return p.table(spark, sf_dir, "documents").select("doc_id", F.size(text.figures(F.col("text"))).cast("long").alias("n_figures"))


@query("SELECT doc_id, " + " + ".join(rf"CAST(regexp_matches(text, '(?i)\b{w}') AS INTEGER)" for w in text.BANNED) + " AS n_banned FROM documents")
def banned_vocabulary(spark, sf_dir) -> DataFrame:
    """How many of the words that published prose may not use each document has."""
    return p.table(spark, sf_dir, "documents").select("doc_id", F.size(text.banned_words(F.col("text"))).alias("n_banned"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, q WHERE vec_id != 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 12""")
def similar_evidence(spark, sf_dir) -> DataFrame:
    """The twelve rows nearest to one by cosine."""
    rows = p.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("v")))
    scored = rows.where("vec_id != 0").join(one).select("vec_id", text.cosine(F.col("embedding"), F.col("v")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(12).select("vec_id", F.round("s", 6).alias("similarity"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_replace(url, '(?i)([?&](?:api[-_]?key|key|token|access_token)=)[^&#]*', '\1REDACTED', 'g') AS url,
        regexp_matches(url, '^https?://') AND contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') AND NOT contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '@') AND NOT regexp_matches(url, '(?i)captcha|j_security_check|/login|/signin|/sign-in|/logon|/auth/|sso') AS is_public,
        CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1)) AS INTEGER) AS n_links, sha256(html) AS sha256 FROM pages""")
def page_index(spark, sf_dir) -> DataFrame:
    """Every page's host, address without secrets, links and digest."""
    url = F.col("url")
    return p.table(spark, sf_dir, "pages").select("page_id", web.host_of(url).alias("host"), web.redacted(url).alias("url"), web.is_public(url).alias("is_public"), F.size(web.links(F.col("html"))).alias("n_links"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query("""SELECT doc_id, CASE WHEN length(text) > 0 THEN 'raw/' || source || '/2024/01/' || sha256(text) || '.txt' END AS key, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) > 1 AS is_repeat FROM documents""")
def content_addresses(spark, sf_dir) -> DataFrame:
    """The place of every document by its digest, and whether its source has stored it before."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    rows = p.table(spark, sf_dir, "documents").select("doc_id", "source", digest.alias("digest"), web.content_key(F.col("source"), F.col("text"), F.lit("2024-01-15").cast("date"), F.lit("txt")).alias("key"))
    first = rows.groupBy("source", "digest").agg(F.min("doc_id").alias("first"))
    return rows.join(first, ["source", "digest"]).select("doc_id", "key", (F.col("doc_id") > F.col("first")).alias("is_repeat"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN 'error' WHEN o_orderkey % 6 = 4 THEN 'not_reported' ELSE 'value' END AS status, CASE WHEN o_orderkey % 6 = 3 THEN 'percentage' END AS reason,
        CAST(CASE o_orderkey % 6 WHEN 0 THEN v WHEN 1 THEN CAST(round(CAST(v AS DECIMAL(24,6)) * 0.01, 2) AS DECIMAL(20,2)) WHEN 2 THEN -v WHEN 5 THEN v * 100000 END AS DOUBLE) AS value
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS v FROM orders)""")
def amounts_as_printed(spark, sf_dir) -> DataFrame:
    """Order totals printed in several ways, read back."""
    v, k = F.col("o_totalprice").cast("decimal(20,2)"), F.col("o_orderkey") % 6
    whole = money.group_indian(v)
    printed = F.when(k == 0, F.concat(F.lit("₹ "), whole, F.lit(" Crore"))).when(k == 1, F.concat(whole, F.lit(" lakhs"))).when(k == 2, F.concat(F.lit("("), v.cast("string"), F.lit(")"))).when(k == 3, F.concat(v.cast("string"), F.lit(" %"))).when(k == 4, F.lit(" - ")).otherwise(F.concat(F.lit("Rs. "), v.cast("string"), F.lit(" lakh crore")))
    rows = p.table(spark, sf_dir, "orders").select("o_orderkey", money.parse_crore(printed, F.lit("in crore")).alias("p"))
    return rows.select("o_orderkey", "p.status", "p.reason", F.col("p.value").cast("double").alias("value"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_totalprice AS DECIMAL(24,6)) AS v, (o_orderkey % 20) / 20.0 AS confidence FROM orders),
    r AS (SELECT o_orderkey, confidence, CASE k WHEN 0 THEN CAST(v AS DECIMAL(20,2)) WHEN 1 THEN CAST(round(v * 0.01, 2) AS DECIMAL(20,2)) END AS amount, CASE k WHEN 2 THEN 'no unit stated' WHEN 3 THEN 'no figure' WHEN 4 THEN 'percentage' END AS reason FROM v)
    SELECT o_orderkey, CAST(amount AS DOUBLE) AS amount, reason, amount IS NULL OR confidence < 0.85 AS needs_review FROM r""")
def extractions_for_review(spark, sf_dir) -> DataFrame:
    """Order totals as figures that were read off a page, with the unit that it states and a confidence: their amounts, and which of them a human must see."""
    k, v = F.col("o_orderkey") % 5, F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    cell = F.when(k == 3, "n.a.").when(k == 4, F.concat(v, F.lit("%"))).otherwise(v)
    unit = F.when(k == 1, "lakh").when(k == 2, "unstated").otherwise("crore")
    read = money.reviewed(cell, unit, (F.col("o_orderkey") % 20) / 20)
    return p.table(spark, sf_dir, "orders").select("o_orderkey", read.alias("r")).select("o_orderkey", F.col("r.amount").cast("double").alias("amount"), "r.reason", "r.needs_review")


W = "CAST(floor(abs(v)) AS BIGINT)"


@query(f"""SELECT c_custkey, '₹' || CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN {W} >= 10000000 THEN ({W} // 10000000) || ',' || printf('%02d,%02d,%03d', {W} // 100000 % 100, {W} // 1000 % 100, {W} % 1000)
        WHEN {W} >= 100000 THEN ({W} // 100000) || ',' || printf('%02d,%03d', {W} // 1000 % 100, {W} % 1000) WHEN {W} >= 1000 THEN ({W} // 1000) || ',' || printf('%03d', {W} % 1000) ELSE CAST({W} AS VARCHAR) END || '.' || right(CAST(v AS VARCHAR), 2) || ' cr' AS shown
    FROM (SELECT c_custkey, CAST(c_acctbal AS {M}) * 137 AS v FROM customer)""")
def indian_format(spark, sf_dir) -> DataFrame:
    """Balances in Indian grouping."""
    return p.table(spark, sf_dir, "customer").select("c_custkey", money.format_crore((F.col("c_acctbal").cast("decimal(20,2)") * 137).cast("decimal(24,2)")).alias("shown"))


@query(f"""SELECT o_orderkey, {fy('o_orderdate')} AS fy, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, last_day(CAST(o_orderdate AS DATE)) AS last, FALSE AS cumulative FROM orders""")
def periods_as_printed(spark, sf_dir) -> DataFrame:
    """Order months printed as labels, read back."""
    label = F.date_format("o_orderdate", "MMMM, yyyy")
    rows = p.table(spark, sf_dir, "orders").select("o_orderkey", cal.period_of(label).alias("p"))
    return rows.select("o_orderkey", cal.fy_of(F.col("p.end")).alias("fy"), F.col("p.start").alias("first"), F.col("p.end").alias("last"), F.col("p.cumulative").alias("cumulative"))


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {fy('o_orderdate')} AS fy FROM orders)
    SELECT o_orderkey, CAST(date_trunc('month', CASE WHEN o_orderkey % 2 = 0 THEN make_date(CAST(substr(fy, 3) AS INTEGER) - 1, 4, 1) ELSE d END) AS DATE) AS first, last_day(d) AS last, o_orderkey % 2 = 0 AS cumulative,
        'FY' || substr(fy, 5) AS short, fy || ' (Apr ' || (CAST(substr(fy, 3) AS INTEGER) - 1) || ' to Mar ' || substr(fy, 3) || ')' AS span, strftime(d, '%b %Y') AS month FROM o""")
def periods_of_years(spark, sf_dir) -> DataFrame:
    """Months and spans of months that name a pair of years, read back, and the labels of an order's year and month."""
    day = F.to_date("o_orderdate")
    year = cal.fy_of(day)
    label = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "April – ").otherwise(""), F.date_format(day, "MMMM"), F.lit(" "), cal.long_label(year))
    rows = p.table(spark, sf_dir, "orders").select("o_orderkey", cal.period_of(label).alias("p"), cal.short_label(year).alias("short"), cal.span_label(year).alias("span"), cal.month_label(day).alias("month"))
    return rows.select("o_orderkey", F.col("p.start").alias("first"), F.col("p.end").alias("last"), "p.cumulative", "short", "span", "month")


@query(with_parts("run") + """, n AS (SELECT source_id, max(started_at) AS newest FROM run GROUP BY 1),
    h AS (SELECT run_id, CASE WHEN status = 'ok' THEN (epoch_us(newest) - epoch_us(started_at)) / 3600000000.0 END AS h FROM run JOIN n USING (source_id)),
    d AS (SELECT run_id, h, CAST(floor(h / 24) AS BIGINT) AS d FROM h)
    SELECT run_id, CASE WHEN h IS NULL THEN 'Not yet fetched' WHEN h < 1 THEN 'Within the hour' WHEN h < 24 THEN CAST(floor(h) AS BIGINT) || 'h ago' WHEN d = 1 THEN 'Yesterday' WHEN d < 30 THEN d || ' days ago' WHEN d // 30 = 1 THEN 'Last month' ELSE (d // 30) || ' months ago' END AS age FROM d""")
def ages_in_words(spark, sf_dir) -> DataFrame:
    """How long before the newest run of its source each good run was; of others nothing was fetched."""
    runs = p.pipeline_runs(spark, sf_dir)
    newest = runs.groupBy("source_id").agg(F.max("started_at").alias("newest"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = F.when(F.col("status") == "ok", (micros("newest") - micros("started_at")) / F.lit(3600000000.0))
    return runs.join(newest, "source_id").select("run_id", cal.age_label(hours).alias("age"))


@query(
    "SELECT o_orderkey, o_orderkey || chr(44) || CASE WHEN o_orderkey % 3 = 0 THEN chr(39) || chr(61) || o_orderpriority "
    "WHEN o_orderkey % 3 = 1 THEN chr(34) || o_orderpriority || chr(44) || chr(32) || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) ELSE 'Not reported' END AS line FROM orders"
)
def csv_export(spark, sf_dir) -> DataFrame:
    """Rows as safe CSV lines."""
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, F.concat(F.lit("="), "o_orderpriority")).when(k % 3 == 1, F.concat(F.col("o_orderpriority"), F.lit(', "x"')))
    return p.table(spark, sf_dir, "orders").select("o_orderkey", sinks.csv_line(k, cell).alias("line"))


@query("""SELECT day, bool_or(f) AS has_flags, bool_or(NOT f) AS has_evidence FROM (
        SELECT DISTINCT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, TRUE AS f FROM events WHERE event_type = 'error' UNION SELECT DISTINCT CAST(ts AS DATE), FALSE FROM events WHERE event_type = 'signup') GROUP BY 1""")
def digest_days(spark, sf_dir) -> DataFrame:
    """Days of the digest: flags by the day in India, evidence by its own date."""
    events = p.table(spark, sf_dir, "events")
    flags = events.where("event_type = 'error'").select(cal.digest_day(F.col("ts")).alias("day"), F.lit(True).alias("f")).distinct()
    evidence = events.where("event_type = 'signup'").select(F.to_date("ts").alias("day"), F.lit(False).alias("f")).distinct()
    return flags.union(evidence).groupBy("day").agg(F.bool_or("f").alias("has_flags"), F.bool_or(~F.col("f")).alias("has_evidence"))


@query(with_parts("tender") + f"""SELECT {fy('published')} AS fy, ministry_id, o_orderkey, CAST(value AS DOUBLE) AS value, CAST(row_number() OVER w AS INTEGER) AS place FROM tender
    WINDOW w AS (PARTITION BY {fy('published')}, ministry_id ORDER BY value DESC NULLS LAST, o_orderkey) QUALIFY row_number() OVER w <= 10""")
def largest_tenders(spark, sf_dir) -> DataFrame:
    """The ten largest tenders of every ministry and year."""
    rows = p.tenders(spark, sf_dir).withColumn("fy", cal.fy_of(F.col("published")))
    place = F.row_number().over(Window.partitionBy("fy", "ministry_id").orderBy(F.col("value").desc_nulls_last(), "o_orderkey"))
    return rows.withColumn("place", place).where("place <= 10").select("fy", "ministry_id", "o_orderkey", F.col("value").cast("double").alias("value"), "place")


@query(SUMMARY + f""", s AS (SELECT fy, ministry_id, unnest([struct_pack(step := 1, name := 'be', delta := be), struct_pack(step := 2, name := 'revision', delta := CAST(re - be AS {M})), struct_pack(step := 3, name := 'supplementary', delta := CAST(coalesce(supplementary, 0) AS {M})),
        struct_pack(step := 4, name := 'spent', delta := CAST(-spent AS {M}))], recursive := true) FROM summary),
    t AS (SELECT *, CASE WHEN max(CASE WHEN delta IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN sum(delta) OVER w END AS after FROM s WINDOW w AS (PARTITION BY fy, ministry_id ORDER BY step))
    SELECT fy, ministry_id, step, name, CAST(delta AS DOUBLE) AS delta, CAST(after - delta AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after FROM t""")
def allocation_waterfall(spark, sf_dir) -> DataFrame:
    """From budget over revision to balance; unknown from the first unknown step on."""
    rows = variance.waterfall(fiscal.summary_of(spark, sf_dir))
    return rows.select("fy", "ministry_id", "step", "name", *[F.col(c).cast("double").alias(c) for c in ("delta", "before", "after")])


@query(fiscal.FLAGS + """SELECT fy, entity_id, rule_id, severity FROM flags WHERE metric IS NOT NULL ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, fy DESC, rule_id, entity_id LIMIT 50""")
def flags_page(spark, sf_dir) -> DataFrame:
    """The first fifty flags, high ones first."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "notable", 1).otherwise(2)
    return fiscal.flags_of(spark, sf_dir).where("metric is not null").orderBy(rank, F.desc("fy"), "rule_id", "entity_id").limit(50).select("fy", "entity_id", "rule_id", "severity")


TOLD = with_parts("ministry", "auth", "spent", "facts0", "current", "authority", "to_date", "summary", "tender")


def said(label: str, column: str) -> str:
    return f"coalesce('{label} ' || CAST({column} AS VARCHAR) || ' crore.', '{label} not reported.')"


@query(TOLD + f""", c AS (SELECT {fy('published')} AS fy, ministry_id, count(*) AS n FROM tender GROUP BY 1, 2)
    SELECT s.fy, s.ministry_id, name || ', ' || s.fy || ': ' || {said('Authority', 'authority')} || ' ' || {said('Spent', 'spent')} || ' ' || {said('Balance', 'balance')} || ' Tenders: ' || coalesce(n, 0) || '.' AS narrative, 0 AS problems
    FROM summary s JOIN ministry m ON s.ministry_id = m.ministry_id LEFT JOIN c ON c.fy = s.fy AND c.ministry_id = s.ministry_id""")
def narratives(spark, sf_dir) -> DataFrame:
    """Plain sentences on every ministry and year, and how many problems the check finds in them."""
    rows = narrative.bundles(fiscal.summary_of(spark, sf_dir), p.tenders(spark, sf_dir), cal.fy_of(F.col("published"))).join(F.broadcast(p.ministries(spark, sf_dir)), "ministry_id")
    named = F.concat("allowed", F.transform(text.figures(F.col("name")), lambda x: x.cast("double")))  # a name may hold figures
    told = rows.select("fy", "ministry_id", named.alias("allowed"), narrative.fallback(rows).alias("narrative"))
    return told.select("fy", "ministry_id", "narrative", F.size(narrative.problems(F.col("narrative"), F.col("allowed"))).alias("problems"))


@query(fiscal.FLAGS + """SELECT fy, string_agg('- ' || severity || ': ' || rule_id || ' (' || entity_id || ')', chr(10) ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, rule_id, entity_id) AS body, count(*) AS flags FROM flags GROUP BY fy""")
def digests(spark, sf_dir) -> DataFrame:
    """Each year's flags as one text, high ones first."""
    return narrative.digest(fiscal.flags_of(spark, sf_dir))
