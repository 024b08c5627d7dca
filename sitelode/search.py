"""Search positions: low-ranking queries, gaps against a competitor, opportunities, trends of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table

#: Position that stands for a query which is not ranked.
UNRANKED = 101
# Content types by words of a query; the first that fits counts.
TYPES = [("comparison", "vs|compare"), ("tutorial", "how to|guide"), ("faq", "what is|faq"), ("product", "buy|price")]


def positions(spark, sf_dir: str) -> DataFrame:
    """query, day, source, clicks, impressions, position, derived from orders and their customers."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.element_at(F.array(F.lit("how to "), F.lit("buy "), F.lit("what is "), F.lit("a vs b "), F.lit("")), (F.col("o_custkey") % 5 + 1).cast("int")), F.lit("topic "), (F.col("o_custkey") % 60).cast("string")).alias("query"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("day"),
        F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_custkey") % 60 >= 20), "bing").otherwise("gsc").alias("source"),
        (F.col("o_orderkey") % 50).cast("long").alias("clicks"),
        (F.col("o_orderkey") % 997).cast("long").alias("impressions"),
        (F.col("o_orderkey") % 40 + 1).cast("double").alias("position"),
    )


_P = """p AS (SELECT ['how to ', 'buy ', 'what is ', 'a vs b ', ''][o_custkey % 5 + 1] || 'topic ' || o_custkey % 60 AS query, CAST(date_trunc('month', o_orderdate) AS DATE) AS day,
  CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 60 >= 20 THEN 'bing' ELSE 'gsc' END AS source, o_orderkey % 50 AS clicks, o_orderkey % 997 AS impressions, CAST(o_orderkey % 40 + 1 AS DOUBLE) AS position FROM orders)"""


@query("query_positions_low", f"WITH {_P} SELECT query, round(avg(position), 6) AS position, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, CASE WHEN sum(impressions) > 0 THEN round(100.0 * sum(clicks) / sum(impressions), 6)::DOUBLE ELSE 0 END AS ctr FROM p WHERE position BETWEEN 11 AND 30 GROUP BY query")
def query_positions_low(spark, sf_dir, least=11, most=30):
    rows = positions(spark, sf_dir).where(F.col("position").between(least, most)).groupBy("query").agg(F.round(F.avg("position"), 6).alias("position"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return rows.withColumn("ctr", F.when(F.col("impressions") > 0, F.round(100.0 * F.col("clicks") / F.col("impressions"), 6)).otherwise(0.0))


def score(impressions: Column, position: Column) -> Column:
    """Ten times the decimal logarithm of impressions, and what is left to position 20; minus infinity without impressions."""
    volume = F.when(impressions == 0, F.lit(float("-inf"))).otherwise(F.log10(impressions.cast("double")) * 10)
    return volume + F.greatest(F.lit(20.0) - position, F.lit(0.0))


def gain(impressions: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(impressions * F.lit(0.30)) - F.floor(impressions * F.lit(0.05))).cast("long")


def content_type(q: Column) -> Column:
    out = F
    for name, marks in TYPES:
        out = out.when(F.lower(q).rlike(marks), F.lit(name))
    return out.otherwise("post")


_best = "b AS (SELECT query, source, arg_min(impressions, struct_pack(p := position, d := day, i := impressions)) AS impressions, round(avg(position), 3) AS position FROM p WHERE impressions > 0 GROUP BY query, source)"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '{m}') THEN '{n}'" for n, m in TYPES) + " ELSE 'post' END"
_SCORE = "round(log10(CAST(impressions AS DOUBLE)) * 10 + greatest(20.0 - position, 0.0), 6)"
_GAIN = "greatest(0, floor(impressions * CAST(0.30 AS DOUBLE)) - floor(impressions * CAST(0.05 AS DOUBLE)))::BIGINT"


def _each(spark, sf_dir):
    rows = positions(spark, sf_dir).where("impressions > 0")
    return rows.groupBy("query", "source").agg(F.min_by("impressions", F.struct("position", "day", "impressions")).alias("impressions"), F.round(F.avg("position"), 3).alias("position"))


def _scored(rows):
    i, p, q = F.col("impressions"), F.col("position"), F.col("query")
    return rows.select("query", F.round(score(i, p), 6).alias("score"), gain(i).alias("gain"), content_type(q).alias("content_type"))


@query("content_gaps", f"WITH {_P}, {_best} SELECT query, {_SCORE} AS score, {_GAIN} AS gain, {_TYPE} AS content_type FROM b WHERE source = 'gsc' AND query NOT IN (SELECT query FROM b WHERE source = 'bing')")
def content_gaps(spark, sf_dir):
    """Queries that the first source ranks for and the second doesn't."""
    rows = _each(spark, sf_dir)
    return _scored(rows.where("source = 'gsc'").join(rows.where("source = 'bing'").select("query"), "query", "left_anti"))


@query("opportunities", f"WITH {_P}, {_best} SELECT query, {_SCORE} AS score, {_GAIN} AS gain, {_TYPE} AS content_type FROM b WHERE position BETWEEN 6 AND 20")
def opportunities(spark, sf_dir):
    return _scored(_each(spark, sf_dir).where(F.col("position").between(6, 20)))


@query("top_queries", f"WITH {_P} SELECT query, sum(clicks)::BIGINT AS clicks FROM p GROUP BY query ORDER BY clicks DESC, query LIMIT 25")
def top_queries(spark, sf_dir):
    return positions(spark, sf_dir).groupBy("query").agg(F.sum("clicks").alias("clicks")).orderBy(F.desc("clicks"), "query").limit(25)


_MONTHLY = "m AS (SELECT query, day, CASE WHEN min(position) > 30 THEN NULL ELSE min(position) END AS position FROM p GROUP BY query, day), x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY day) - 1 AS i, coalesce(position, 101) AS e FROM m)"


@query(
    "rank_trend",
    f"""WITH {_P}, {_MONTHLY}, t AS (SELECT query, count(*) AS points, arg_min(e, day) AS f, arg_max(e, day) AS l, min(position) AS best, avg(position) AS mean, coalesce(regr_slope(e, i), 0) AS slope, avg(e) AS level FROM x GROUP BY query HAVING count(*) > 1)
    SELECT query, points, CAST(l - f AS INTEGER) AS change, best, round(mean, 6) AS mean, CASE WHEN slope / level < -0.05 THEN 'improving' WHEN slope / level > 0.05 THEN 'declining' ELSE 'stable' END AS direction FROM t""",
)
def rank_trend(spark, sf_dir):
    """By query: points, change from first to last (unranked counts as 101), best and mean position, direction of the slope."""
    m = positions(spark, sf_dir).groupBy("query", "day").agg(F.min("position").alias("p")).withColumn("position", F.when(F.col("p") <= 30, F.col("p")))
    x = m.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy("day")) - 1).withColumn("e", F.coalesce("position", F.lit(float(UNRANKED))))
    t = x.groupBy("query").agg(F.count("*").alias("points"), (F.max_by("e", "day") - F.min_by("e", "day")).cast("int").alias("change"), F.min("position").alias("best"), F.round(F.avg("position"), 6).alias("mean"), (F.coalesce(F.regr_slope("e", "i"), F.lit(0.0)) / F.avg("e")).alias("s"))
    direction = F.when(F.col("s") < -0.05, "improving").when(F.col("s") > 0.05, "declining").otherwise("stable")
    return t.where("points > 1").withColumn("direction", direction).drop("s")


# Words that an article of each type should have, and its sections: heading, words, points. {q} is the query.
WORDS = {"post": 2000, "comparison": 2500, "tutorial": 1800, "faq": 1500, "product": 800, "landing": 1200}
SECTIONS = {
    "comparison": [
        ("What is {q}?", 300, ["Definition and overview", "Key characteristics", "Common use cases"]),
        ("Comparison Criteria", 400, ["Effectiveness", "Safety profile", "Cost"]),
        ("Results and Analysis", 500, ["Research findings", "User experiences", "Expert opinions"]),
        ("Conclusion", 300, ["Summary of findings", "Recommendations"]),
    ],
    "tutorial": [
        ("Getting Started", 200, ["Prerequisites", "Equipment needed"]),
        ("Step-by-Step Guide", 800, ["Step 1: Preparation", "Step 2: Procedure", "Step 3: Storage"]),
        ("Safety Considerations", 300, ["Handling precautions", "Storage requirements"]),
    ],
    "other": [
        ("Overview", 300, ["What is it?", "Key benefits"]),
        ("How It Works", 500, ["Mechanism of action", "Research evidence"]),
        ("Dosage and Administration", 400, ["Recommended dosage", "Administration method"]),
        ("Safety and Side Effects", 300, ["Known side effects", "Contraindications"]),
    ],
}


def outline(rows: DataFrame) -> DataFrame:
    """``rows`` (query, content_type) with title, meta_description, words and sections (heading, words, points) of an article."""
    q, kind = F.col("query"), F.col("content_type")
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    title = F.array_join(F.transform(F.filter(F.split(q, r"\s+"), lambda w: w != ""), word), " ")

    def parts(name: str) -> Column:
        made = [F.struct(F.replace(F.lit(h), F.lit("{q}"), q).alias("heading"), F.lit(n).alias("words"), F.array(*[F.lit(p) for p in points]).alias("points")) for h, n, points in SECTIONS[name]]
        return F.array(*made)

    return rows.select(
        "query",
        "content_type",
        F.concat(title, F.lit(": Complete Guide")).alias("title"),
        F.concat(F.lit("Comprehensive guide to "), F.lower(q), F.lit(". Learn everything you need to know about "), F.lower(q), F.lit(".")).alias("meta_description"),
        F.create_map(*[F.lit(x) for p in WORDS.items() for x in p])[kind].alias("words"),
        F.when(kind == "comparison", parts("comparison")).when(kind == "tutorial", parts("tutorial")).otherwise(parts("other")).alias("sections"),
    )


_HEADS = """CASE content_type WHEN 'comparison' THEN ['What is ' || query || '?|300|3', 'Comparison Criteria|400|3', 'Results and Analysis|500|3', 'Conclusion|300|2']
  WHEN 'tutorial' THEN ['Getting Started|200|2', 'Step-by-Step Guide|800|3', 'Safety Considerations|300|2']
  ELSE ['Overview|300|2', 'How It Works|500|2', 'Dosage and Administration|400|2', 'Safety and Side Effects|300|2'] END"""


@query(
    "outlines",
    f"""WITH {_P}, {_best}, o AS (SELECT query, {_TYPE} AS content_type FROM b WHERE source = 'gsc' AND query NOT IN (SELECT query FROM b WHERE source = 'bing'))
    SELECT query, array_to_string(list_transform(list_filter(string_split(query, ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') || ': Complete Guide' AS title,
    'Comprehensive guide to ' || lower(query) || '. Learn everything you need to know about ' || lower(query) || '.' AS meta_description,
    CASE content_type WHEN 'post' THEN 2000 WHEN 'comparison' THEN 2500 WHEN 'tutorial' THEN 1800 WHEN 'faq' THEN 1500 ELSE 800 END AS words, array_to_string({_HEADS}, '; ') AS sections FROM o""",
)
def outlines(spark, sf_dir):
    """Outlines of articles for the gaps, their sections as heading, words and number of points."""
    rows = outline(content_gaps(spark, sf_dir))
    text = F.transform("sections", lambda s: F.concat_ws("|", s["heading"], s["words"].cast("string"), F.size(s["points"]).cast("string")))
    return rows.select("query", "title", "meta_description", "words", F.array_join(text, "; ").alias("sections"))


def bare_host(target: Column) -> Column:
    """Host of a URL or of a bare domain, lower case, without ``www.`` and a dot at the end; null where there is none."""
    t = F.trim(target)
    host = F.when(t.contains("://"), F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).otherwise(F.regexp_extract(t, r"^([^/?#]*)", 1))
    clean = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.+$", "")
    return F.when((clean != "") & ~clean.rlike(r"\s"), clean)


def check_keywords(results: DataFrame, targets: DataFrame) -> DataFrame:
    """``results`` (keyword, position, url) for ``targets`` (keyword, target): position and url of the first result of the target's host, else of the first whose URL has the target in it; nulls without one."""
    met = targets.join(results, "keyword", "left")
    same = F.coalesce(bare_host(F.col("url")) == bare_host(F.col("target")), F.lit(False))
    part = F.coalesce(F.lower("url").contains(F.lower("target")), F.lit(False))
    rank = F.when(same, 0).when(part, 1)
    best = met.groupBy("keyword", "target").agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "position", "url"))).alias("best"))
    return best.select("keyword", "target", "best.position", "best.url")


_RESULTS = "s AS (SELECT 'topic ' || page_id % 20 AS keyword, CAST(row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id) AS INTEGER) AS position, url FROM pages), g AS (SELECT 'topic ' || i AS keyword, ['www.example.com', 'HTTPS://M.EXAMPLE.COM/x', '/page', 'nowhere.test', 'blog.'][i % 5 + 1] AS target FROM range(0, 22) AS t(i))"
_BARE = r"regexp_replace(regexp_replace(lower(CASE WHEN contains({0}, '://') THEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) ELSE regexp_extract({0}, '^([^/?#]*)', 1) END), '^www\.', ''), '\.+$', '')"


@query(
    "keyword_check",
    f"""WITH {_RESULTS}, m AS (SELECT keyword, target, position, url, CASE WHEN nullif({_BARE.format('url')}, '') = nullif({_BARE.format('target')}, '') THEN 0 WHEN contains(lower(url), lower(target)) THEN 1 END AS rank FROM g LEFT JOIN s USING (keyword))
    SELECT keyword, target, arg_min(position, rank * 100000 + position) FILTER (rank IS NOT NULL) AS position, arg_min(url, rank * 100000 + position) FILTER (rank IS NOT NULL) AS url FROM m GROUP BY keyword, target""",
)
def keyword_check(spark, sf_dir):
    """Where targets stand in result lists; pages in order of their number are the results of twenty keywords."""
    order = Window.partitionBy(F.col("page_id") % 20).orderBy("page_id")
    results = table(spark, sf_dir, "pages").select(F.concat(F.lit("topic "), (F.col("page_id") % 20).cast("string")).alias("keyword"), F.row_number().over(order).alias("position"), "url")
    marks = F.element_at(F.array(*[F.lit(x) for x in ("www.example.com", "HTTPS://M.EXAMPLE.COM/x", "/page", "nowhere.test", "blog.")]), (F.col("id") % 5 + 1).cast("int"))
    return check_keywords(results, spark.range(22).select(F.concat(F.lit("topic "), F.col("id").cast("string")).alias("keyword"), marks.alias("target")))


@query("positions_recorded", f"WITH {_P} SELECT query, day, source, arg_max(position, (impressions, clicks, position)) AS position, max(impressions) AS impressions FROM p GROUP BY query, day, source")
def positions_recorded(spark, sf_dir):
    """Both sources' rows in one table, one for each query, day and source: of several the one with most impressions, then clicks, stays."""
    rows = positions(spark, sf_dir)
    both = rows.where("source = 'gsc'").unionByName(rows.where("source = 'bing'"))
    return both.groupBy("query", "day", "source").agg(F.max_by("position", F.struct("impressions", "clicks", "position")).alias("position"), F.max("impressions").alias("impressions"))


@query("rank_history", f"WITH {_P}, l AS (SELECT max(day) AS last FROM p) SELECT query, day, min(position) AS position FROM p, l WHERE day > last - INTERVAL 90 DAY GROUP BY query, day")
def rank_history(spark, sf_dir, days=90):
    """Best position of each query and day within so many days of the last one."""
    rows = positions(spark, sf_dir)
    last = rows.agg(F.max("day").alias("last"))
    near = rows.crossJoin(F.broadcast(last)).where(F.col("day") > F.date_sub("last", days))
    return near.groupBy("query", "day").agg(F.min("position").alias("position"))


def metric_sum(reports: DataFrame, index: int) -> DataFrame:
    """``reports`` (report, values: array of texts): the sum of the numbers at ``index``; what is no number counts nothing."""
    return reports.groupBy("report").agg(F.coalesce(F.sum(F.try_element_at("values", F.lit(index + 1)).try_cast("double")), F.lit(0.0)).alias("total"))


@query("analytics_sums", "SELECT event_type AS report, coalesce(sum(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 100 END), 0)::DOUBLE AS total FROM events GROUP BY event_type")
def analytics_sums(spark, sf_dir):
    """Second metric of report rows made of events; one in seven is no number."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("report"), F.array(F.lit("1"), F.when(e % 7 == 0, "(not set)").otherwise((e % 100).cast("string"))).alias("values"))
    return metric_sum(rows, 1)
