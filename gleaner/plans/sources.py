"""Queries of the readers of landed inputs, over feeds, blocks and metadata composed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text, urls
from gleaner.operators import select
from gleaner.plans.common import composed, table
from gleaner.sources import feeds as feeds_source
from gleaner.sources import landed
from gleaner.streaming import dedupe as streams

#: Keys whose blocks make one text.
COMPOSED = 1_000
URL_RULES = {"blocked_paths": ["/fr/"], "blocked_hosts": ["spam-farm.example.org"], "blocked_suffixes": ["html"]}


def s2_feed_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries composed of pages and orders' dates, by the first reason against them."""
    p = table(spark, sf_dir, "pages")
    day = F.expr("date_add(date'2024-01-01', cast(page_id % 60 as int))")
    entries = p.select(
        "page_id", F.when(F.col("page_id") % 14 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.col("url").alias("link"), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("summary"),
        F.when(F.col("page_id") % 9 != 0, F.date_format(day, "EEE, dd MMM yyyy 10:00:00 'GMT'")).alias("published"), F.lit(None).cast("string").alias("updated"),
    )
    out = landed.normalize_feed(entries, "2024-01-20", ["the", "que", "die", "les", "of"], ["onre"], URL_RULES)
    return out.groupBy(F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"), F.max("published_date").alias("latest"))


#: Entries of a feed.
FEED_SIZE = 25


def _landed_feeds(spark: SparkSession, sf_dir: str) -> str:
    """Pages as feeds of at most ``FEED_SIZE`` entries by their numbers: every fifth feed is broken, every seventh missing; some of these have a fallback, some a period."""
    p = table(spark, sf_dir, "pages").withColumn("feed", F.floor(F.col("page_id") / FEED_SIZE))
    data = lambda c: F.concat(F.lit("<![CDATA["), F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]|\]\]>", ""), F.lit("]]>"))
    day = F.date_format(F.expr("date_add(date'2024-01-01', cast(page_id % 60 as int))"), "EEE, dd MMM yyyy 10:00:00 'GMT'")
    item = F.concat(F.lit("<item><title>"), data(F.when(F.col("page_id") % 14 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).otherwise("")), F.lit("</title><link>"), data(F.col("url")), F.lit("</link><description>"), data(F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)), F.lit("</description><pubDate>"), day, F.lit("</pubDate></item>"))
    whole = p.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item")))).alias("items"))
    body = F.concat(F.lit("<rss><channel>"), F.array_join("items.item", ""), F.when((F.col("feed") % 5 == 1) & ~F.col("alt"), "</broken>").otherwise("</channel></rss>"))
    texts = whole.withColumn("alt", F.explode(F.array(F.lit(False), F.lit(True)))).where("alt OR feed % 7 <> 3").select(F.concat(F.when(F.col("alt"), "alt-").otherwise("feed-"), "feed").alias("folder"), body.alias("value"))
    bad = (F.col("feed") % 5 == 1) | (F.col("feed") % 7 == 3)
    feeds = whole.select(
        F.col("feed").alias("ord"), F.concat(F.lit("feed-"), "feed").alias("source"), F.concat(F.lit("feed-"), "feed").alias("path"), F.when(bad & (F.col("feed") % 2 == 1), F.concat(F.lit("alt-"), "feed")).alias("fallback"),
        F.when(F.col("feed") % 3 == 0, "2024-Q1").alias("period"), (F.col("feed") % 11 == 4).alias("known_bad"),
    )
    return feeds_source.land(spark, texts, feeds)


def _scan(spark: SparkSession, sf_dir: str) -> feeds_source.Scan:
    rows = feeds_source.read_feeds(spark, _landed_feeds(spark, sf_dir))
    return feeds_source.scan(rows, F.lit("2024-01-20").cast("date"), lambda t: text.contains_any(t, ["the", "que", "die", "les", "of"]), lambda t: text.contains_any(t, ["onre"]), URL_RULES, 8)


def s1_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all feeds with the first reason against them; the first of a title or url wins, whichever feed it is of."""
    return _scan(spark, sf_dir).entries.select("source", "pos", "published_date", "reject")


def s1_feed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of status for each feed: read, by its fallback, or what is wrong with it."""
    return _scan(spark, sf_dir).statuses.drop("message")


def t5_keyed_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which none before has the title or the address, as a stream with keyed state."""
    p = streams.read_landed(spark, f"{sf_dir}/pages.parquet")
    title = text.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return streams.first_wins(p.select(F.col("page_id").alias("ord"), title.alias("title_key"), urls.dedupe_url("url").alias("url_key"))).select(F.col("ord").alias("page_id"))


def s3_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("href"), F.expr("cast(date_add(date'2024-01-01', cast(page_id % 90 as int)) as string)").alias("date"), F.lit(None).cast("string").alias("published"))
    out = landed.normalize_hits(p, "2024-01-10", "2024-02-20", 3, URL_RULES)
    return out.groupBy("domain", F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"), F.min("ingest_id").alias("first_id"))


def s17_block_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines of blocks, composed of customers of a nation: a text for each thousand of keys."""
    block = F.concat(F.lit("== source\nName: "), "c_name", F.lit("\n  Segment : "), "c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("\nBalance:"), F.col("c_acctbal").cast("string"))).otherwise(""), F.lit("\n"))
    texts, before = composed(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", block, "", COMPOSED)
    parsed = landed.parse_blocks(texts, "text", ["c_nationkey", "bucket"], "== source\n", {"name": "Name", "segment": "Segment", "balance": "Balance"})
    return parsed.join(before, ["c_nationkey", "bucket"]).select("c_nationkey", (F.col("pos") + F.col("before")).alias("pos"), "name", "segment", "balance")


def s9_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta contents, JSON-LD and canonical links that pages are given here, read back."""
    p = table(spark, sf_dir, "pages")
    head = F.concat(
        F.lit('<head><meta name="citation_date" content="2024-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('-05"><META property="og:type" content="'), F.when(F.col("page_id") % 2 == 0, "article").otherwise(""),
        F.lit('"><script type="application/ld+json">{"id": '), "page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise("}"), F.lit('</script><link href="'), "url", F.lit('" rel="canonical">'),
    )
    m = landed.page_metadata(p.withColumn("html", F.regexp_replace("html", "<head>", "")).withColumn("html", F.concat(head, "html")), "html", ["citation_date", "og:type"])
    date = landed.metadata_date(F.col("meta"), ["citation_date"])
    return m.select("page_id", date["value"].alias("published"), F.col("meta")["og:type"].alias("kind"), F.get_json_object("json_ld", "$.id").cast("long").alias("ld_id"), (F.col("canonical") == F.col("url")).alias("is_canonical"))


def s12_metadata_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' facts from the first of several tables that has them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("date").alias("day"), F.when(F.count("*") > 2, F.max("l_returnflag")).alias("flag"))
    exact = lines.where("o_orderkey % 3 = 0")
    fallback = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("flag"))
    e = landed.enrich(o, "o_orderkey", [("lines", exact), ("orders", fallback)], ["day", "flag"])
    return e.groupBy(F.coalesce("origin", F.lit("none")).alias("origin"), "flag").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


def r21_best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of a page's menu whose label is nearest to the page's text of the title."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")
    return landed.best_link(landed.anchors(p, "html", ["page_id", "title"]), "page_id", "title", "href", "label", ["xx"], 1)


def q14_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under an even share of 60 for each segment, at most 14 of one: a top-k report."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    shares = select.water_fill(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], 60, 14)
    most = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("c_mktsegment")]
    return select.per_group(c, "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], most)


def f13_fragment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which one sentence has a term of each of two packs."""
    d = table(spark, sf_dir, "documents").select("lang", text.any_fragment("text", ["the", "une", "der"], ["of", "que", "und"]).alias("both"))
    return d.groupBy("lang").agg(F.count_if("both").alias("n_both"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (s1_feed_entries, s1_feed_statuses, t5_keyed_first_wins, s2_feed_normaliser, s3_search_hits, s9_page_metadata, s12_metadata_cascade, s17_block_parser, r21_best_link, q14_water_filling, f13_fragment_gate)}

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
_URL = f"CASE WHEN replace({_PATH}, '/', '') = '' THEN 'homepage' WHEN {_PATH} LIKE '%/fr/%' THEN 'blocked_path' WHEN lower({_PATH}) LIKE '%.html' THEN 'blocked_suffix' WHEN {_DOMAIN} = 'spam-farm.example.org' OR {_DOMAIN} LIKE '%.spam-farm.example.org' THEN 'blocked_host' END"
_B = "(?:^|[^a-z0-9])(?:{})(?:[^a-z0-9]|$)"

_FEEDS = f"""
WITH RECURSIVE f AS (SELECT *, page_id // 25 AS feed, CASE WHEN page_id % 14 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE '' END AS title, regexp_extract(html, '<p>(.*?)</p>', 1, 's') AS s, DATE '2024-01-01' + (page_id % 60)::INTEGER AS d FROM pages),
feeds AS (SELECT feed, CASE WHEN feed % 11 = 4 THEN 'known_bad' WHEN feed % 7 = 3 THEN 'missing' WHEN feed % 5 = 1 THEN 'unreadable' ELSE 'read' END AS own, feed % 2 = 1 AND feed % 3 <> 0 AS may FROM (SELECT DISTINCT feed FROM f)),
heads AS (SELECT feed, CASE WHEN own IN ('missing', 'unreadable') AND may THEN 'fallback' ELSE own END AS status FROM feeds),
e AS (SELECT f.feed, page_id, row_number() OVER (PARTITION BY f.feed ORDER BY page_id) AS pos, d, url, title, concat_ws(' ', title, trim(s)) AS b FROM f JOIN heads h ON h.feed = f.feed AND h.status IN ('read', 'fallback')),
r AS (SELECT *, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS tk, regexp_replace(regexp_replace(url, '[;?#].*$', ''), '/+$', '') AS uk,
  CASE WHEN trim(title) = '' THEN 'empty_title' WHEN d <= DATE '2024-01-20' THEN 'not_recent' WHEN regexp_matches(lower(b), '{_B.format("onre")}') OR NOT regexp_matches(lower(b), '{_B.format("the|que|die|les|of")}') THEN 'off_topic' WHEN {_URL} LIKE 'blocked%' THEN 'blocked' WHEN {_URL} IS NOT NULL THEN 'invalid' END AS reject0 FROM e),
o AS (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM r WHERE reject0 IS NULL),
seen AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS keys, -1::BIGINT AS page_id, false AS again UNION ALL
  SELECT o.n, CASE WHEN list_has_any(seen.keys, ks) THEN seen.keys ELSE seen.keys || ks END, o.page_id, list_has_any(seen.keys, ks) FROM seen JOIN (SELECT *, list_filter([CASE WHEN tk <> '' THEN 'title:' || tk END, 'url:' || uk], lambda k: k IS NOT NULL) AS ks FROM o) o ON o.n = seen.n + 1),
j AS (SELECT r.*, CASE WHEN reject0 IS NOT NULL THEN reject0 WHEN again THEN 'duplicate' END AS reject1 FROM r LEFT JOIN seen USING (page_id)),
k AS (SELECT *, CASE WHEN reject1 IS NULL AND count(*) FILTER (reject1 IS NULL) OVER (PARTITION BY feed ORDER BY pos) > 8 THEN 'over' ELSE reject1 END AS reject FROM j)"""

ORACLE_SQL = {
    "t5_keyed_first_wins": r"""
WITH RECURSIVE o AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n, list_filter([CASE WHEN tk <> '' THEN 'title:' || tk END, CASE WHEN uk <> '' THEN 'url:' || uk END], lambda k: k IS NOT NULL) AS ks FROM (
  SELECT page_id, trim(regexp_replace(replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS tk, regexp_replace(regexp_replace(url, '[;?#].*$', ''), '/+$', '') AS uk FROM pages)),
seen AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS keys, -1::BIGINT AS page_id, true AS again UNION ALL
  SELECT o.n, CASE WHEN list_has_any(seen.keys, ks) THEN seen.keys ELSE seen.keys || ks END, o.page_id, list_has_any(seen.keys, ks) FROM seen JOIN o ON o.n = seen.n + 1)
SELECT page_id FROM seen WHERE NOT again""",
    "s1_feed_entries": f"{_FEEDS} SELECT 'feed-' || feed AS source, pos::INTEGER AS pos, d AS published_date, reject FROM k",
    "s1_feed_statuses": f"""{_FEEDS}, c AS (SELECT feed, count(*) FILTER (reject IS NULL) AS n, count(*) FILTER (reject = 'off_topic') AS t, count(*) FILTER (reject = 'invalid') AS i, count(*) FILTER (reject = 'blocked') AS b, count(*) FILTER (reject = 'duplicate') AS d FROM k GROUP BY feed),
m AS (SELECT h.feed, status, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(i, 0) AS i, coalesce(b, 0) AS b, coalesce(d, 0) AS d FROM heads h LEFT JOIN c USING (feed))
SELECT feed AS ord, 'feed-' || feed AS source, status = 'fallback' AS by_fallback, n AS n_entries, t AS n_off_topic, i AS n_invalid, b AS n_blocked, d AS n_duplicate,
  CASE WHEN status NOT IN ('read', 'fallback') THEN status WHEN n = 0 THEN CASE WHEN t > 0 AND i = 0 AND b = 0 THEN 'off_topic' WHEN b > 0 AND i = 0 THEN 'blocked' ELSE 'no_entries' END WHEN status = 'fallback' THEN 'fallback_ok' ELSE 'ok' END AS status FROM m""",
    "s2_feed_normaliser": f"""
WITH e AS (SELECT CASE WHEN page_id % 14 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, url, regexp_extract(html, '<p>(.*?)</p>', 1, 's') AS s, CASE WHEN page_id % 9 <> 0 THEN DATE '2024-01-01' + (page_id % 60)::INTEGER END AS d FROM pages),
f AS (SELECT *, replace(lower(concat_ws(' ', title, trim(regexp_replace(s, '<[^>]+>', ' ', 'g')))), 'ß', 'ss') AS b0, replace(lower(concat_ws(' ', title, s)), 'ß', 'ss') AS b FROM e)
SELECT CASE WHEN coalesce(trim(title), '') = '' THEN 'empty_title' WHEN d <= DATE '2024-01-20' THEN 'not_recent' WHEN regexp_matches(b, '{_B.format("onre")}') THEN 'excluded_topic' WHEN NOT regexp_matches(b, '{_B.format("the|que|die|les|of")}') THEN 'off_topic' WHEN {_URL} IS NOT NULL THEN 'url' ELSE 'kept' END AS reject,
  count(*) AS n, max(d) AS latest FROM f GROUP BY 1""",
    "s3_search_hits": f"""
WITH p AS (SELECT *, DATE '2024-01-01' + (page_id % 90)::INTEGER AS d FROM pages)
SELECT {_DOMAIN} AS domain, coalesce({_URL}, CASE WHEN d < DATE '2024-01-07' OR d > DATE '2024-02-23' THEN 'date' END, 'kept') AS reject, count(*) AS n,
  min('raw_' || substr(sha256('{{"date":"' || d || '","href":"' || url || '","published":null}}'), 1, 24)) AS first_id FROM p GROUP BY ALL""",
    "s17_block_parser": """
SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INTEGER AS pos, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal::VARCHAR END AS balance FROM customer""",
    "s9_page_metadata": """
SELECT page_id, make_date(2024, (page_id % 9 + 1)::INTEGER, 5) AS published, CASE WHEN page_id % 2 = 0 THEN 'article' END AS kind, CASE WHEN page_id % 3 <> 0 THEN page_id END AS ld_id, true AS is_canonical FROM pages""",
    "s12_metadata_cascade": """
WITH l AS (SELECT l_orderkey AS k, min(l_shipdate)::DATE AS day, CASE WHEN count(*) > 2 THEN max(l_returnflag) END AS flag FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1), f AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, o_orderstatus AS flag FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN l.k IS NOT NULL THEN 'lines' WHEN f.k IS NOT NULL THEN 'orders' ELSE 'none' END AS origin, coalesce(l.flag, f.flag) AS flag, count(*) AS n, min(coalesce(l.day, f.day)) AS first_day
FROM orders o LEFT JOIN l ON l.k = o_orderkey LEFT JOIN f ON f.k = o_orderkey GROUP BY ALL""",
    "q14_water_filling": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 12",
    "f13_fragment_gate": f"""
SELECT lang, count(*) FILTER (len(list_filter(string_split_regex(replace(lower(text), 'ß', 'ss'), '[.!?。！？\\n]+'), lambda s: regexp_matches(s, '{_B.format("the|une|der")}') AND regexp_matches(s, '{_B.format("of|que|und")}'))) > 0) AS n_both, count(*) AS n
FROM documents GROUP BY lang""",
    "r21_best_link": r"""
WITH p AS (SELECT page_id, list_distinct(list_filter(string_split_regex(replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'ß', 'ss'), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 3)) AS t, unnest(regexp_extract_all(html, '<a\b[^>]*href\s*=\s*["''][^"'']+["''][^>]*>.*?</a>', 0, 'is')) AS a FROM pages),
l AS (SELECT page_id, regexp_extract(a, 'href\s*=\s*["'']([^"'']+)["'']', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label, t FROM p),
s AS (SELECT *, len(list_intersect(t, list_filter(string_split_regex(replace(lower(label), 'ß', 'ss'), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 3))) AS n FROM l)
SELECT page_id, href, label FROM s WHERE n >= 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, length(href), href) = 1""",
}
