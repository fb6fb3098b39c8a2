"""Queries of dimensions, spans, labels and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates, text, urls
from gleaner.operators import diagnostics, planning, resolve, score
from gleaner.plans.common import number, table

FAMILIES = [("BUILDING", "houses", 2), ("AUTOMOBILE", "cars", 1), ("MACHINERY", "machines", 3), ("HOUSEHOLD", "houses", 4)]
TIERS = [("D", "spam", ["spam-farm.example.org"]), ("A", "public", ["example.org"]), ("B", "trade", ["example.net"])]
PLACES, CUES = {"first": ["thing"], "second": ["que"], "third": ["der"]}, [("works", ["onre", "erth"]), ("test", ["tion"]), ("vendor", ["pour", "ung"])]


def q3_query_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the market segments of each nation's customers."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    families = spark.createDataFrame(FAMILIES, "kind string, family string, position int")
    f = planning.query_families(c, "c_nationkey", F.filter("segments", lambda s: F.length(s) + F.col("c_nationkey") % 3 != 10), families, {"cars": "roads"})
    return f.select("c_nationkey", F.array_join("families", ",").alias("families"))


def q5_feed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages as sources of three dimensions, the first of which has each."""
    p = table(spark, sf_dir, "pages").groupBy(urls.domain("url").alias("url")).agg(F.min("page_id").alias("position"))
    parts = [("base", p.where("position % 3 = 0")), ("region", p.where("position % 2 = 0")), ("extra", p), ("unwanted", p)]
    return planning.feed_sources(parts, {"base", "region", "extra"})


def q6_fast_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title or url has a keyword, one for each host, one for each name on a shared host."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), F.concat(F.lit("N"), (F.col("page_id") % 40).cast("string")).alias("name"), "url")
    return planning.fast_subset(p, "name", "url", "position", ["/fr/", "n7"], ["spam-farm.example.org"])


def f4_term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans two packs of terms have in each document, where the first begins and the last ends, and how near they come."""
    a, b = text.spans("text", ["thing", "que"]), text.spans("text", ["the", "der"])
    d = table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), F.slice(b, 1, 20).alias("b"))
    return d.select("doc_id", F.size("a").alias("n"), F.get("a", F.lit(0))["start"].alias("first"), F.get("a", F.size("a") - 1)["stop"].alias("last"), F.size("b").alias("n_b"))


def r2_span_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distance of two terms in composed texts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("owner "), F.repeat(F.lit("x"), (F.col("o_orderkey") % 60).cast("int")), F.lit(" system "), F.repeat(F.lit("y"), (F.col("o_orderkey") % 37).cast("int")), F.lit(" owner")).alias("t"))
    return o.select("o_orderkey", text.span_distance(text.spans("t", ["owner"]), text.spans("t", ["system"])).alias("distance"))


def r3_maker_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the regions that a cue of making or selling is near to."""
    d = table(spark, sf_dir, "documents").select("lang", F.explode(resolve.located("text", PLACES, CUES, 20)).alias("e"))
    return d.groupBy("lang", "e.region", "e.method").agg(F.count("*").alias("n_docs"))


def r4_region_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = number()
    e = table(spark, sf_dir, "events")
    found = F.when(k % 3 == 0, "north").when(k % 3 == 1, "Nord")
    method = F.when(found.isNotNull(), F.when(k % 5 == 0, "query_text").otherwise("explicit")).when(k % 2 == 0, "unresolved").otherwise("kept")
    asked = F.when(k % 4 == 0, "north").when(k % 4 == 1, "south").when(k % 4 == 2, "global")
    w = resolve.write_back(F.when(F.col("user_id") % 2 == 0, "west"), found, method, asked, {"Nord": "north"}, ["global"], ["query_text"])
    return e.select("event_id", w.alias("w")).select("event_id", "w.*")


def r10_provider_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication dates in the order that each provider's are trusted."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    values = {"raw": F.when(key % 2 == 0, day), "updated": F.when(key % 3 == 0, F.date_add(day, 2)), "page": F.when(key % 5 == 0, F.date_add(day, 1))}
    picked = resolve.pick_by_provider(F.col("o_orderstatus"), {"F": ["page", "raw", "updated"], "O": ["updated", "page"]}, values, ["raw", "updated", "page"])
    return table(spark, sf_dir, "orders").select("o_orderkey", picked.alias("p")).select("o_orderkey", "p.value", "p.origin", F.array_join("p.conflicts", ",").alias("conflicts"))


def r11_route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their quarter and against the route that they were found on."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    quarter = F.trunc(day, "QUARTER")
    o = table(spark, sf_dir, "orders").select(F.when(key % 23 != 0, day).alias("day"), quarter.alias("q"), (key % 3 == 0).alias("routed"), F.when(key % 4 != 0, F.add_months(quarter, F.when(key % 7 == 0, 3).otherwise(0))).alias("start"), F.when(key % 11 == 0, dates.quarter_label(F.add_months(quarter, 3))).otherwise(dates.quarter_label(quarter)).alias("label"))
    status = dates.verify(F.col("day"), F.col("q"), F.add_months("q", 3))
    routed = dates.verify_route(status, F.col("day"), dates.quarter_label(F.col("q")), F.col("routed"), F.col("start"), F.add_months("start", 3), F.col("label"))
    return o.groupBy(routed.alias("status")).agg(F.count("*").alias("n"))


def r16_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what their source is called."""
    source = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 5 == 1, "Feed").otherwise(F.concat(F.lit("Paper "), (F.col("page_id") % 7).cast("string")))
    label = resolve.source_label(source, urls.domain("url"), {"example.net": "The Net", "m.example.net": "The Mobile Net"}, ["www.example.com"], ["Feed"], F.col("page_id") % 3 == 0)
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"))


def u10_source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    label = F.when(F.col("page_id") % 4 == 0, "City Press Office").otherwise("blog")
    t = urls.source_tier(urls.domain("url"), TIERS, label, [("A", "office", ["press office"])])
    return p.select(t.alias("t")).groupBy("t.tier", "t.reason").agg(F.count("*").alias("n_pages"))


def c5_metadata_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of documents for what is known of them."""
    t, size = F.col("text"), F.length("text")
    p = score.points({
        "article": [(size > 800, 40)], "identifier": [(t.contains("@"), 20), (t.rlike(r"\d{12,}"), 18)], "subject": [(text.contains_any(t, ["thing"]), 12)],
        "technical": [(text.contains_any(t, ["onre"]), 10), (text.contains_any(t, ["erth"]), 7), (text.contains_any(t, ["que"]), 5)], "title": [(size > 100, 4)], "whole": [(~t.endswith("..."), 3)], "date": [(F.col("lang") == "en", 1)],
    })
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.*")


def a9_recent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    return diagnostics.recent_share(o, ["o_orderpriority"], F.col("day"), F.lit("1998-08-03").cast("date"))


QUERIES = {f.__name__: f for f in (q3_query_families, q5_feed_sources, q6_fast_sources, f4_term_spans, r2_span_distance, r3_maker_places, r4_region_write_back, r10_provider_dates, r11_route_status, r16_source_labels, u10_source_tiers, c5_metadata_points, a9_recent_share)}

_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
_FOLD = "replace(lower(coalesce(text, '')), 'ß', 'ss')"


def _under(host: str, domains: list[str]) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR {host} LIKE '%.{d}'" for d in domains) + ")"


def _word(terms: list[str]) -> str:
    return "|".join(f"(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)" for t in terms)


def _near(names: list[str], cues: list[str], distance: int) -> str:
    cue, name = "|".join(cues), "|".join(names)
    return f"regexp_matches({_FOLD}, '(?s)({cue})(.{{0,{distance - 1}}}[^a-z0-9])({name})([^a-z0-9]|$)|(^|[^a-z0-9])({name})([^a-z0-9].{{0,{distance - 1}}})({cue})')"


def _methods(names: list[str]) -> str:
    return " ".join(f"WHEN {_near(names, cues, 20)} THEN '{m}'" for m, cues in CUES)


ORACLE_SQL = {
    "q3_query_families": f"""
WITH f(kind, family, position) AS (VALUES {", ".join(map(str, FAMILIES))}), c AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), x AS (SELECT c_nationkey, family, min(position) AS p FROM c JOIN f ON kind = c_mktsegment WHERE length(c_mktsegment) + c_nationkey % 3 <> 10 GROUP BY ALL),
l AS (SELECT c_nationkey, string_agg(family, ',' ORDER BY p) AS families, bool_or(family = 'cars') AS cars FROM x GROUP BY 1)
SELECT n.c_nationkey, coalesce(families || CASE WHEN cars THEN ',roads' ELSE '' END, '') AS families FROM (SELECT DISTINCT c_nationkey FROM c) n LEFT JOIN l USING (c_nationkey)""",
    "q5_feed_sources": f"WITH p AS (SELECT {_DOMAIN} AS url, min(page_id) AS position FROM pages GROUP BY 1) SELECT url, position, CASE WHEN position % 3 = 0 THEN 'base' WHEN position % 2 = 0 THEN 'region' ELSE 'extra' END AS part FROM p",
    "q6_fast_sources": f"""
WITH p AS (SELECT page_id AS position, 'N' || (page_id % 40) AS name, url, {_DOMAIN} AS host FROM pages)
SELECT position, name, url FROM p WHERE contains(lower(url), '/fr/') OR contains(lower(name || ' ' || url), 'n7') QUALIFY row_number() OVER (PARTITION BY CASE WHEN host IN ('spam-farm.example.org', '') THEN lower(name) ELSE host END ORDER BY position) = 1""",
    "f4_term_spans": f"""
WITH w AS (SELECT doc_id, unnest(string_split_regex({_FOLD}, '[^a-z0-9]')) AS word, generate_subscripts(string_split_regex({_FOLD}, '[^a-z0-9]'), 1) AS i FROM documents),
p AS (SELECT doc_id, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS pos FROM w)
SELECT d.doc_id, count(*) FILTER (word IN ('thing', 'que'))::INTEGER AS n, min(pos) FILTER (word IN ('thing', 'que')) AS first, max(pos + length(word)::INTEGER) FILTER (word IN ('thing', 'que')) AS last, least(20, count(*) FILTER (word IN ('the', 'der')))::INTEGER AS n_b FROM documents d LEFT JOIN p USING (doc_id) GROUP BY 1""",
    "r2_span_distance": "SELECT o_orderkey, (1 + least(o_orderkey % 60 + 1, o_orderkey % 37 + 1))::INTEGER AS distance FROM orders",
    "r3_maker_places": " UNION ALL ".join(
        f"SELECT lang, '{region}' AS region, CASE {_methods(names)} END AS method, count(*) AS n_docs FROM documents WHERE {' OR '.join(_near(names, cues, 20) for _, cues in CUES)} GROUP BY ALL" for region, names in PLACES.items()
    ),
    "r4_region_write_back": """
WITH e AS (SELECT event_id, user_id, (props->>'k')::INTEGER AS k FROM events), f AS (SELECT *, k % 3 < 2 AS found, CASE WHEN k % 3 < 2 THEN 'north' WHEN k % 2 = 0 THEN 'unknown' WHEN user_id % 2 = 0 THEN 'west' ELSE 'unknown' END AS region FROM e)
SELECT event_id, region, NOT (found AND k % 5 = 0) AND ((k % 4 = 0 AND region <> 'north') OR k % 4 = 1) AS conflict FROM f""",
    "r10_provider_dates": """
WITH v AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS r, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 2 END AS u, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 1 END AS p FROM orders),
w AS (SELECT *, CASE s WHEN 'F' THEN coalesce(p, r, u) WHEN 'O' THEN coalesce(u, p) ELSE coalesce(r, u, p) END AS value FROM v)
SELECT o_orderkey, value, CASE WHEN value = r THEN 'raw' WHEN value = u THEN 'updated' WHEN value = p THEN 'page' END AS origin,
  CASE s WHEN 'F' THEN concat_ws(',', CASE WHEN p <> value THEN 'page' END, CASE WHEN r <> value THEN 'raw' END, CASE WHEN u <> value THEN 'updated' END) WHEN 'O' THEN concat_ws(',', CASE WHEN u <> value THEN 'updated' END, CASE WHEN p <> value THEN 'page' END) ELSE concat_ws(',', CASE WHEN r <> value THEN 'raw' END, CASE WHEN u <> value THEN 'updated' END, CASE WHEN p <> value THEN 'page' END) END AS conflicts FROM w""",
    "r11_route_status": """
SELECT CASE WHEN o_orderkey % 23 = 0 THEN 'missing_date' WHEN o_orderkey % 3 <> 0 THEN 'verified' WHEN o_orderkey % 4 = 0 THEN 'route_metadata_invalid' WHEN o_orderkey % 7 = 0 THEN 'route_window_conflict' WHEN o_orderkey % 11 = 0 THEN 'route_bucket_conflict' ELSE 'verified' END AS status, count(*) AS n FROM orders GROUP BY 1""",
    "r16_source_labels": f"""
WITH p AS (SELECT page_id, {_DOMAIN} AS host FROM pages)
SELECT page_id, CASE WHEN {_under("host", ["m.example.net"])} THEN 'The Mobile Net' WHEN {_under("host", ["example.net"])} THEN 'The Net' WHEN page_id % 5 > 1 THEN 'Paper ' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN ' (official)' ELSE '' END WHEN host <> '' AND host <> 'www.example.com' THEN host ELSE 'unknown source' END AS label FROM p""",
    "u10_source_tiers": f"""
WITH p AS (SELECT page_id, {_DOMAIN} AS host FROM pages), t AS (SELECT CASE {" ".join(f"WHEN {_under('host', d)} THEN '{t}|{r}'" for t, r, d in TIERS)} WHEN page_id % 4 = 0 THEN 'A|office' ELSE 'C|other' END AS t FROM p)
SELECT string_split(t, '|')[1] AS tier, string_split(t, '|')[2] AS reason, count(*) AS n_pages FROM t GROUP BY ALL""",
    "c5_metadata_points": f"""
WITH p AS (SELECT doc_id, CASE WHEN length(text) > 800 THEN 40 ELSE 0 END AS article, CASE WHEN contains(text, '@') THEN 20 WHEN regexp_matches(text, '[0-9]{{12,}}') THEN 18 ELSE 0 END AS identifier, CASE WHEN regexp_matches({_FOLD}, '{_word(["thing"])}') THEN 12 ELSE 0 END AS subject,
  CASE WHEN regexp_matches({_FOLD}, '{_word(["onre"])}') THEN 10 WHEN regexp_matches({_FOLD}, '{_word(["erth"])}') THEN 7 WHEN regexp_matches({_FOLD}, '{_word(["que"])}') THEN 5 ELSE 0 END AS technical, CASE WHEN length(text) > 100 THEN 4 ELSE 0 END AS title, CASE WHEN NOT ends_with(text, '...') THEN 3 ELSE 0 END AS whole, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS date FROM documents)
SELECT *, article + identifier + subject + technical + title + whole + date AS total FROM p""",
    "a9_recent_share": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderdate::DATE > '1998-08-03'::DATE - 60) AS n_recent, round(count(*) FILTER (o_orderdate::DATE > '1998-08-03'::DATE - 60) / count(*), 4) AS share FROM orders GROUP BY 1",
}
