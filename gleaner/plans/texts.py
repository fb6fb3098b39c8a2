"""Queries of the text and url functions. Rule packs hold words that occur in the driver's invented prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates, hashing, text, urls
from gleaner.operators import similarity
from gleaner.plans.common import table

PACKS = {"insult": ["idiot", "stupid", "trash"], "article": ["the", "une", "der"], "phrase": ["of the", "de la", "in der"], "secret": ["password", "AKIA"]}
TERMS, NEGATORS = ["erth", "onre", "de la", "und"], ["the", "and", "les", "die"]
TAGS = {"license": r"licen[cs]e", "math": r"\d+\s*[+*/]\s*\d+", "mail": r"@[a-z0-9-]+\.", "list": r"\n[-*] ", "version": r"\b\d+\.\d+\b"}
HOSTS = [("example.com", "company"), ("example.org", "public"), ("spam-farm.example.org", "spam"), ("casino-win.example.com", "spam"), ("m.casino-win.example.com", "spam_mobile")]


def f1_term_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language that match each rule pack, in one pass."""
    counts = [F.count_if(text.contains_any("text", terms)).alias(name) for name, terms in PACKS.items()]
    wide = table(spark, sf_dir, "documents").groupBy("lang").agg(*counts)
    return wide.unpivot("lang", list(PACKS), "rule_set", "n_docs")


def f2_negation_aware_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they have a term, and one that no negator precedes in its clause."""
    d = table(spark, sf_dir, "documents").select("lang", text.contains_any("text", TERMS).alias("has_term"), text.contains_positive("text", TERMS, NEGATORS).alias("positive"))
    return d.groupBy("lang", "has_term", "positive").agg(F.count("*").alias("n_docs"))


def _page_title() -> Column:
    return text.normalize_title(F.regexp_extract("html", "(?s)<title>([^<]*)</title>", 1))


def f7_normalized_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised titles that several pages share."""
    p = table(spark, sf_dir, "pages").select("page_id", _page_title().alias("title"))
    return p.groupBy("title").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).where("n_pages > 1")


def f9_clean_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags, shortened, and their words."""
    clean = text.clean_text("html")
    return table(spark, sf_dir, "pages").select("page_id", text.shorten(clean, 200).alias("summary"), text.wordish_count(clean).cast("long").alias("n_words"), text.compact_words(clean, 60).alias("headline"))


def f12_canonical_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.explode(text.tags("text", TAGS)).alias("tag"))
    return d.groupBy("lang", "tag").agg(F.count("*").alias("n_docs"))


def f14_similar_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different titles of pages with a similarity of 0.84 or more, of the later title against the earlier."""
    p = table(spark, sf_dir, "pages").select("page_id", _page_title().alias("title"))
    pairs = similarity.similar_texts(p, "page_id", "title", 0.84).where("ratio >= 0.84")
    return pairs.select(F.col("a").alias("a_page"), F.col("b").alias("b_page"), F.round("ratio", 6).alias("ratio"))


def f14_similar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of titles that are paraphrases: alike from 0.72 up to below 0.999."""
    p = table(spark, sf_dir, "pages").select("page_id", _page_title().alias("title"))
    return similarity.similar_rows(p, "page_id", "title", 0.72, 0.999).select("later", "earlier", F.round("ratio", 6).alias("ratio"))


def f15_title_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first sentence only says their title again."""
    first = F.regexp_extract("html", r"(?s)<p>(?:<b>)?([^<.]*[<.][^<.]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.paraphrase(first, _page_title()).alias("paraphrase"))


def r22_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the title of each page the first document that may be what it names: an equal or near-equal beginning, or one that a cut title begins; of the page's language."""
    raw, head = F.regexp_extract("html", "<title>([^<]*)</title>", 1), lambda c: F.slice(F.split(c, " "), 1, 3)
    pages = table(spark, sf_dir, "pages").select("page_id", _page_title().alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), (F.length(raw) >= 60).alias("cut")).where("title <> ''").withColumn("head", head("title"))
    begin = text.normalize_title(F.substring_index("text", ".", 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", begin.alias("begin")).withColumn("head", head("begin"))
    prefix = F.col("cut") & (F.size(F.split("title", " ")) >= 4) & F.startswith("begin", "title")
    return similarity.first_acceptable(pages, docs, ["lang"], "doc_id", "title", "begin", ("cut",), prefix, ("head",)).select("page_id", "doc_id")


def f16_token_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of neighbouring ids of a source whose sets of numbers conflict."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_set("text", r"\d+").alias("numbers"))
    a, b = d.alias("a"), d.withColumn("turn", F.col("turn") - 1).alias("b")
    both = a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join("a.numbers", ",").alias("numbers"), text.conflicting(F.col("a.numbers"), F.col("b.numbers")).alias("conflict"))
    return both


def f20_loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of answers that hold it fenced, in prose, or broken."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nbye"))).when(kind == 1, F.concat(F.lit("I think "), "props", F.lit(" is it"))).otherwise(F.concat(F.lit("none {"), "props"))
    return e.select("event_id", F.get_json_object(text.loose_json(answer), "$.k").cast("int").alias("k"))


def f21_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards' identifiers and DOIs in composed titles."""
    p = table(spark, sf_dir, "part")
    title = F.concat(F.lit("Update of "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("EN  "), (F.col("p_partkey") + 1000).cast("string"), F.lit("-2"))).otherwise("draft"), F.lit(", see doi 10.1234/Ab."), F.col("p_partkey").cast("string"), F.lit(")."))
    return p.select("p_partkey", text.standard_id(F.regexp_replace(title, "EN  ", "EN "), ["EN", "IEC", "ISO"]).alias("standard"), text.doi(title).alias("doi"))


def u1_domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("domain", urls.domain("url"))
    return p.groupBy("domain").agg(F.count("*").alias("n_pages"), F.count_distinct(urls.path("url")).alias("n_paths"))


def u2_host_suffix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the class of the longest domain rule that holds their host."""
    rules = spark.createDataFrame(HOSTS, "domain string, class string")
    p = urls.join_host_rules(table(spark, sf_dir, "pages").select("page_id", urls.domain("url").alias("host")), "host", rules)
    return p.groupBy(F.coalesce("class", F.lit("other")).alias("class"), F.coalesce("domain", F.lit("none")).alias("domain")).agg(F.count("*").alias("n_pages"))


def u5_url_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 11 == 0, "/relative").when(F.col("page_id") % 13 == 0, "").when(F.col("page_id") % 17 == 0, "ftp://x.example/a").when(F.col("page_id") % 19 == 0, F.regexp_extract("url", "^(https?://[^/]+)", 1)).otherwise(F.col("url"))
    reason = urls.reject_reason(url, blocked_paths=["/fr/"], blocked_hosts=["spam-farm.example.org"], blocked_suffixes=["html"], low_value_hosts=["example.net"])
    return p.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_pages"))


def u7_canonical_url_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of pages whose urls are written with ports, blank and tracking values, escapes, or as a bare host."""
    kind, url = F.col("page_id") % 6, F.col("url")
    host = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    written = (
        F.when(kind == 0, F.regexp_replace(url, "^(https?://[^/?#]+)", "$1:8443")).when(kind == 1, F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("z=&b=x+y&UTM_Source=q&a=%7Ek*&c")))
        .when(kind == 2, host).when(kind == 3, F.concat(host, F.lit("//caf%C3%A9//x/?ref=1"))).otherwise(url)
    )
    p = table(spark, sf_dir, "pages").select("page_id", urls.canonical_key(written).alias("key"), urls.dedupe_url(written).alias("plain"))
    return p.groupBy("key").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.count_distinct("plain").alias("n_plain"))


def u11_date_parse_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders written in several ways, in texts and in paths, and read back."""
    d = F.add_months(F.col("o_orderdate").cast("date"), 240)
    kind, place = F.col("o_orderkey") % 9, F.col("o_orderkey") % 5
    written = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "EEE, dd MMM yyyy 08:00:00 'GMT'")).when(kind == 2, F.date_format(d, "yyyy年M月d日"))
        .when(kind == 3, F.concat(F.lit("in "), F.year(d).cast("string"))).when(kind == 4, F.concat(F.lit("seen 2015-13-"), F.dayofmonth(d))).when(kind == 5, F.concat(F.lit("on "), F.date_format(d, "yyyy-M-d"), F.lit(" at noon")))
        .when(kind == 6, F.concat(F.lit("by "), F.date_format(d, "yyyy/M/d"), F.lit("."))).when(kind == 7, F.concat(F.lit("no. 1"), F.date_format(d, "yyyy/MM/dd"))).otherwise("unknown 2026")
    )
    url = F.concat(
        F.lit("https://x.example/"),
        F.when(place == 0, F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit("/a.html"))).when(place == 1, F.concat(F.lit("news/title-"), F.date_format(d, "yyyy-MM-dd"), F.lit(".html")))
        .when(place == 2, F.concat(F.date_format(d, "yyyy'%2F'M'%2F'd"), F.lit("?x=2001/01/01"))).when(place == 3, F.concat(F.lit("2015/13/40/"), F.date_format(d, "yyyy-M-d"))).otherwise(F.concat(F.lit("id"), F.date_format(d, "yyyyMMdd"))),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.loose_date(written, ["unknown"]).alias("read"), dates.path_date(url).alias("from_path"), dates.publication_date(written).alias("published"))


HURT = [r"injures (\d{1,3})\b", r"\b(\d{1,3}) (?:passengers )?(?:were )?(?:hurt|injured)\b", r"\b(\d{1,3}) hospitalised\b", r"(\d{1,3}) *人受傷"]


def f17_injury_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of hurt people in composed reports."""
    n = F.col("event_id") % 200
    number, kind = n.cast("string"), F.col("event_id") % 8
    report = (
        F.when(kind == 0, F.concat(F.lit("Tunnel smoke injures "), number)).when(kind == 1, F.concat(number, F.lit(" passengers were hurt"))).when(kind == 2, F.concat(F.lit("About "), number, F.lit(" Hospitalised, 3 dead")))
        .when(kind == 3, F.concat(F.lit("列車事故"), number, F.lit(" 人受傷"))).when(kind == 4, F.concat(F.lit("More than a dozen hurt on line "), number)).when(kind == 5, F.lit("Over a dozen people in a lift"))
        .when(kind == 6, F.concat(number, F.lit("0000 injured in ten years"))).otherwise("nobody")
    )
    return table(spark, sf_dir, "events").select("event_id", text.injuries(report, HURT, ["more than a dozen", "over a dozen"]).alias("n_hurt"))


def u18_ingest_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"source": F.col("source"), "doc_id": F.col("doc_id"), "lang": F.col("lang"), "note": F.lit(None).cast("string")}
    return table(spark, sf_dir, "documents").select("doc_id", hashing.ingest_id(fields).alias("ingest_id"))


def u20_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rules = [("spanish", "^/es/", []), ("titled", "^$", ["onre", "ti"]), ("html", r"\.html$", [])]
    p = table(spark, sf_dir, "pages").select(urls.page_kind("url", title, rules).alias("kind"))
    return p.groupBy("kind").agg(F.count("*").alias("n_pages"))


QUERIES = {f.__name__: f for f in (f1_term_match_counts, f2_negation_aware_match, f7_normalized_title_groups, f9_clean_shorten, f12_canonical_tags, f14_similar_title_pairs, f14_similar_rows, f15_title_paraphrases, r22_title_lookup, f16_token_conflicts, f17_injury_counts, f20_loose_json, f21_identifiers, u1_domain_rollup, u2_host_suffix_class, u5_url_reject_reason, u7_canonical_url_dups, u11_date_parse_chain, u18_ingest_id, u20_page_kinds)}


def _re2(terms: list[str]) -> str:
    """The bounded terms for an engine without look-around: for tests of existence."""
    return "|".join(f"(?:^|[^a-z0-9]){t.lower()}(?:[^a-z0-9]|$)" for t in terms)


_FOLD = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL = {
    "f1_term_match_counts": " UNION ALL ".join(f"SELECT lang, '{n}' AS rule_set, count(*) FILTER (regexp_matches({_FOLD}, '{_re2(t)}')) AS n_docs FROM documents GROUP BY lang" for n, t in PACKS.items()),
    "f2_negation_aware_match": f"""
WITH c AS (SELECT lang, {_FOLD} AS t FROM documents)
SELECT lang, regexp_matches(t, '{_re2(TERMS)}') AS has_term,
  len(list_filter(string_split_regex(t, '[.!?;:。！？；：\\n]'), lambda c: regexp_matches(c, '{_re2(TERMS)}') AND NOT regexp_matches(string_split_regex(c, '{_re2(TERMS)}')[1], '{_re2(NEGATORS)}'))) > 0 AS positive,
  count(*) AS n_docs
FROM c GROUP BY ALL""",
    "f7_normalized_title_groups": r"""
SELECT trim(regexp_replace(replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title, count(*) AS n_pages, min(page_id) AS first_page
FROM pages GROUP BY 1 HAVING count(*) > 1""",
    "f9_clean_shorten": r"""
WITH c AS (SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '[\t\n\x0B\f\r \x{00A0}]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 199)) || '…' ELSE t END AS summary,
  len(regexp_extract_all(t, '[A-Za-z0-9]+|[\x{4E00}-\x{9FFF}]')) AS n_words,
  CASE WHEN length(t) <= 60 THEN t WHEN substr(t, 61, 1) = ' ' THEN rtrim(substr(t, 1, 60)) ELSE rtrim(regexp_extract(substr(t, 1, 60), '^(.*)[ ][^ ]*$', 1)) END AS headline
FROM c""",
    "f12_canonical_tags": " UNION ALL ".join(f"SELECT lang, '{n}' AS tag, count(*) AS n_docs FROM documents WHERE regexp_matches({_FOLD}, '{p}') GROUP BY lang" for n, p in TAGS.items()),
    "f16_token_conflicts": r"""
WITH d AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\d+'))) AS n FROM conversations)
SELECT a.conv_id, a.turn, array_to_string(a.n, ',') AS numbers, len(a.n) > 0 AND len(b.n) > 0 AND NOT list_has_any(a.n, b.n) AS conflict
FROM d a JOIN d b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "f20_loose_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props->>'k')::INTEGER END AS k FROM events",
    "f21_identifiers": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey + 1000 < 1000000 THEN 'EN ' || (p_partkey + 1000) || '-2' END AS standard, '10.1234/ab.' || p_partkey AS doi FROM part",
    "u1_domain_rollup": f"SELECT {_DOMAIN} AS domain, count(*) AS n_pages, count(DISTINCT {_PATH}) AS n_paths FROM pages GROUP BY 1",
    "u2_host_suffix_class": f"""
WITH rules(domain, class) AS (VALUES {', '.join(str(h) for h in HOSTS)}), h AS (SELECT page_id, {_DOMAIN} AS host FROM pages),
m AS (SELECT page_id, r.domain, class FROM h LEFT JOIN rules r ON host = r.domain OR host LIKE '%.' || r.domain QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.domain) DESC NULLS LAST) = 1)
SELECT coalesce(class, 'other') AS class, coalesce(domain, 'none') AS domain, count(*) AS n_pages FROM m GROUP BY ALL""",
    "u5_url_reject_reason": f"""
WITH u AS (SELECT CASE WHEN page_id % 11 = 0 THEN '/relative' WHEN page_id % 13 = 0 THEN '' WHEN page_id % 17 = 0 THEN 'ftp://x.example/a' WHEN page_id % 19 = 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) ELSE url END AS url FROM pages),
p AS (SELECT url, {_DOMAIN} AS host, {_PATH} AS path FROM u)
SELECT CASE WHEN url = '' THEN 'empty' WHEN url LIKE '/%' THEN 'relative' WHEN url NOT LIKE 'http://%' AND url NOT LIKE 'https://%' THEN 'scheme' WHEN replace(path, '/', '') = '' THEN 'homepage'
  WHEN path LIKE '%/fr/%' THEN 'blocked_path' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'low_value_host' WHEN path LIKE '%.html' THEN 'blocked_suffix'
  WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' THEN 'blocked_host' ELSE 'valid' END AS reason, count(*) AS n_pages
FROM p GROUP BY 1""",
    "u7_canonical_url_dups": f"""
WITH h AS (SELECT page_id, page_id % 6 AS kind, url AS raw, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS h FROM pages),
w AS (SELECT page_id, CASE kind WHEN 0 THEN h || ':8443' || substr(raw, length(h) + 1) WHEN 1 THEN raw || CASE WHEN contains(raw, '?') THEN '&' ELSE '?' END || 'z=&b=x+y&UTM_Source=q&a=%7Ek*&c' WHEN 2 THEN h WHEN 3 THEN h || '//caf%C3%A9//x/?ref=1' ELSE raw END AS url FROM h),
p AS (SELECT page_id, regexp_replace({_DOMAIN}, ':[0-9]*$', '') AS host, regexp_replace(regexp_replace(url_decode({_PATH}), '/{{2,}}', '/', 'g'), '/$', '') AS path,
  list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: regexp_matches(q, '=.')),
    lambda q: [url_decode(replace(regexp_extract(q, '^([^=]*)=', 1), '+', ' ')), url_decode(replace(regexp_extract(q, '^[^=]*=(.*)$', 1), '+', ' '))]), lambda s: NOT starts_with(lower(s[1]), 'utm_') AND lower(s[1]) NOT IN {urls.TRACKING})) AS q,
  regexp_replace(regexp_replace(url, '[;?#].*$', ''), '/+$', '') AS plain FROM w)
SELECT 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda s: replace(url_encode(s[1]) || '=' || url_encode(s[2]), '%20', '+')), '&') ELSE '' END AS key, count(*) AS n_pages, min(page_id) AS first_page, count(DISTINCT plain) AS n_plain
FROM p GROUP BY 1""",
    "u11_date_parse_chain": """
WITH d AS (SELECT o_orderkey, o_orderkey % 9 AS kind, o_orderkey % 5 AS place, (o_orderdate::DATE + INTERVAL 240 MONTH)::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN kind IN (0, 1, 2, 5, 6) THEN d WHEN kind = 3 THEN make_date(year(d), 1, 1) END AS read, CASE WHEN place < 4 THEN d END AS from_path, CASE WHEN kind IN (0, 1) THEN d END AS published FROM d""",
    "f17_injury_counts": """
SELECT event_id, CASE event_id % 8 WHEN 4 THEN CASE WHEN contains((event_id % 200)::VARCHAR, '14') THEN 14 ELSE 12 END WHEN 5 THEN 12 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE event_id % 200 END::INTEGER AS n_hurt FROM events""",
    "u18_ingest_id": """
SELECT doc_id, 'raw_' || substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","note":null,"source":"' || source || '"}'), 1, 24) AS ingest_id FROM documents""",
    "u20_page_kinds": f"""
WITH p AS (SELECT lower({_PATH}) AS path, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
SELECT CASE WHEN replace(path, '/', '') = '' THEN 'home' WHEN path LIKE '/es/%' THEN 'spanish' WHEN path = '' OR regexp_matches(title, '{_re2(["onre", "ti"])}') THEN 'titled' WHEN path LIKE '%.html' THEN 'html'
  WHEN regexp_matches(path, '/\\d{{2,}}([./]|$)') THEN 'article' ELSE 'unresolved' END AS kind, count(*) AS n_pages FROM p GROUP BY 1""",
}
