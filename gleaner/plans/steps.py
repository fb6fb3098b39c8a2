"""Queries of planning, further resolution, coverage, summaries and report repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text, urls
from gleaner.operators import dedupe, diagnostics, gates, planning, report, resolve, score, select
from gleaner.plans.common import number, table

LABELS = {"insult": ["idiot", "stupid", "trash"], "article": ["the", "une", "der"], "rail": ["onre", "erth"]}
NEGATORS = ["of", "and"]


def q1_query_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of families, regions and languages, each once, under a cap of 60."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") % 3).alias("lang"))
    families = spark.createDataFrame([(0, "opening"), (1, "incident"), (2, "tender")], "f int, family string")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    langs = n.select("lang").distinct()
    return planning.plan_queries([families, regions, langs], F.concat_ws(" ", "family", "r_name", F.when(F.col("lang") == 2, "0").otherwise(F.col("lang").cast("string"))), ["f", "r_regionkey", "lang"], 60).select("query", "family", "r_name", "lang")


def q4_canonical_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's first part of a preferred type, else its first."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_type"), "p_partkey", "p_name")
    return planning.canonical_template(p, "p_brand", "p_type", "p_partkey", "ECONOMY")


def q11_temporal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    periods = table(spark, sf_dir, "orders").agg(F.add_months(F.max(day), -12).alias("start"), F.date_add(F.max(day), 1).alias("stop"))
    specs = table(spark, sf_dir, "region").select(F.col("r_name").alias("family"))
    return planning.temporal_plan(periods, "start", "stop", specs, "family").select("route_id", "label", "family", "bucket_start", "bucket_end", "n_raw")


def q13_reserve_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as specs by lane: reserves first, what is left of a cap of 50 for the core: a top-k report."""
    lane = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "P", "pending").otherwise("core")
    o = table(spark, sf_dir, "orders").select("o_orderkey", lane.alias("lane"))
    return planning.within_budget(o, "lane", "o_orderkey", 50, {"urgent": 12, "pending": 8})


def r6_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the nations that belong to selected regions."""
    members = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("region"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "region")
    return resolve.roll_up(c, "region", members).groupBy("region").agg(F.count("*").alias("n_customers"))


def r7_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of conversations' turns by un-negated terms, the first label corrected where another stands beside it."""
    found = resolve.multi_label({"text": F.col("text")}, LABELS, NEGATORS)
    names = F.transform(found, lambda f: f["label"])
    c = table(spark, sf_dir, "conversations").select("role", names.alias("l"))
    fixed = resolve.correct_labels(F.col("l"), [(F.array_contains("l", "insult"), "flagged")], [(F.array_contains("l", "rail"), "article")])
    return c.select("role", F.array_join(fixed, "+").alias("labels")).groupBy("role", "labels").agg(F.count("*").alias("n"))


def r10_publication_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of lines from several places that may differ."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    ship = F.col("l_shipdate").cast("date")
    values = [("page", F.when(F.col("l_partkey") % 4 == 0, ship)), ("feed", F.when(F.col("l_partkey") % 3 == 0, F.date_add(ship, F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(0)))), ("raw", F.when(F.col("l_quantity") > 10, ship))]
    p = l.select(resolve.pick_publication(values).alias("p"))
    return p.groupBy(F.coalesce("p.origin", F.lit("none")).alias("origin"), F.array_join("p.conflicts", ",").alias("conflicts")).agg(F.count("*").alias("n"), F.min("p.value").alias("first"))


def g12_three_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("size")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = gates.three_state((F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("size") > 1000) & F.col("toxic").isNull())
    return d.groupBy("lang", state.alias("state")).agg(F.count("*").alias("n"))


def g19_beyond_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say more than the turn before them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.meaningful_tokens("text", ["the"]).alias("t"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("b"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", gates.beyond_title(F.col("t"), F.col("b")).alias("more"))


def u9_source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.domain("url")
    kind = urls.source_class(host, [("spam", ["spam-farm.example.org", "casino-win.example.com"]), ("network", ["example.net"]), ("company", ["example.com"])], "other")
    origin = urls.original_domain(F.when(F.col("page_id") % 5 == 0, F.lit("https://www.origin.example/x")), F.when(F.col("page_id") % 3 != 0, F.col("url")), F.lit("site:query.example rail"))
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind"), F.coalesce(F.when(origin.isin("origin.example", "query.example"), origin), F.lit("own")).alias("origin")).agg(F.count("*").alias("n"))


def d6_duplicate_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of equal title with the id of the first of them."""
    p = table(spark, sf_dir, "pages").select("page_id", text.normalize_title(F.regexp_extract("html", "(?s)<title>([^<]*)</title>", 1)).alias("title"))
    first = p.groupBy("title").agg(F.min("page_id").alias("leader"))
    return p.join(first, "title").where("leader <> page_id").select("page_id", "leader")


def d6_same_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal normalised whole text with the id of the first of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_title("text"), 256).alias("text_hash"))
    first = d.groupBy("text_hash").agg(F.min("doc_id").alias("leader"))
    return d.join(first, "text_hash").where("leader <> doc_id").select("doc_id", "leader")


def d14_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each url without its query."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.dedupe_url("url").alias("key"))
    return dedupe.best_by(p, "key", F.col("page_id"), ["page_id", "url"])


def a2_grouping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, by priority, by both and in all, in one pass."""
    o = table(spark, sf_dir, "orders")
    measures = [F.count("*").alias("n"), F.max("o_totalprice").alias("highest")]
    return diagnostics.grouping_summary(o, [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], []], measures)


def a3_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "error").when(number() < 20, "empty").when(F.col("event_type") == "signup", "redirect").otherwise("ok")
    e = table(spark, sf_dir, "events").withColumn("source", F.col("user_id") % 20)
    return diagnostics.source_health(e, "source", outcome, number() % 7 == 0)


def a10_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("cheap", F.col("p_retailprice") >= 1000), ("large", F.col("p_size") <= 25), ("brand", F.col("p_brand").endswith("1"))]
    p = table(spark, sf_dir, "part").select("p_type", gates.failures(checks).alias("f"))
    return diagnostics.list_counts(p, "f", ["p_type"])


def a12_top_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best customers that a rule excludes, with a bonus by segment: a top-k report."""
    c = table(spark, sf_dir, "customer").withColumn("reason", F.when(F.col("c_nationkey") < 5, "region").when(F.col("c_custkey") % 6 == 0, "quota"))
    bonus = F.when(F.col("c_mktsegment") == "MACHINERY", 20).when(F.col("c_mktsegment") == "BUILDING", 12).otherwise(0)
    return select.top_excluded(c, "reason", F.round(F.col("c_acctbal") / 100) + bonus, [F.asc("c_custkey")]).select("c_custkey", "reason", F.col("rank_score").cast("long").alias("rank_score"))


def a15_lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the number of event types that they have, and how many of these are of several lanes."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("lanes"))
    each = u.select("user_id", F.size("lanes").alias("k"), F.explode("lanes").alias("lane"))
    return each.groupBy("lane").agg(F.count("*").alias("n_users"), F.count_if(F.col("k") > 1).alias("n_multi"))


def c2_innovation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped sum of signals, its level and the bonus that it gives."""
    t = F.col("text")
    steps = [("novelty", "add", text.contains_any(t, ["onre"]), 5), ("use", "add", text.contains_any(t, ["erth", "und"]), 4), ("effect", "add", text.near(t, ["the", "de"], r"\d+"), 8), ("numbers", "add", t.rlike(r"\d"), 5), ("special", "add", t.contains("@"), 6), ("length", "add", F.length(t) > 3000, 4)]
    s = score.capped(0, steps, 0, 30)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).groupBy("s").agg(F.count("*").alias("n")).select("s", score.level(F.col("s"), [(15, "A"), (8, "B")], "C").alias("level"), score.bonus(F.col("s"), 0.4, 12).alias("bonus"), "n")


def k8_coverage_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten orders of which one is pending: a top-k report."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    chosen = o.where("o_orderstatus = 'F'").orderBy(*order).limit(10)
    return select.protect_coverage(chosen, o, "o_orderkey", F.col("o_orderstatus") == "P", order, 10)


def o1_prompt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"id": F.col("c_custkey"), "segment": F.col("c_mktsegment"), "note": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))}
    return table(spark, sf_dir, "customer").select("c_custkey", report.payload(fields).alias("payload"))


def o5_block_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of customers whose line of the segment is wrong, missing or without a record."""
    c = table(spark, sf_dir, "customer")
    block = F.concat(F.lit("Name: "), "c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("\nSegment: wrong\nend"))
    blocks = c.select("c_custkey", block.alias("block"))
    return report.overwrite(blocks, c.where("c_custkey % 5 <> 0"), "c_custkey", "Segment", "c_mktsegment").select("c_custkey", "block")


def d13_section_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections by their role: the first of each in a conversation stays."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("key"))
    keep = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("turn"))
    return c.withColumn("rn", keep).where("rn = 1").select("conv_id", "turn", "key")


def d13_whole_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections: of equal normalised whole texts in a conversation the first stays."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.normalize_title(F.coalesce("text", F.lit(""))), 256).alias("text_hash"))
    return c.groupBy("conv_id", "text_hash").agg(F.min("turn").alias("turn"))


QUERIES = {f.__name__: f for f in (q1_query_planner, q4_canonical_template, q11_temporal_plan, q13_reserve_budget, r6_region_rollup, r7_taxonomy, r10_publication_picker, g12_three_state, g19_beyond_title, u9_source_class, d6_duplicate_marking, d6_same_texts, d13_section_dedupe, d13_whole_sections, d14_first_by_key, a2_grouping_summary, a3_source_health, a10_failure_counts, a12_top_excluded, a15_lane_counts, c2_innovation_score, k8_coverage_protection, o1_prompt_payload, o5_block_overwrite)}

_B = "(?:^|[^a-z0-9])(?:{})(?:[^a-z0-9]|$)"
_TITLE = r"trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_K = "(props->>'k')::INTEGER"
_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"


def _under(*domains: str) -> str:
    return "(" + " OR ".join(f"h = '{d}' OR h LIKE '%.{d}'" for d in domains) + ")"


def _positive(terms: list[str]) -> str:
    t, n = _B.format("|".join(terms)), _B.format("|".join(NEGATORS))
    return f"len(list_filter(string_split_regex(lower(text), '[.!?;:。！？；：\\n]'), lambda c: regexp_matches(c, '{t}') AND NOT regexp_matches(string_split_regex(c, '{t}')[1], '{n}'))) > 0"


ORACLE_SQL = {
    "q1_query_planner": """
WITH f(f, family) AS (VALUES (0, 'opening'), (1, 'incident'), (2, 'tender')), l AS (SELECT DISTINCT n_nationkey % 3 AS lang FROM nation),
p AS (SELECT *, family || ' ' || r_name || ' ' || CASE WHEN lang = 2 THEN 0 ELSE lang END AS query FROM f, region, l),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY f, r_regionkey, lang) = 1)
SELECT query, family, r_name, lang FROM u ORDER BY f, r_regionkey, lang LIMIT 60""",
    "q4_canonical_template": "SELECT p_brand, p_type, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type <> 'ECONOMY', p_partkey) = 1",
    "q11_temporal_plan": """
WITH p AS (SELECT (max(o_orderdate)::DATE - INTERVAL 12 MONTH)::DATE AS s, max(o_orderdate::DATE) + 1 AS e FROM orders), q AS (SELECT *, unnest(generate_series(date_trunc('quarter', s), (e - 1)::TIMESTAMP, INTERVAL 3 MONTH))::DATE AS q FROM p)
SELECT year(q) || '-Q' || quarter(q) || ':' || r_name AS route_id, year(q) || '-Q' || quarter(q) AS label, r_name AS family, greatest(q, s) AS bucket_start, least((q + INTERVAL 3 MONTH)::DATE, e) AS bucket_end, 0 AS n_raw FROM q, region""",
    "q13_reserve_budget": """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'core' END AS lane FROM orders)
SELECT o_orderkey, lane FROM o QUALIFY row_number() OVER (PARTITION BY lane ORDER BY o_orderkey) <= CASE lane WHEN 'urgent' THEN 12 WHEN 'pending' THEN 8 ELSE 30 END""",
    "r6_region_rollup": "SELECT c_nationkey AS region, count(*) AS n_customers FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) GROUP BY 1",
    "r7_taxonomy": f"""
WITH c AS (SELECT role, {_positive(LABELS["insult"])} AS i, {" OR ".join(_positive([t]) for t in LABELS["article"])} AS a, {" OR ".join(_positive([t]) for t in LABELS["rail"])} AS r, {" OR ".join(_positive([t]) for t in LABELS["insult"])} AS ii FROM conversations)
SELECT role, coalesce(array_to_string(list_filter([CASE WHEN a AND NOT r THEN 'article' END, CASE WHEN ii THEN 'flagged' END, CASE WHEN ii THEN 'insult' END, CASE WHEN r THEN 'rail' END], lambda x: x IS NOT NULL), '+'), '') AS labels, count(*) AS n FROM c GROUP BY ALL""",
    "r10_publication_picker": """
WITH l AS (SELECT l_shipdate::DATE AS s, CASE WHEN l_partkey % 4 = 0 THEN l_shipdate::DATE END AS page, CASE WHEN l_partkey % 3 = 0 THEN l_shipdate::DATE + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END END AS feed, CASE WHEN l_quantity > 10 THEN l_shipdate::DATE END AS raw FROM lineitem),
p AS (SELECT *, coalesce(page, feed, raw) AS v FROM l)
SELECT CASE WHEN page IS NOT NULL THEN 'page' WHEN feed IS NOT NULL THEN 'feed' WHEN raw IS NOT NULL THEN 'raw' ELSE 'none' END AS origin,
  coalesce(array_to_string(list_filter([CASE WHEN feed <> v THEN 'feed' END, CASE WHEN raw <> v THEN 'raw' END], lambda x: x IS NOT NULL), ','), '') AS conflicts, count(*) AS n, min(v) AS first FROM p GROUP BY ALL""",
    "g12_three_state": """
SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'report_eligible' WHEN length(text) > 1000 AND toxic IS NULL THEN 'watchlist' ELSE 'rejected' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "g19_beyond_title": r"""
WITH c AS (SELECT conv_id, turn, list_filter(string_split_regex(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 3 AND w <> 'the') AS t FROM conversations)
SELECT a.conv_id, a.turn, len(list_filter(a.t, lambda w: NOT list_contains(b.t, w))) > 0 AS more FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
    "u9_source_class": f"""
WITH p AS (SELECT page_id, {_DOMAIN} AS h FROM pages)
SELECT CASE WHEN {_under("spam-farm.example.org", "casino-win.example.com")} THEN 'spam' WHEN {_under("example.net")} THEN 'network' WHEN {_under("example.com")} THEN 'company' ELSE 'other' END AS kind,
  CASE WHEN page_id % 5 = 0 THEN 'origin.example' WHEN page_id % 3 = 0 THEN 'query.example' ELSE 'own' END AS origin, count(*) AS n FROM p GROUP BY ALL""",
    "d6_duplicate_marking": f"""
WITH p AS (SELECT page_id, {_TITLE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages), f AS (SELECT title, min(page_id) AS leader FROM p GROUP BY 1)
SELECT page_id, leader FROM p JOIN f USING (title) WHERE page_id <> leader""",
    "d13_section_dedupe": """
WITH c AS (SELECT conv_id, turn, role AS key FROM conversations)
SELECT conv_id, turn, key FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) = 1""",
    "d6_same_texts": f"""
WITH d AS (SELECT doc_id, {_TITLE.format("text")} AS title FROM documents WHERE text IS NOT NULL), f AS (SELECT title, min(doc_id) AS leader FROM d GROUP BY 1)
SELECT doc_id, leader FROM d JOIN f USING (title) WHERE doc_id <> leader""",
    "d13_whole_sections": f"""
WITH c AS (SELECT conv_id, turn, sha256({_TITLE.format("coalesce(text, '')")}) AS text_hash FROM conversations) SELECT conv_id, text_hash, min(turn) AS turn FROM c GROUP BY ALL""",
    "d14_first_by_key": """
WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[;?#].*$', ''), '/+$', '') AS key FROM pages) SELECT key, page_id, url FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1""",
    "a2_grouping_summary": """
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n, max(o_totalprice) AS highest FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), max(o_totalprice) FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'o_orderstatus+o_orderpriority', o_orderstatus || '+' || o_orderpriority, count(*), max(o_totalprice) FROM orders GROUP BY o_orderstatus, o_orderpriority
UNION ALL SELECT '', '', count(*), max(o_totalprice) FROM orders""",
    "a3_source_health": f"""
WITH e AS (SELECT user_id % 20 AS source, CASE WHEN event_type = 'error' THEN 'error' WHEN {_K} < 20 THEN 'empty' WHEN event_type = 'signup' THEN 'redirect' ELSE 'ok' END AS o, {_K} % 7 = 0 AS f FROM events)
SELECT source, count(*) FILTER (o = 'ok') AS ok, count(*) FILTER (o = 'empty') AS empty, count(*) FILTER (o = 'error') AS error, count(*) FILTER (o = 'redirect') AS other, count(*) FILTER (f) AS fallback FROM e GROUP BY source""",
    "a10_failure_counts": """
SELECT p_type, 'cheap' AS item, count(*) AS n FROM part WHERE p_retailprice < 1000 GROUP BY 1 UNION ALL SELECT p_type, 'large', count(*) FROM part WHERE p_size > 25 GROUP BY 1
UNION ALL SELECT p_type, 'brand', count(*) FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1""",
    "a12_top_excluded": """
WITH c AS (SELECT *, CASE WHEN c_nationkey < 5 THEN 'region' WHEN c_custkey % 6 = 0 THEN 'quota' END AS reason, (round(c_acctbal / 100) + CASE c_mktsegment WHEN 'MACHINERY' THEN 20 WHEN 'BUILDING' THEN 12 ELSE 0 END)::BIGINT AS rank_score FROM customer)
SELECT c_custkey, reason, rank_score FROM c WHERE reason IS NOT NULL ORDER BY rank_score DESC, c_custkey LIMIT 20""",
    "a15_lane_counts": """
WITH l AS (SELECT DISTINCT user_id, event_type AS lane FROM events), k AS (SELECT user_id, count(*) AS k FROM l GROUP BY 1) SELECT lane, count(*) AS n_users, count(*) FILTER (k > 1) AS n_multi FROM l JOIN k USING (user_id) GROUP BY lane""",
    "c2_innovation_score": f"""
WITH d AS (SELECT lower(replace(text, 'ß', 'ss')) AS t, text FROM documents), s AS (SELECT least(30, CASE WHEN regexp_matches(t, '{_B.format("onre")}') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(t, '{_B.format("erth|und")}') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '(^|[^a-z0-9])(the|de)([^a-z0-9]|$)(.{{0,79}}[0-9])', 's') OR regexp_matches(t, '[0-9]([^a-z0-9](the|de)([^a-z0-9]|$)|.{{0,79}}[^a-z0-9](the|de)([^a-z0-9]|$))', 's') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[0-9]') THEN 5 ELSE 0 END + CASE WHEN contains(text, '@') THEN 6 ELSE 0 END + CASE WHEN length(text) > 3000 THEN 4 ELSE 0 END)::INTEGER AS s FROM d)
SELECT s, CASE WHEN s >= 15 THEN 'A' WHEN s >= 8 THEN 'B' ELSE 'C' END AS level, least(12, round(s * 0.4))::INTEGER AS bonus, count(*) AS n FROM s GROUP BY s""",
    "k8_coverage_protection": """
(SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 9) UNION ALL (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""",
    "o1_prompt_payload": """
SELECT c_custkey, '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"note":"' || c_name || '"' ELSE '' END || '}' AS payload FROM customer""",
    "o5_block_overwrite": """
SELECT c_custkey, 'Name: ' || c_name || CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'Segment: wrong' || chr(10) || 'end' END
  WHEN c_custkey % 3 = 0 THEN chr(10) || 'Segment: ' || c_mktsegment ELSE chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'end' END AS block FROM customer""",
}
