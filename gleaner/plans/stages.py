"""Queries of staged work: quarter queues, admission, the cascade of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text, urls
from gleaner.operators import evidence, intervals, queues, report, verdicts
from gleaner.plans.common import table

SHELLS = evidence.Shells(("es",), ("fr",), ("license", "redistribut"), ("onre", "thble"), ("the", "que", "of", "ther", "and"), ("the", "and"), {"blocked_paths": [], "blocked_hosts": ["spam-farm.example.org"], "blocked_suffixes": ["html"]})


def k12_quarter_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 orders by turns of the quarters' queues, the dearest first, at most 20 urgent ones."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("bucket"), "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return queues.queue_budget(o, "bucket", [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("urgent"), 120, 20).select("o_orderkey", "bucket", "urgent", F.col("place").cast("long").alias("place"))


def s8_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results of three stages by language: English and German stop at 150 admitted, the others don't; a third needs a lookup, of which there are 40, 5 for a source."""
    stage = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (stage * 1_000_000_000_000 + F.col("doc_id")).alias("ord"), (stage < 2).alias("stops"), (F.col("n_chars") >= 300).alias("eligible"), (F.col("doc_id") % 3 == 0).alias("needs"), F.col("text").contains("tion").alias("resolves"),
        F.concat_ws("/", "source", F.col("doc_id") % 97).alias("url"), F.col("source").alias("route"), F.md5("text").alias("key"), (F.col("n_chars") >= 600).alias("scored"),
    )
    return queues.admit(rows, 150, 5, 40).select("doc_id", "outcome", "lookup")


def _places(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """Where the text of a page is looked for: its article, its whole html, the document of its number, its first paragraph."""
    p = table(spark, sf_dir, "pages")
    article = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", F.lit(None).cast("string").alias("url"))
    return [
        ("resolved", p.where("page_id % 3 = 0").select("page_id", article.alias("text"), "url")), ("direct", p.where("page_id % 5 <> 0").select("page_id", F.col("html").alias("text"), "url")),
        ("source", docs), ("snippet", p.select("page_id", F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("text"), F.lit(None).cast("string").alias("url"))),
    ]


def s13_evidence_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the first valid evidence for each page's title, or the last reason against what was found."""
    wanted = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    found, _ = evidence.cascade(wanted, "page_id", "title", _places(spark, sf_dir), SHELLS)
    return found.select("page_id", "place", "reason", F.length("text").alias("size"))


def r15_evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each page's html is no evidence for its own title, by the reason."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    reason = evidence.evidence_reason(title, F.col("html"), F.col("url"), SHELLS)
    return table(spark, sf_dir, "pages").select(F.coalesce(reason, F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def j6_event_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the overlapping periods of their type that they lie in, made of customers' numbers: one, none or several."""
    types = F.array(*[F.lit(t) for t in ("view", "click", "purchase", "signup", "error")])
    start = F.lit(1704067200) + F.col("c_custkey") % 29 * 86400 + F.col("c_nationkey") * 3600
    made = table(spark, sf_dir, "customer").where("c_custkey % 37 = 0").select(F.element_at(types, (F.col("c_custkey") % 5 + 1).cast("int")).alias("route"), start.alias("start"), (start + (F.col("c_nationkey") % 9 + 1) * 7200).alias("stop"))
    periods = made.distinct().withColumn("label", F.concat_ws("-", "route", "start", "stop"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return intervals.in_periods(e, F.col("at"), F.col("event_type"), periods, "event_id").select("event_id", "n_periods", "label", "status")


def o4_report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reports, their turns as blocks: twelve checks, and what is to be done with each."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    words, has = F.size(F.filter(F.split("text", " "), lambda w: w != "")), lambda *terms: text.contains_any("text", terms)
    checks = [
        verdicts.Check("no_text", F.trim("text") == ""), verdicts.Check("too_short", words < 5), verdicts.Check("too_long", words > 400, "repair"), verdicts.Check("forbidden", has("license")), verdicts.Check("address", F.col("text").contains("@"), "repair"),
        verdicts.Check("numbers", F.col("text").rlike("[0-9]{4}"), "repair"), verdicts.Check("marks", F.col("text").rlike("[#$%&*|]{3}"), "hold"), verdicts.Check("no_end", ~F.rtrim("text").rlike("[.!?]$"), "repair"), verdicts.Check("no_capital", ~F.col("text").rlike("^[A-ZÀ-Þ]"), "repair"),
        verdicts.Check("judge_silent", has("onre") & (F.col("role") == "assistant"), "block"), verdicts.Check("thin", (words >= 5) & (words < 12), "hold"),
    ]
    ends = t.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last")).where("last <> 'assistant'").select("conv_id", F.lit("no_answer").alias("name"), F.lit("retry").alias("level"))
    found = verdicts.judge(t, "conv_id", "turn", checks, ends)
    return found.select("conv_id", "verdict", "n_issues", "n_failed_blocks", "first_block", "first_issue", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("counts"))


def d13_joined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each speaker of a conversation: the turns joined, of turns of one text the first."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.coalesce("text", F.lit("")).alias("text"))
    found = report.merge_sections(t, ["conv_id"], "role", "turn", F.md5(F.lower("text")), "text")
    return found.select("conv_id", "role", F.col("at").alias("first_turn"), "n_blocks", F.md5("body").alias("body"))


def o12_selection_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of an order an answer selects: as JSON, as mentions, as a list, or not at all."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("long"))).alias("candidates"))
    kind, n = F.col("l_orderkey") % 5, F.size("candidates").cast("string")
    answer = (
        F.when(kind == 0, F.concat(F.lit('Here: {"selected_ids": ['), n, F.lit(', {"id": 1}, 99, '), n, F.lit("]}"))).when(kind == 1, F.concat(F.lit("We take ID: "), n, F.lit(" and #1, candidate 77.")))
        .when(kind == 2, F.concat(F.lit("Chosen\n 1. the first\n"), n, F.lit(") the last\n88. none"))).when(kind == 3, F.lit('{"selected_ids": [99]}')).otherwise("nothing of use")
    )
    return lines.select("l_orderkey", report.selected_ids(answer, F.col("candidates"), 3, 2).alias("s")).select("l_orderkey", F.array_join("s.ids", ",").alias("ids"), "s.method")


KINDS = [
    ("index", "/(?:search|index)", ["und"]), ("login", "/(?:login|account)", ["que"]), ("schedule", "/(?:schedule|en/[0-9]{2}$)", []), ("ticketing", "/tickets", ["ticket"]), ("event", "/events", ["ertion"]), ("financial", "/(?:stocks|fr/)", []), ("property", "/es/", ["casa"]), ("crime", "/crime", ["onre"]),
    ("low_information", "/(?:tag|[0-9])$", []), ("people_mover", "/mover", ["thing"]),
]


def u20_all_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all kinds of pages, the first that path or title tells of."""
    p = table(spark, sf_dir, "pages").select(urls.page_kind("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1), KINDS).alias("kind"))
    return p.groupBy("kind").agg(F.count("*").alias("n_pages"))


def f21_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notices of standards: identifier, body, kind of update, edition; and what their titles are."""
    notice = F.concat(F.lit("EN "), F.col("p_partkey") % 900 + 100, F.when(F.col("p_size") % 3 == 0, " edition of ").when(F.col("p_size") % 3 == 1, " (version: ").otherwise(" of "), F.col("p_size") % 30 + 2000, F.lit(" "), F.lower("p_name"), F.when(F.col("p_size") % 5 == 0, " ...").otherwise(""))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", notice.alias("notice"))
    identifier = text.standard_id("notice", ["EN", "ISO"])
    body = text.standard_body("notice", identifier, [("CEN", r"\bred\b"), ("ISO", r"\bblue\b")])
    kind = text.update_kind("notice", [("draft", ["green", "small"]), ("withdrawn", ["red"]), ("published", ["blue", "large"])])
    generic = text.is_generic_title("p_name", ["small part"], ["small", "large", "part", "ring", "red"], ["the"])
    return p.select("p_partkey", identifier.alias("identifier"), body.alias("body"), kind.alias("kind"), text.edition_year("notice", ["edition", "version"]).alias("edition"), text.is_truncated("notice").alias("truncated"), generic.alias("generic"))


QUERIES = {f.__name__: f for f in (k12_quarter_queues, s8_admission, s13_evidence_cascade, r15_evidence_reasons, j6_event_periods, o4_report_verdicts, d13_joined_sections, o12_selection_answers, u20_all_page_kinds, f21_standards)}

_PATH = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_HOST = "regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
_CLEAN = lambda c: f"trim(regexp_replace(replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '[\\t\\n\\x0B\\f\\r \\x{{00A0}}]+', ' ', 'g'))"
_CUT = lambda c: f"CASE WHEN length({c}) > 6000 THEN rtrim(substr({c}, 1, 5999)) || '…' ELSE {c} END"
_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(replace(lower({c}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and')))"
_HAS = lambda *marks: " + ".join(f"contains(f, '{m}')::INT" for m in marks)
#: Of rows with t (title), x (text) and u (url), the reason.
_JUDGED = lambda source: f"""(SELECT *, CASE WHEN length(c) < 120 THEN 'insufficient_text' WHEN len(tw) = 0 THEN 'missing_target_title'
  WHEN u IS NOT NULL AND (replace({_PATH}, '/', '') = '' OR lower({_PATH}) LIKE '%.html' OR {_HOST} = 'spam-farm.example.org' OR {_HOST} LIKE '%.spam-farm.example.org') THEN 'non_article_url'
  WHEN u IS NOT NULL AND {_PATH} LIKE '/es/%' THEN 'search_results_page' WHEN s >= 2 OR (s >= 1 AND NOT met) THEN 'search_results_shell'
  WHEN i >= 2 OR (i >= 1 AND NOT met) OR (u IS NOT NULL AND {_PATH} LIKE '/fr/%' AND NOT met) THEN 'index_or_navigation_shell' WHEN n >= 4 AND NOT met THEN 'generic_navigation_boilerplate' WHEN NOT met THEN 'target_title_mismatch' END AS reason
  FROM (SELECT *, {_HAS("license", "redistribut")} AS s, {_HAS("onre", "thble")} AS i, {_HAS("the", "que", "of", "ther", "and")} AS n, len(list_intersect(tw, {_WORDS("c")})) >= CASE WHEN len(tw) <= 2 THEN 1 ELSE 2 END AS met
  FROM (SELECT *, replace(lower(c), 'ß', 'ss') AS f, {_WORDS("t")} AS tw FROM (SELECT *, {_CUT("c0")} AS c FROM (SELECT *, {_CLEAN("x")} AS c0 FROM {source})))))"""  # noqa: E731
_STEP = lambda k, before: f"""j{k} AS (SELECT * FROM {_JUDGED(f"(SELECT b.id, b.t, b.last, p.x, p.u FROM {before} b LEFT JOIN p{k} p USING (id))")}),
r{k} AS (SELECT id, t, x, CASE WHEN coalesce(length(x), 0) = 0 THEN 'not_there' ELSE reason END AS reason, last FROM j{k}), l{k} AS (SELECT id, t, CASE WHEN reason = 'not_there' THEN last ELSE reason END AS last FROM r{k} WHERE reason IS NOT NULL)"""  # noqa: E731
_PLACES = ["resolved", "direct", "source", "snippet"]
_LOOKUPS = lambda rows, used, left: f"""SELECT url, route, place FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY place) AS n FROM (SELECT url, min(ord) AS place, arg_min(route, ord) AS route FROM d WHERE {rows} AND eligible AND needs {used} GROUP BY url)) f"""

_CHECKS = [
    ("no_text", "trim(t) = ''", "retry"), ("too_short", "w < 5", "retry"), ("too_long", "w > 400", "repair"), ("forbidden", "regexp_matches(lower(t), '(?:^|[^a-z0-9])license(?:[^a-z0-9]|$)')", "retry"), ("address", "contains(t, '@')", "repair"), ("numbers", "regexp_matches(t, '[0-9]{4}')", "repair"),
    ("marks", "regexp_matches(t, '[#$%&*|]{3}')", "hold"), ("no_end", "NOT regexp_matches(rtrim(t, ' '), '[.!?]$')", "repair"), ("no_capital", "NOT regexp_matches(t, '^[A-ZÀ-Þ]')", "repair"), ("judge_silent", "regexp_matches(lower(t), '(?:^|[^a-z0-9])onre(?:[^a-z0-9]|$)') AND role = 'assistant'", "block"), ("thin", "w >= 5 AND w < 12", "hold"),
]

ORACLE_SQL = {
    "d13_joined_sections": """
WITH c AS (SELECT conv_id, role, turn, coalesce(text, '') AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role, md5(lower(coalesce(text, ''))) ORDER BY turn) = 1)
SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n_blocks, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS body FROM c GROUP BY ALL""",
    "o12_selection_answers": """
WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS c, l_orderkey % 5 AS kind FROM lineitem GROUP BY l_orderkey), n AS (SELECT *, len(c) AS n FROM o),
f AS (SELECT *, list_filter(CASE WHEN kind > 2 THEN [] WHEN n = 1 THEN [1] WHEN kind = 2 THEN [1, n] ELSE [n, 1] END, lambda i: list_contains(c, i)) AS found FROM n)
SELECT l_orderkey, CASE WHEN len(found) = 0 THEN 'fallback' ELSE ['json', 'mention', 'list'][kind + 1] END AS method, array_to_string(CASE WHEN len(found) = 0 THEN c[1:2] ELSE found END, ',') AS ids FROM f""",
    "u20_all_page_kinds": f"""
WITH p AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)
SELECT CASE WHEN replace(path, '/', '') = '' THEN 'home' {" ".join(f"WHEN regexp_matches(path, '{at}')" + (f" OR regexp_matches(title, '(?:^|[^a-z0-9])(?:{'|'.join(terms)})(?:[^a-z0-9]|$)')" if terms else "") + f" THEN '{name}'" for name, at, terms in KINDS)}
  WHEN regexp_matches(path, '/[0-9]{{2,}}([./]|$)') THEN 'article' ELSE 'unresolved' END AS kind, count(*) AS n_pages FROM p GROUP BY 1""",
    "f21_standards": """
WITH p AS (SELECT p_partkey, lower(p_name) AS n, p_name, p_size, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND w <> 'the')) AS w FROM part)
SELECT p_partkey, 'EN ' || (p_partkey % 900 + 100) AS identifier, CASE WHEN regexp_matches(n, '\\bred\\b') THEN 'CEN' WHEN regexp_matches(n, '\\bblue\\b') THEN 'ISO' ELSE 'EN' END AS body,
  CASE WHEN regexp_matches(n, '\\b(green|small)\\b') THEN 'draft' WHEN regexp_matches(n, '\\bred\\b') THEN 'withdrawn' WHEN regexp_matches(n, '\\b(blue|large)\\b') THEN 'published' END AS kind,
  CASE WHEN p_size % 3 < 2 THEN p_size % 30 + 2000 END::INTEGER AS edition, p_size % 5 = 0 AS truncated,
  len(w) = 0 OR n = 'small part' OR (len(w) <= 3 AND len(list_filter(w, lambda x: x NOT IN ('small', 'large', 'part', 'ring', 'red'))) = 0) AS generic FROM p""",
    "j6_event_periods": """
WITH p AS (SELECT DISTINCT ['view', 'click', 'purchase', 'signup', 'error'][c_custkey % 5 + 1] AS route, 1704067200 + c_custkey % 29 * 86400 + c_nationkey * 3600 AS start, 1704067200 + c_custkey % 29 * 86400 + c_nationkey * 3600 + (c_nationkey % 9 + 1) * 7200 AS stop FROM customer WHERE c_custkey % 37 = 0),
m AS (SELECT event_id, count(route) AS n, min(route || '-' || start || '-' || stop) AS label FROM (SELECT event_id, event_type, floor(epoch(ts))::BIGINT AS at_s FROM events) e LEFT JOIN p ON route = event_type AND start <= at_s AND at_s < stop GROUP BY 1)
SELECT event_id, n AS n_periods, CASE WHEN n = 1 THEN label END AS label, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'exactly_one' ELSE 'several' END AS status FROM m""",
    "o4_report_verdicts": f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS w FROM conversations),
i AS ({" UNION ALL ".join(f"SELECT conv_id, turn, {k} AS place, '{n}' AS name, '{level}' AS level FROM c WHERE {condition}" for k, (n, condition, level) in enumerate(_CHECKS))}
  UNION ALL SELECT conv_id, NULL, NULL, 'no_answer', 'retry' FROM (SELECT conv_id, arg_max(role, turn) AS last FROM c GROUP BY 1) WHERE last <> 'assistant'),
a AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS blocks, min(turn) AS first_block, coalesce(arg_min(name, turn * 100 + place), min(name)) AS first_issue, bool_or(level = 'retry') AS retry, bool_or(level = 'block') AS block, bool_and(level = 'repair') AS repairs FROM i GROUP BY 1),
k AS (SELECT conv_id, string_agg(name || ':' || n, ',' ORDER BY name) AS counts FROM (SELECT conv_id, name, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT conv_id, CASE WHEN n IS NULL THEN 'ok' WHEN repairs THEN 'repairable' WHEN block OR NOT retry THEN 'fail' ELSE 'retry' END AS verdict, coalesce(n, 0)::BIGINT AS n_issues, coalesce(blocks, 0)::BIGINT AS n_failed_blocks, first_block, first_issue, coalesce(counts, '') AS counts
FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN a USING (conv_id) LEFT JOIN k USING (conv_id)""",
    "k12_quarter_queues": """
WITH o AS (SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS bucket, o_orderpriority = '1-URGENT' AS urgent, o_totalprice FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o_totalprice DESC, o_orderkey) AS t FROM o),
l AS (SELECT *, row_number() OVER (ORDER BY t, bucket) AS p, count(*) FILTER (urgent) OVER (ORDER BY t, bucket) AS seen FROM q),
x AS (SELECT t AS xt, bucket AS xb, p AS xp FROM l WHERE urgent AND seen > 20 ORDER BY p LIMIT 1),
r AS (SELECT *, xt - 1 + row_number() OVER (PARTITION BY bucket ORDER BY t) + (bucket < xb)::INT AS nt FROM l, x WHERE NOT urgent AND (t > xt OR (t = xt AND bucket >= xb)))
SELECT o_orderkey, bucket, urgent, p AS place FROM l WHERE p <= 120 AND p < coalesce((SELECT xp FROM x), 1000000)
UNION ALL SELECT * FROM (SELECT o_orderkey, bucket, urgent, xp - 1 + row_number() OVER (ORDER BY nt, bucket) AS place FROM r) WHERE place <= 120""",
    "s8_admission": f"""
WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END * 1000000000000 + doc_id AS ord, lang IN ('en', 'de') AS stops, n_chars >= 300 AS eligible, doc_id % 3 = 0 AS needs, contains(text, 'tion') AS resolves, source || '/' || doc_id % 97 AS url, source AS route, md5(text) AS key, n_chars >= 600 AS scored FROM documents),
g AS ({_LOOKUPS("stops", "", "")} WHERE n <= 5 ORDER BY place LIMIT 40),
e AS (SELECT d.*, needs AND eligible AND g.url IS NOT NULL AS granted, eligible AND (NOT needs OR (g.url IS NOT NULL AND resolves)) AS passes FROM d LEFT JOIN g ON g.url = d.url WHERE stops),
a AS (SELECT ord FROM (SELECT ord, scored, row_number() OVER (PARTITION BY key ORDER BY ord) AS k FROM e WHERE passes) WHERE k = 1 AND scored ORDER BY ord LIMIT 150),
stop AS (SELECT CASE WHEN count(*) = 150 THEN max(ord) ELSE 9000000000000000 END AS place FROM a),
sp AS (SELECT * FROM g WHERE place <= (SELECT place FROM stop)),
m AS ({_LOOKUPS("NOT stops", "AND url NOT IN (SELECT url FROM sp)", "")} LEFT JOIN (SELECT route AS r, count(*) AS used FROM sp GROUP BY 1) ON r = route WHERE n <= 5 - coalesce(used, 0) ORDER BY place LIMIT 40 - (SELECT count(*) FROM sp)),
gl AS (SELECT url FROM sp UNION SELECT url FROM m),
l AS (SELECT d.*, needs AND eligible AND gl.url IS NOT NULL AS granted, eligible AND (NOT needs OR (gl.url IS NOT NULL AND resolves)) AS passes FROM d LEFT JOIN gl ON gl.url = d.url WHERE NOT stops),
b AS (SELECT *, ord <= (SELECT place FROM stop) AS reached FROM e UNION ALL SELECT *, true FROM l),
f AS (SELECT key, min(ord) AS first FROM b WHERE passes AND reached GROUP BY key)
SELECT doc_id, CASE WHEN NOT reached THEN 'not_reached' WHEN NOT eligible THEN 'ineligible' WHEN needs AND NOT granted THEN 'no_budget' WHEN NOT passes THEN 'unresolved' WHEN first < ord THEN 'duplicate' WHEN scored THEN 'admitted' ELSE 'low_score' END AS outcome, granted AND reached AS lookup
FROM b LEFT JOIN f USING (key)""",
    "s13_evidence_cascade": f"""
WITH w AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, 'not_found' AS last FROM pages),
p0 AS (SELECT page_id AS id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS x, url AS u FROM pages WHERE page_id % 3 = 0), p1 AS (SELECT page_id AS id, html AS x, url AS u FROM pages WHERE page_id % 5 <> 0),
p2 AS (SELECT doc_id AS id, text AS x, NULL::VARCHAR AS u FROM documents), p3 AS (SELECT page_id AS id, regexp_extract(html, '<p>(.*?)</p>', 1, 's') AS x, NULL::VARCHAR AS u FROM pages),
{", ".join(_STEP(k, f"l{k - 1}" if k else "w") for k in range(4))}
SELECT id AS page_id, place, reason, size FROM ({" UNION ALL ".join(f"SELECT id, '{n}' AS place, NULL AS reason, length(x)::INTEGER AS size FROM r{k} WHERE reason IS NULL" for k, n in enumerate(_PLACES))} UNION ALL SELECT id, NULL, last, NULL FROM l3)""",
    "r15_evidence_reasons": f"SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM {_JUDGED('''(SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, html AS x, url AS u FROM pages)''')} GROUP BY 1",
}
