"""Queries of event identities, on the texts of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as texts
from gleaner.functions import urls
from gleaner.operators import identity, leaders
from gleaner.plans.common import table
from gleaner.scratch import materialize

CITIES = ["thanly", "erinon", "oscoco", "pfenie", "schver", "thinen", "thonan", "eauoi", "einch", "eresnd", "tionque", "tzstzu", "chier", "ingtion", "erung", "queaux", "ieheit", "ingly", "trean", "heing", "ingsh", "ueasga", "schkeit", "doque", "trech", "narll"]
OPERATORS = ["ingha", "einein", "hestwh", "oument", "ththly", "doque"]
PROJECTS = ["statre", "anreed", "onerntat", "oueau", "thlyly", "ththan", "enque", "enein", "geheit", "thonth"]
INCIDENTS, OBJECTS, VENDORS = ["thintion", "euxaux", "zukeitpf"], ["ndtion", "ungsch", "esing", "thther"], ["teach", "enierier"]
PACKAGES = [("signals", ["eneautre", "laleen"]), ("power", ["therhean", "enver"])]
BOUGHT, OTHER = [("award", ["that"]), ("tender", ["pour", "nicht"])], [("upgrade", ["with"]), ("opening", ["attion"])]
CONTRACT, STATIONS, HURT = r"\+1 \(([0-9]{3})\)", r"(thth[a-z]{2}tion)", r"track\([0-9]*([0-9])\)"
RULES = identity.IdentityRules(
    named={"city": [(c, [c]) for c in CITIES], "operator": [(o, [o]) for o in OPERATORS], "project": [(p, [p]) for p in PROJECTS], "package": PACKAGES, "vendor": [(v, [v]) for v in VENDORS], "incident_type": [(i, [i]) for i in INCIDENTS], "event_object": [(o, [o]) for o in OBJECTS]},
    country_of={c: f"{c[0]}land" for c in CITIES if c[0] != "t"}, contract=CONTRACT, stations=STATIONS, purchase_actions=BOUGHT, purchase_terms=["that", "pour", "nicht"], other_actions=OTHER, hurt=(HURT,), many_hurt=("the and",),
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, report, category, date, date_kind, url_key, title_key, facts`` of each page: its whole text, its title and address; the date of the event of its number."""
    p = table(spark, sf_dir, "pages")
    dated = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").cast("date").alias("date"))
    title, language = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("url", "^https?://[^/]*/([a-z]{2})/", 1)
    facts = F.struct(language.alias("region"), texts.token_set(title, "ing[a-z]*").alias("lines"), texts.token_set(title, r"\d+").alias("numbered_lines"), texts.token_set(title, "[a-z]*ou[a-z]*").alias("entities"), F.col("date"))
    return p.join(dated, "page_id", "left").select(
        F.col("page_id").alias("ord"), F.col("html").alias("report"), F.when(language == "es", "incident").alias("category"), "date", F.when(urls.domain("url").endswith(".com"), "publication_date").otherwise("incident_date").alias("date_kind"),
        F.regexp_replace("url", "[?#].*", "").alias("url_key"), texts.normalize_title(title).alias("title_key"), facts.alias("facts"),
    )


def identified(rows: DataFrame, rules: identity.IdentityRules = RULES) -> DataFrame:
    return identity.with_identity(rows, identity.identity(F.col("report"), F.col("category"), F.col("date"), F.col("date_kind"), rules))


def d1_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each report's identity and its id."""
    i = identified(reports(spark, sf_dir))
    return i.select("ord", *[F.col(f"identity.{n}").alias(n) for n in ("event_class", "country", "project", "package", "contract", "action", "event_object", "vendor", "injury_count")], F.array_join("identity.stations", ",").alias("stations"), "event_id")


def d2_identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one city and operator compared: whether they tell of one event, what they share and where they differ."""
    i = materialize(identified(reports(spark, sf_dir)).select("ord", "identity", "identity.city", "identity.operator", F.regexp_extract("url_key", "^https?://([^/]*)", 1).alias("host")), "identities")
    met = identity.group_pairs(i, ["city", "operator"], "ord", ["identity", "host"])
    met = met.withColumn("c", identity.compare("a_identity", "b_identity", F.col("a_host") == F.col("b_host")))
    return met.select("a_ord", "b_ord", "c.same_event", "c.article_duplicate", F.array_join("c.matched", ",").alias("matched"), F.array_join("c.conflicts", ",").alias("conflicts"), F.col("c.days").alias("days"), "c.window")


def d3_identity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by the blocks of their identities."""
    i = identified(reports(spark, sf_dir)).select(F.explode(identity.identity_keys()).alias("block"))
    return i.groupBy("block").agg(F.count("*").alias("n"))


def d4_event_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that follow an earlier leader by url, title, similar title or event."""
    rows = materialize(identified(reports(spark, sf_dir)), "reports")
    return leaders.event_leaders(rows, similar=0.84, facts="facts", conflict=identity.title_conflict)


def d5_title_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation whose sets of numbers, names or dates keep them apart."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(
        F.when(F.col("turn") % 5 == 0, "r1").when(F.col("turn") % 3 == 0, "r2").otherwise("").alias("region"), texts.token_set("text", "[a-z]*zz[a-z]*").alias("lines"), texts.token_set("text", r"\d+").alias("numbered_lines"),
        texts.token_set("text", "[a-z]*ould[a-z]*").alias("entities"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 5 * F.col("turn") % 23).cast("int")).alias("date"),
    ).alias("t"))
    a, b = t.withColumnRenamed("t", "a"), t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", identity.title_conflict("a", "b").alias("conflict"))


QUERIES = {f.__name__: f for f in (d1_identities, d2_identity_pairs, d3_identity_blocks, d4_event_leaders, d5_title_conflicts)}


def _first(groups: list[tuple[str, list[str]]], text: str = "t") -> str:
    """SQL of the first group that a text has a term of."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?:^|[^a-z0-9])(?:{'|'.join(terms)})(?:[^a-z0-9]|$)') THEN '{name}'" for name, terms in groups) + " END"


_SELF = lambda names: [(n, [n]) for n in names]
_REPORTS = f"""
r0 AS (SELECT page_id AS ord, replace(lower(html), 'ß', 'ss') AS t, regexp_extract(url, '^https?://[^/]*/([a-z]{{2}})/', 1) = 'es' AS of_incident, regexp_extract(url, '^https?://([^/]*)', 1) AS host, ts::DATE AS date, CASE WHEN regexp_matches(url, '^https?://[^/?#]*\\.com([/?#:]|$)') THEN 'publication_date' ELSE 'incident_date' END AS date_kind FROM pages LEFT JOIN events ON event_id = page_id),
r1 AS (SELECT *, {_first(_SELF(INCIDENTS))} AS incident_type, {_first(_SELF(CITIES))} AS city, {_first(_SELF(OPERATORS))} AS operator, {_first(_SELF(PROJECTS))} AS project, {_first(PACKAGES)} AS package, {_first(_SELF(VENDORS))} AS vendor, {_first(_SELF(OBJECTS))} AS object0, {_first(BOUGHT)} AS buying, {_first(OTHER)} AS doing,
  nullif(regexp_extract(t, '{CONTRACT}', 1), '') AS contract, list_sort(list_distinct(regexp_extract_all(t, '{STATIONS}', 1))) AS stations, coalesce(nullif(regexp_extract(t, '{HURT}', 1), '')::INTEGER, CASE WHEN contains(t, 'the and') THEN CASE WHEN contains(t, '14') THEN 14 ELSE 12 END END) AS injury_count FROM r0),
r AS (SELECT *, CASE WHEN incident_type IS NOT NULL OR of_incident THEN 'incident' WHEN buying IS NOT NULL THEN 'procurement' ELSE 'general' END AS event_class, CASE WHEN city[1] <> 't' THEN city[1] || 'land' END AS country, CASE WHEN buying IS NOT NULL THEN buying WHEN incident_type IS NOT NULL OR of_incident THEN 'incident' ELSE coalesce(doing, 'event') END AS action FROM r1),
i AS (SELECT *, coalesce(object0, package, CASE WHEN len(stations) > 0 AND action = 'opening' THEN 'station' END) AS event_object FROM r)"""


def _json(name: str, value: str | None = None) -> str:
    value = value or name
    return f"""'"{name}":' || coalesce('"' || {value} || '"', 'null')"""


_ID = " || ',' || ".join([_json("action"), _json("city"), _json("contract"), """'"contract_version":"1"'""", _json("country"), _json("event_class"), _json("event_date", "date::VARCHAR"), _json("event_date_kind", "date_kind"), _json("event_object"), _json("incident_type"), """'"injury_count":' || coalesce(injury_count::VARCHAR, 'null')""", _json("operator"), _json("package"), _json("project"), """'"stations":[' || array_to_string(list_transform(stations, lambda x: '"' || x || '"'), ',') || ']'""", _json("vendor")])
_SAME = lambda n: f"coalesce(a.{n} = b.{n}, false)"
_DIFF = lambda n: f"coalesce(a.{n} <> b.{n}, false)"
_NAMES = lambda names: ", ".join(f"CASE WHEN {_SAME(n)} THEN '{m}' END" for n, m in names)

ORACLE_SQL = {
    "d1_identities": f"WITH {_REPORTS} SELECT ord, event_class, country, project, package, contract, action, event_object, vendor, injury_count, array_to_string(stations, ',') AS stations, 'evt_' || substr(sha256('{{' || {_ID} || '}}'), 1, 24) AS event_id FROM i",
    "d2_identity_pairs": f"""
WITH {_REPORTS}, p AS (SELECT a.ord AS a_ord, b.ord AS b_ord, a.host = b.host AS same_url, list_has_any(a.stations, b.stations) AS same_station, len(a.stations) > 0 AND len(b.stations) > 0 AND NOT list_has_any(a.stations, b.stations) AS diff_station, a.event_class AS ac, a.event_class = b.event_class AS one_class, abs(a.date - b.date)::INTEGER AS days, a.date_kind <> 'publication_date' AND b.date_kind <> 'publication_date' AS certain, a.action = 'award' AND b.action = 'award' AS awards,
  {", ".join(f"{_SAME(n)} AS same_{n}, {_DIFF(n)} AS diff_{n}" for n in ("country", "city", "operator", "project", "package", "contract", "vendor", "action", "incident_type", "event_object", "injury_count"))},
  a.package IS NULL AND b.package IS NULL AS unpacked FROM i a JOIN i b ON a.city = b.city AND a.operator = b.operator AND a.ord < b.ord),
q AS (SELECT *, one_class AND ac = 'procurement' AS bought, one_class AND ac = 'incident' AS inc, one_class AND ac = 'general' AS gen, CASE WHEN one_class AND ac = 'procurement' AND awards AND NOT certain THEN 21 ELSE 3 END AS win FROM p),
c AS (SELECT *, concat_ws(',', CASE WHEN diff_country THEN 'country' END, CASE WHEN diff_city THEN 'city' END, CASE WHEN diff_project THEN 'project' END, CASE WHEN diff_package THEN 'package' END, CASE WHEN diff_contract THEN 'contract' END, CASE WHEN bought AND diff_vendor THEN 'vendor' END, CASE WHEN bought AND diff_action THEN 'procurement_action' END,
  CASE WHEN inc AND diff_incident_type THEN 'incident_type' END, CASE WHEN gen AND diff_event_object THEN 'event_object' END, CASE WHEN (inc OR gen) AND diff_station THEN 'station' END, CASE WHEN gen AND diff_action THEN 'action' END, CASE WHEN certain AND days > win THEN 'event_date_window' END) AS conflicts FROM q),
d AS (SELECT *, conflicts = '' AND same_url AS article, conflicts = '' AND NOT same_url AND inc AND same_incident_type AS of_i, conflicts = '' AND NOT same_url AND bought AND same_action AS of_b, conflicts = '' AND NOT same_url AND one_class AND NOT (inc AND same_incident_type) AND NOT (bought AND same_action) AS of_o FROM c)
SELECT a_ord, b_ord, article OR (of_i AND same_city::INT + 3 * same_station::INT + same_operator::INT + same_event_object::INT + 2 * same_injury_count::INT >= 2 AND (same_country OR same_city OR same_station))
    OR (of_b AND same_project AND (same_package OR same_contract OR (unpacked AND days <= 3)))
    OR (of_o AND (same_city OR same_operator OR same_project) AND (same_project OR same_event_object OR same_station) AND same_city::INT + same_operator::INT + same_project::INT + same_event_object::INT + same_action::INT >= 2) AS same_event,
  article AS article_duplicate, conflicts, days, win AS window,
  CASE WHEN article THEN 'canonical_article_url' WHEN of_i THEN concat_ws(',', 'incident_type', CASE WHEN same_city THEN 'city' WHEN same_country THEN 'country' END, CASE WHEN same_station THEN 'station' END, CASE WHEN same_operator THEN 'operator' END, CASE WHEN same_event_object THEN 'event_object' END, CASE WHEN same_injury_count THEN 'injury_count' END, 'bounded_date')
    WHEN of_b THEN concat_ws(',', CASE WHEN same_project THEN 'project' END, CASE WHEN same_package THEN 'package' END, CASE WHEN same_contract THEN 'contract' END, CASE WHEN same_vendor THEN 'vendor' END, 'bounded_date')
    WHEN of_o THEN concat_ws(',', CASE WHEN same_city THEN 'city' END, CASE WHEN same_operator THEN 'operator' END, CASE WHEN same_project THEN 'project' END, CASE WHEN same_event_object THEN 'event_object' END, CASE WHEN same_action THEN 'action' END, CASE WHEN same_station THEN 'station' END, 'bounded_date') ELSE '' END AS matched FROM d""",
    "d3_identity_blocks": f"""
WITH {_REPORTS}, g AS (SELECT *, event_class <> 'procurement' AND NOT (event_class = 'incident' AND incident_type IS NOT NULL) AS free FROM i),
k AS (SELECT 'procurement|' || action || '|' || project AS block FROM i WHERE event_class = 'procurement'
  UNION ALL SELECT 'incident|' || incident_type || '|city|' || city FROM i WHERE event_class = 'incident' UNION ALL SELECT 'incident|' || incident_type || '|country|' || country FROM i WHERE event_class = 'incident' UNION ALL SELECT 'incident|' || incident_type || '|station|' || unnest(stations) FROM i WHERE event_class = 'incident'
  {" ".join(f"UNION ALL SELECT 'general|' || event_class || '|{a}|' || {a} || '|{b}|' || {b} FROM g WHERE free" for n, a in enumerate(("city", "operator", "project", "event_object", "action")) for b in ("city", "operator", "project", "event_object", "action")[n + 1:] if n < 3)})
SELECT block, count(*) AS n FROM k WHERE block IS NOT NULL GROUP BY 1""",
    "d5_title_conflicts": r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'r1' WHEN turn % 3 = 0 THEN 'r2' ELSE '' END AS region, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z]*zz[a-z]*') AS l, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\d+') AS n, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z]*ould[a-z]*') AS e, '2024-01-01'::DATE + (conv_id % 5 * turn % 23)::INTEGER AS date FROM conversations)
SELECT a.conv_id, a.turn, (a.region <> '' AND b.region <> '' AND a.region <> b.region) OR (len(a.l) > 0 AND len(b.l) > 0 AND NOT list_has_any(a.l, b.l)) OR (len(a.n) > 0 AND len(b.n) > 0 AND NOT list_has_any(a.n, b.n)) OR (len(a.e) > 0 AND len(b.e) > 0 AND NOT list_has_any(a.e, b.e)) OR abs(a.date - b.date) > 7 AS conflict
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
}
