"""Queries of the gates of categories, on the words, sources and lengths of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as texts
from gleaner.operators import category_gates as cg
from gleaner.operators.gates import failures
from gleaner.plans.common import table

#: Signals that hold for about a half and for about a ninth of the rows.
COMMON = ["mode", "operator", "rail_detail", "mode_context", "system", "action", "core_term", "strong_detail", "dispute", "actor", "impact", "dispute_weak", "impact_weak", "dispute_headline", "event", "fault", "disruption", "disruption_impact", "technical_impact", "fault_named", "control", "place", "large_impact", "substantive", "adjustment", "policy", "policy_detail", "opened", "research", "technical_object", "result", "cross_system", "generic_scope", "separate_package", "detailed_design", "emerging", "application_evidence", "forward_object", "application_object", "novelty", "validation", "benefit", "innovation", "high_value", "purchase", "valuable", "lift_technology"]
RARE = ["ambiguous_mode", "road_event", "civic_name", "people_mover_only", "other_transport", "other_transport_strict", "standards_source", "financial", "security", "security_impact", "accessibility_only", "non_core_only", "project_only", "non_technical", "implementation", "low_value", "planned", "minor", "routine", "short_notice", "dispute_dominant", "policy_dominant", "fare_table", "road_riders", "rail_riders", "general_rail", "general_rail_term", "future", "planning", "testing", "structures", "civil", "study", "generic_marketing", "generic_material", "page_term", "notice", "route_term", "radar_only", "long_term_low_value", "list_notice", "report_low_value", "service_page", "official_notice", "notice_detail", "rescue_low_value", "lift"]
FACTS = ["dated", "sourced", "family", "in_scope"]
#: Words of the driver's prose: frequent ones by language, and the syllables that rarer ones are made of.
FREQUENT = (["that", "with", "this", "tion", "from", "ther", "thon", "thth", "than", "thre", "thnt", "thes"], ["nicht", "sich", "mit", "von"], ["pour", "dans", "les", "une"], ["los", "que", "por", "con"])
SYLLABLES = ["er", "on", "an", "re", "ea", "ou", "in", "ed", "nd", "ha", "st", "ti"]


def packs() -> dict[str, list[str]]:
    """The terms of each signal: common ones hold for texts with one of several frequent words, rare ones for texts with one word of two syllables."""
    common = {n: [words[(i + k) % len(words)] for words in FREQUENT for k in (0, 1)] for i, n in enumerate(COMMON)}
    rare = {n: [SYLLABLES[i // len(SYLLABLES) % len(SYLLABLES)] + SYLLABLES[i % len(SYLLABLES)]] for i, n in enumerate(RARE)}
    return common | rare


#: Signals of the first sentence alone; all others are of the whole text.
HEADLINE = ["dispute_headline", "routine", "planned"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows with ``signals`` of their whole texts and the facts that gates ask for, from their texts, sources, languages and lengths."""
    size, has = F.length("text"), lambda mark: F.contains("text", F.lit(mark))
    one_of = lambda at, values: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    terms = packs()
    d = cg.view_signals(d, {"headline": F.substring_index("text", ".", 1), "whole": F.col("text")}, {"headline": {n: terms[n] for n in HEADLINE}, "whole": {n: t for n, t in terms.items() if n not in HEADLINE}})
    listed = lambda pairs: F.array_compact(F.array(*[F.when(has(mark), F.lit(name)) for mark, name in pairs]))
    return d.select(
        "doc_id", "signals", (size >= 150).alias("dated"), (~F.col("source").isin("src3", "src5", "src7")).alias("sourced"), (size % 5 == 0).alias("family"), (F.col("lang") != "de").alias("in_scope"),
        one_of(size, "ABCD").alias("tier"), one_of(F.floor(size / 4), "ABCX").alias("grade"), F.when(F.col("lang").isin("en", "fr"), "news_article").when(F.col("lang") == "es", "portal").otherwise("").alias("page_type"),
        one_of(F.floor(size / 16), ["technology", "accident", "policy", "dispute", "purchase", "excluded", ""]).alias("category"), (size % 100).cast("int").alias("score"), F.col("text").alias("note"),
        F.substring_index("text", ".", 1).alias("title"), F.coalesce(F.get(F.split("text", r"\."), 1), F.lit("")).alias("snippet"),
        listed([("#", "general_rail"), ("@", "service_notice"), ("%", "proxy_page"), ("*", "insufficient")]).alias("flags"), listed([("ung", "ventilation"), ("tion", "signals")]).alias("systems"), listed([("en", "award")]).alias("actions"),
        F.when(F.col("lang") == "en", "/news/a").when(F.col("lang") == "de", "/status/b").otherwise("/list/c").alias("path"), one_of(F.regexp_extract("source", "([0-9]+)", 1).cast("int"), ["low.example", "m.low.example", "fine.example", "gov.example"]).alias("host"),
        F.when(size % 3 < 2, "verified").otherwise("missing_date").alias("status"), F.when(size % 2 == 0, "2024-Q1").otherwise("").alias("bucket"),
    )


def _gates(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with their subject and triad, and the gates of categories."""
    s, col = cg.of(rows), F.col
    rows = rows.withColumn("subject", cg.relevant(s))
    rows = rows.withColumn("triad_failures", failures(cg.technical(s, col("subject")))).withColumn("triad", F.size("triad_failures") == 0).withColumn("doc", cg.documented(col("dated"), col("sourced")))
    subject, doc = col("subject"), col("doc")
    adjustment = cg.service_adjustment(s, subject, doc, col("note"))
    purchase = cg.procurement(s, subject, col("in_scope"), col("systems"), F.array_contains("systems", "signals"), col("actions"), col("dated"), col("sourced"), col("tier"), col("grade"), col("page_type"))
    return rows, {
        "dispute": cg.dispute(s, subject, doc, col("tier")),
        "incident": failures(cg.operation_incident(s, subject, doc)),
        "adjustment": failures(adjustment),
        "policy": cg.policy(s, subject, doc, s("minor") & s("fault"), cg.passed(adjustment), col("triad")),
        "opening": failures(cg.opening(s, subject, doc)),
        "purchase": failures(purchase),
        "research": failures(cg.research(s, subject, doc, cg.passed(purchase))),
    }


def g1_subject_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, triad with all its failures, and dispute of each row."""
    rows, gates = _gates(facts(spark, sf_dir))
    return rows.select("doc_id", "subject", F.array_join("triad_failures", ",").alias("triad_failures"), gates["dispute"].alias("dispute"))


def g5_operation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident, adjustment and opening with their failures, and policy."""
    rows, gates = _gates(facts(spark, sf_dir))
    return rows.select("doc_id", *[F.array_join(gates[g], ",").alias(g) for g in ("incident", "adjustment", "opening")], gates["policy"].alias("policy"))


ACCIDENT = {
    "context": ["the", "la", "der"], "accident": ["that", "une", "und"], "severity": ["this", "pour", "mit"], "equipment": ["erer", "onan"], "direct": ["thing"], "consequence": ["with", "dans"], "research": ["from"], "occurred": ["than"],
    "single": ["anre"], "exception": ["rest"], "road": ["of"], "low_impact": ["in"], "minor": ["is"], "other_context": ["license"],
}
NEGATORS = ["not", "nicht", "to"]


def _accident(rows: DataFrame) -> Column:
    s = cg.of(rows)
    return cg.major_accident(F.col("note"), ACCIDENT, NEGATORS, F.col("subject"), s("security") & ~s("security_impact"))


def g3_major_accident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as accidents of consequence, with what shows it and what is lacking."""
    rows, _ = _gates(facts(spark, sf_dir))
    found = rows.select("doc_id", _accident(rows).alias("a"))
    return found.select("doc_id", "a.passes", F.array_join("a.signals", ",").alias("signals"), F.array_join("a.failures", ",").alias("failures"))


def g13_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates of each document over its headline and its whole text, the reasons, the subtype and the category that wins."""
    rows, g = _gates(facts(spark, sf_dir))
    s, col = cg.of(rows), F.col
    names = ("incident", "adjustment", "opening", "purchase", "research")
    rows = rows.withColumns({"accident": _accident(rows), **{f"f_{n}": g[n] for n in names}, "f_dispute": g["dispute"], "f_policy": g["policy"]})
    rows = rows.withColumn("issue", _issue(rows))
    forward, _, _ = cg.forward(s, col("subject"), col("triad"), col("family"), col("dated"), col("sourced"), col("tier"), col("grade"), col("issue"))
    held = {n: F.size(f"f_{n}") == 0 for n in names}
    none, acted = F.expr("cast(array() as array<string>)"), s("policy_dominant") | s("action")
    technology = col("triad") | cg.passed(forward) | held["research"]
    gates = {
        "accident": (col("accident.passes"), col("accident.failures")), "technology": (technology, col("triad_failures")), "dispute": (col("f_dispute"), none),
        "policy": ((col("f_policy") & acted) | held["incident"] | held["adjustment"], failures([("policy", col("f_policy")), ("action", acted)])), "opening": (held["opening"], col("f_opening")),
        "purchase": (col("in_scope") & held["purchase"], F.concat(F.when(~col("in_scope"), F.array(F.lit("not_selected"))).otherwise(none), col("f_purchase"))),
    }
    subtypes = [("opening", held["opening"]), ("technical_incident", held["incident"]), ("service_adjustment", held["adjustment"]), ("dispute", col("f_dispute")), ("policy", gates["policy"][0])]
    claims = [("accident", "accident", 6), ("purchase", "purchase", 5), ("opening", "operations", 4), ("dispute", "operations", 3), ("policy", "operations", 2), ("technology", "technology", 1)]
    found = rows.select("doc_id", cg.evaluate(gates, subtypes, claims).alias("e"))
    return found.select("doc_id", *[F.col("e.gates")[n].alias(n) for n in gates], *[F.col("e.reasons")[n].alias(f"why_{n}") for n in gates], "e.subtype", "e.category", F.array_join("e.rejected", ",").alias("rejected"))


def g9_purchase_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase and research with their failures."""
    rows, gates = _gates(facts(spark, sf_dir))
    return rows.select("doc_id", *[F.array_join(gates[g], ",").alias(g) for g in ("purchase", "research")])


def _issue(rows: DataFrame) -> Column:
    s = cg.of(rows)
    return cg.information_issue(s, F.col("title"), F.col("snippet"), F.col("tier") == "A", s("valuable"))


def g11_forward_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New technology: its tracks and whether it passes, whether it is worth fetching, what its information lacks."""
    rows, _ = _gates(facts(spark, sf_dir))
    s, col = cg.of(rows), F.col
    rows = rows.withColumn("issue", _issue(rows))
    checks, track_a, track_b = cg.forward(s, col("subject"), col("triad"), col("family"), col("dated"), col("sourced"), col("tier"), col("grade"), col("issue"))
    fetched = cg.forward_enrichment(s, col("subject"), col("family"), col("dated"), col("sourced"), col("tier"))
    return rows.select("doc_id", "issue", track_a.alias("track_a"), track_b.alias("track_b"), F.array_join(failures(checks), ",").alias("failures"), fetched.alias("fetched"))


def _own(gates: dict[str, Column]) -> dict[str, Column]:
    none = lambda f: F.size(f) == 0
    return {"dispute": gates["dispute"], "policy": gates["policy"] | none(gates["opening"]) | none(gates["incident"]), "purchase": none(gates["purchase"])}


def g20_selection_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons before deduplication, against selection, against filling in."""
    rows, gates = _gates(facts(spark, sf_dir))
    s, col, own = cg.of(rows), F.col, _own(gates)
    own = {"technology": col("triad"), **own}
    rows = rows.withColumn("hard", cg.hard_excluded(s, col("category"), col("tier"), own))
    low = cg.hard_low_value(s, [col("host"), F.lit(None).cast("string")], ["low.example"], s("valuable"), col("path"), ["/status", "/list"])
    selection = cg.selection_low_value(s, col("category"), col("tier"), col("score"), col("flags"), s("valuable"), s("strong_detail"), own)
    fill = cg.borderline(col("category"), col("tier"), col("score"), col("hard"), col("dated"), col("sourced"), ["technology", "accident", "policy", "dispute"], col("in_scope"), own, "accident")
    return rows.select("doc_id", low.alias("low_value"), "hard", selection.alias("selection"), fill.alias("fill_in"))


def g22_rescue_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows worth fetching: yearly, of high priority, short, purchases without a system, and all of them by lane."""
    rows, gates = _gates(facts(spark, sf_dir))
    s, col = cg.of(rows), F.col
    any_gate = F.greatest(col("triad"), *_own(gates).values())
    rows = rows.withColumn("issue", _issue(rows)).withColumn("lacking", cg.unsupported(col("category"), any_gate))
    rows = rows.withColumn("exclusion", cg.annual_exclusion(s, col("page_type"), col("in_scope"), col("path"), ["/status", "/list"]))
    rows = rows.withColumn("annual", cg.annual_rescue(col("subject"), col("tier"), col("status"), col("bucket"), col("sourced"), col("exclusion"), col("lacking"), col("issue")))
    rows = rows.withColumn("priority", cg.priority_rescue(s, col("subject"), col("tier"), col("dated"), col("sourced"), col("lacking"), col("issue")))
    rows = rows.withColumn("bought", cg.procurement_rescue(s, col("subject"), col("tier"), col("host"), ["gov.example"], col("dated"), col("sourced"), col("systems")))
    forward = cg.forward_enrichment(s, col("subject"), col("family"), col("dated"), col("sourced"), col("tier"))
    lanes = [cg.prefetch(col("title"), col("tier"), col("dated"), col("sourced"), col("family"), days, forward, col("annual"), [col("priority"), col("bought")], col("subject"), s("action")).alias(n) for n, days in (("weekly", 7), ("yearly", 365))]
    return rows.select("doc_id", "exclusion", "annual", "priority", cg.short_snippet(col("priority"), col("snippet")).alias("short"), "bought", *lanes)


#: Terms of the driver's prose in the places of rule packs.
PROSE = {"mode": ["thing"], "operator": ["onre"], "rail_detail": ["erth"], "road_event": ["that"], "system": ["und"], "action": ["for", "la"], "financial": ["license"], "security": ["idiot"], "ambiguous_mode": ["the"], "mode_context": ["of the"]}


def g2_text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject and failures of the triad, signals taken from their texts."""
    d = cg.signals(table(spark, sf_dir, "documents").select("lang", "text"), "text", PROSE)
    s = cg.of(d)
    d = d.select("lang", "signals").withColumn("subject", cg.relevant(s))
    failed = F.array_join(failures(cg.technical(s, F.col("subject"))), ",")
    return d.select("lang", "subject", failed.alias("failures")).groupBy("lang", "subject", "failures").agg(F.count("*").alias("n_docs"))


def g23_home_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by home system and by why they aren't of the home market."""
    scope = cg.home_scope(F.col("text"), ["the", "les"], {"first": ["onre"], "second": ["que"]}, ["of", "de"], ["license"], ["idiot"], ["thing"])
    d = table(spark, sf_dir, "documents").select(scope.alias("s"))
    return d.groupBy("s.admitted", "s.system", "s.reason").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (g1_subject_gates, g2_text_gates, g3_major_accident, g13_evaluator, g5_operation_gates, g9_purchase_gates, g11_forward_gates, g20_selection_gates, g22_rescue_gates, g23_home_scope)}


_ONE = lambda at, values: f"[{', '.join(repr(v) for v in values)}][{at} % {len(values)} + 1]"
_WORDISH = "[A-Za-z0-9]+|[\\x{4E00}-\\x{9FFF}]"
_TEXT = "coalesce(text, '')"
_FACTS = f"""
f00 AS (SELECT *, length({_TEXT}) AS z, replace(lower({_TEXT}), 'ß', 'ss') AS folded, replace(lower(string_split({_TEXT}, '.')[1]), 'ß', 'ss') AS headline FROM documents),
f0 AS (SELECT doc_id, folded AS raw, {", ".join(f"regexp_matches({'headline' if n in HEADLINE else 'folded'}, '(?:^|[^a-z0-9])(?:{'|'.join(terms)})(?:[^a-z0-9]|$)') AS {n}" for n, terms in packs().items())},
  z >= 150 AS dated, source NOT IN ('src3', 'src5', 'src7') AS sourced, z % 5 = 0 AS family, lang <> 'de' AS in_scope,
  {_ONE("z", "ABCD")} AS tier, {_ONE("(z // 4)", "ABCX")} AS grade, CASE WHEN lang IN ('en', 'fr') THEN 'news_article' WHEN lang = 'es' THEN 'portal' ELSE '' END AS page_type, {_ONE("(z // 16)", ["technology", "accident", "policy", "dispute", "purchase", "excluded", ""])} AS category,
  z % 100 AS score, regexp_matches({_TEXT}, '{cg.UNITS}') AS quantified, len(regexp_extract_all(string_split({_TEXT}, '.')[1], '{_WORDISH}')) AS n_title, len(regexp_extract_all(coalesce(string_split({_TEXT}, '.')[2], ''), '{_WORDISH}')) AS n_snippet, length(trim(coalesce(string_split({_TEXT}, '.')[2], ''), ' ')) AS snippet_size,
  contains({_TEXT}, '#') AS f_general, contains({_TEXT}, '@') AS f_notice, contains({_TEXT}, '%') AS f_proxy, contains({_TEXT}, '*') AS f_thin, contains({_TEXT}, 'ung') AS ventilation, contains({_TEXT}, 'tion') AS signalling, contains({_TEXT}, 'en') AS acted,
  CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS path, regexp_extract(source, '([0-9]+)', 1)::INTEGER % 4 AS host, z % 3 < 2 AND z % 2 = 0 AS verified FROM f00),
f1 AS (SELECT *, ventilation OR signalling AS has_system, dated AND sourced AS doc, mode OR operator OR (ambiguous_mode AND mode_context) AS clear FROM f0),
f2 AS (SELECT *, standards_source OR (clear AND NOT (road_event AND NOT rail_detail) AND (NOT civic_name OR mode OR operator) AND NOT people_mover_only) AS subject FROM f1),
f3 AS (SELECT *, concat_ws(',', CASE WHEN financial THEN 'financial' END, CASE WHEN security THEN 'security' END, CASE WHEN people_mover_only THEN 'people_mover_only' END, CASE WHEN accessibility_only THEN 'accessibility_only' END, CASE WHEN non_core_only THEN 'non_core_only' END, CASE WHEN project_only THEN 'project_only' END,
    CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT system THEN 'system' END, CASE WHEN NOT action THEN 'action' END, CASE WHEN non_technical AND NOT core_term AND NOT strong_detail AND NOT implementation THEN 'context' END) AS triad_failures,
  subject AND NOT low_value AND ((dispute AND actor AND impact) OR (doc AND tier IN ('A', 'B') AND dispute_weak AND impact_weak AND dispute_headline)) AS disputed,
  event AND (large_impact OR NOT planned) AS ev, substantive OR quantified AS big,
  CASE WHEN notice AND NOT valuable THEN CASE WHEN route_term THEN 'route_page' ELSE 'daily_notice' END WHEN valuable AND NOT (n_title < 4 AND n_snippet < 10 AND tier <> 'A') THEN NULL WHEN n_snippet < 8 OR (n_title < 4 AND n_snippet < 10) THEN 'thin' END AS issue FROM f2),
f AS (SELECT *, triad_failures = '' AS triad,
  concat_ws(',', CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT (fault OR ev OR disruption) THEN 'fault,disruption' END, CASE WHEN disruption AND NOT disruption_impact AND NOT ev THEN 'disruption_impact' END,
    CASE WHEN NOT (core_term OR fault_named OR (disruption AND control) OR (ev AND place)) THEN 'system' END, CASE WHEN NOT (technical_impact OR ev OR (disruption AND disruption_impact)) THEN 'impact' || CASE WHEN minor THEN ',not_minor' ELSE '' END END,
    CASE WHEN NOT doc THEN 'documented' END, CASE WHEN planned AND NOT large_impact AND NOT ev THEN 'not_planned' END, CASE WHEN low_value THEN 'not_low_value' END) AS incident,
  concat_ws(',', CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT doc THEN 'documented' END, CASE WHEN NOT adjustment THEN 'adjustment' END, CASE WHEN NOT big THEN 'substantial' END, CASE WHEN routine AND NOT big THEN 'not_routine' END) AS adjusted,
  concat_ws(',', CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT doc THEN 'documented' END, CASE WHEN general_rail THEN 'not_general' END, CASE WHEN future THEN 'not_future' END, CASE WHEN planning AND NOT opened THEN 'not_planning' END, CASE WHEN testing AND NOT opened THEN 'not_testing' END, CASE WHEN low_value THEN 'not_low_value' END, CASE WHEN NOT opened THEN 'opened' END) AS opening,
  concat_ws(',', CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT in_scope THEN 'scope' END, CASE WHEN has_system AND NOT signalling AND NOT cross_system AND NOT generic_scope THEN 'core_system' END, CASE WHEN NOT has_system AND NOT generic_scope THEN 'system' END, CASE WHEN NOT acted THEN 'action' END,
    CASE WHEN civil AND NOT separate_package AND NOT (ventilation AND NOT structures) THEN CASE WHEN has_system THEN 'separable' ELSE 'not_civil_only' END END, CASE WHEN study AND NOT (detailed_design AND has_system AND acted) THEN 'not_planning_only' END,
    CASE WHEN NOT dated THEN 'dated' END, CASE WHEN NOT sourced THEN 'sourced' END, CASE WHEN tier = 'D' THEN 'graded' END, CASE WHEN page_type = 'portal' THEN 'article' END) AS bought_failures FROM f3),
p AS (SELECT *, CASE WHEN NOT subject OR NOT doc OR short_notice OR (minor AND fault) OR dispute_dominant THEN false WHEN adjusted = '' THEN true WHEN (triad AND NOT policy_dominant) OR low_value OR fare_table OR (road_riders AND NOT rail_riders) THEN false ELSE "policy" OR policy_detail END AS is_policy FROM f),
g AS (SELECT *, CASE category WHEN 'technology' THEN triad WHEN 'dispute' THEN disputed WHEN 'policy' THEN is_policy OR opening = '' OR incident = '' WHEN 'purchase' THEN bought_failures = '' ELSE true END AS holds,
  triad OR disputed OR is_policy OR opening = '' OR incident = '' OR bought_failures = '' AS any_gate,
  doc AND tier <> 'D' AND issue IS NULL AS based, family AND tier <> 'D' AND doc AND subject AND NOT rescue_low_value AND NOT generic_marketing AND (emerging OR innovation) AS fetched FROM p),
h AS (SELECT *, triad AND application_object AND novelty AND validation AND benefit AS track_a, subject AND emerging AND application_evidence AND forward_object AND NOT project_only AND based AND grade <> 'X' AND NOT generic_marketing AND NOT generic_material AS track_b,
  CASE WHEN financial THEN 'financial' WHEN tier = 'D' THEN 'tier' WHEN category = 'excluded' THEN 'excluded' WHEN radar_only THEN 'radar_only' WHEN NOT holds THEN 'gate' WHEN security AND NOT security_impact THEN 'security' WHEN long_term_low_value THEN 'long_term' WHEN general_rail OR general_rail_term THEN 'general_rail' WHEN list_notice THEN 'list_notice'
    WHEN people_mover_only THEN 'people_mover' WHEN report_low_value THEN 'low_value' WHEN other_transport_strict AND NOT mode AND NOT operator THEN 'other_transport' WHEN service_page THEN 'page' END AS hard,
  CASE WHEN NOT in_scope THEN 'scope' WHEN page_type <> 'news_article' THEN 'page_type' WHEN financial THEN 'financial' WHEN general_rail THEN 'general_rail' WHEN list_notice THEN 'list_notice' WHEN people_mover_only THEN 'people_mover' WHEN security AND NOT security_impact THEN 'security' WHEN generic_marketing THEN 'marketing'
    WHEN rescue_low_value THEN 'rescue_low_value' WHEN project_only THEN 'project_only' WHEN other_transport_strict AND NOT mode AND NOT operator THEN 'other_transport' WHEN low_value OR page_term THEN 'low_information' WHEN path > 0 THEN 'path' WHEN service_page THEN 'status_page' END AS exclusion,
  category IN ('', 'excluded') OR NOT any_gate OR issue IS NOT NULL AS wanting FROM g),
r AS (SELECT *, tier <> 'D' AND verified AND sourced AND subject AND exclusion IS NULL AND wanting AS annual, tier <> 'D' AND doc AND subject AND NOT rescue_low_value AND NOT generic_marketing AND (lift_technology OR NOT lift) AND high_value AND wanting AS priority,
  (tier IN ('A', 'B') OR host = 3) AND doc AND subject AND purchase AND NOT has_system AS bought FROM h)"""


def _re2(terms: list[str]) -> str:
    return "|".join(f"(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)" for t in terms)


_FOLD = "replace(lower(coalesce(text, '')), 'ß', 'ss')"

_IN = lambda x, terms: f"regexp_matches({x}, '(?:^|[^a-z0-9])(?:{'|'.join(terms)})(?:[^a-z0-9]|$)')"
_HAS = lambda x, name: _IN(x, ACCIDENT[name])
#: A clause has a term with no negator before it.
_POSITIVE = lambda x, name: f"""len(list_filter(string_split_regex({x}, '[.!?;:。！？；：\\n]'), lambda c: {_HAS("c", name)} AND NOT {_IN(f"regexp_extract(c, '^(.*?)(?:^|[^a-z0-9])(?:{'|'.join(ACCIDENT[name])})(?:[^a-z0-9]|$)', 1, 's')", NEGATORS)})) > 0"""
_SEVERE = f"""NOT ({_HAS("f", "research")} AND NOT {_POSITIVE("f", "occurred")}) AND (({_POSITIVE("f", "severity")} AND NOT {_POSITIVE("f", "equipment")}) OR {_POSITIVE("f", "direct")} OR ({_HAS("f", "equipment")} AND {_HAS("f", "consequence")}))"""
_COUNTS = f"""{_HAS("f", "context")} AND {_HAS("f", "accident")} AND ({_SEVERE}) AND NOT ({_HAS("f", "single")} AND NOT {_HAS("raw", "exception")}) AND NOT ({_HAS("f", "road")} AND {_HAS("f", "low_impact")} AND {_HAS("f", "minor")})"""
_ACCIDENTS = f"""{_FACTS}, parts AS (SELECT *, list_filter(list_transform(string_split_regex(raw, '[.!?。！？\\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS frags FROM r),
marked AS (SELECT *, {_HAS("raw", "accident")} AS a1, len(list_filter(frags, lambda f: {_SEVERE})) > 0 AS a2, NOT {_HAS("raw", "other_context")} AS a3, NOT {_HAS("raw", "research")} OR {_POSITIVE("raw", "occurred")} AS a4, NOT (security AND NOT security_impact) AS a5, len(list_filter(frags, lambda f: {_COUNTS})) > 0 AS a6 FROM parts),
acc AS (SELECT *, concat_ws(',', CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT a1 THEN 'accident' END, CASE WHEN NOT a2 THEN 'severity' END, CASE WHEN NOT a3 THEN 'not_other_context' END, CASE WHEN NOT a4 THEN 'not_research' END, CASE WHEN NOT a5 THEN 'not_barred' END, CASE WHEN NOT a6 THEN 'one_sentence' END) AS acc_failures,
  concat_ws(',', CASE WHEN subject THEN 'subject' END, CASE WHEN a1 THEN 'accident' END, CASE WHEN a2 THEN 'severity' END) AS acc_signals FROM marked)"""
_WHY = lambda gate, lacks: f"CASE WHEN {gate} THEN 'passed' ELSE {lacks} END AS why_{gate.removeprefix('x_')}"

ORACLE_SQL = {
    "g3_major_accident": f"WITH {_ACCIDENTS} SELECT doc_id, acc_failures = '' AS passes, acc_signals AS signals, acc_failures AS failures FROM acc",
    "g13_evaluator": f"""
WITH {_ACCIDENTS}, e AS (SELECT *, acc_failures = '' AS x_accident,
  triad OR (family AND based AND grade IN ('A', 'B', 'C') AND NOT project_only AND (track_a OR track_b)) OR (subject AND doc AND research AND technical_object AND result AND bought_failures <> '') AS x_technology, disputed AS x_dispute,
  (is_policy AND (policy_dominant OR action)) OR incident = '' OR adjusted = '' AS x_policy, opening = '' AS x_opening, in_scope AND bought_failures = '' AS x_purchase FROM acc),
c AS (SELECT *, list_filter([CASE WHEN x_technology THEN 'technology' END, CASE WHEN x_policy THEN 'operations' END, CASE WHEN x_dispute THEN 'operations' END, CASE WHEN x_opening THEN 'operations' END, CASE WHEN x_purchase THEN 'purchase' END, CASE WHEN x_accident THEN 'accident' END], lambda x: x IS NOT NULL) AS claims FROM e)
SELECT doc_id, {", ".join(f"x_{n} AS {n}" for n in ("accident", "technology", "dispute", "policy", "opening", "purchase"))},
  {_WHY("x_accident", "acc_failures")}, {_WHY("x_technology", "triad_failures")}, {_WHY("x_dispute", "''")}, {_WHY("x_policy", "concat_ws(',', CASE WHEN NOT is_policy THEN 'policy' END, CASE WHEN NOT (policy_dominant OR action) THEN 'action' END)")}, {_WHY("x_opening", "opening")},
  {_WHY("x_purchase", "concat_ws(',', CASE WHEN NOT in_scope THEN 'not_selected' END, nullif(bought_failures, ''))")},
  CASE WHEN opening = '' THEN 'opening' WHEN incident = '' THEN 'technical_incident' WHEN adjusted = '' THEN 'service_adjustment' WHEN disputed THEN 'dispute' WHEN x_policy THEN 'policy' END AS subtype,
  coalesce(claims[-1], 'excluded') AS category, array_to_string(list_filter(claims, lambda x: x <> claims[-1]), ',') AS rejected FROM c""",
    "g1_subject_gates": f"WITH {_FACTS} SELECT doc_id, subject, triad_failures, disputed AS dispute FROM r",
    "g5_operation_gates": f"WITH {_FACTS} SELECT doc_id, incident, adjusted AS adjustment, opening, is_policy AS policy FROM r",
    "g9_purchase_gates": f"""WITH {_FACTS} SELECT doc_id, bought_failures AS purchase, concat_ws(',', CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT doc THEN 'documented' END, CASE WHEN NOT research THEN 'activity' END, CASE WHEN NOT technical_object THEN 'object' END, CASE WHEN NOT result THEN 'status' END, CASE WHEN bought_failures = '' THEN 'no_purchase' END) AS research FROM r""",
    "g11_forward_gates": f"""WITH {_FACTS} SELECT doc_id, issue, track_a, track_b, concat_ws(',', CASE WHEN NOT family THEN 'family' END, CASE WHEN NOT (based AND (grade IN ('A', 'B') OR (family AND grade = 'C'))) THEN 'base' END, CASE WHEN project_only THEN 'not_project_only' END, CASE WHEN NOT track_a AND NOT track_b THEN concat_ws(',',
  CASE WHEN NOT subject THEN 'a:subject' END, CASE WHEN NOT application_object THEN 'a:application' END, CASE WHEN NOT novelty THEN 'a:novelty' END, CASE WHEN NOT validation THEN 'a:validation' END, CASE WHEN NOT benefit THEN 'a:benefit' END,
  CASE WHEN NOT subject THEN 'b:subject' END, CASE WHEN NOT emerging THEN 'b:emerging' END, CASE WHEN NOT application_evidence THEN 'b:evidence' END, CASE WHEN NOT forward_object THEN 'b:technical_object' END, CASE WHEN project_only THEN 'b:not_project_only' END, CASE WHEN NOT (based AND grade <> 'X') THEN 'b:base' END,
  CASE WHEN generic_marketing THEN 'b:not_marketing' END, CASE WHEN generic_material THEN 'b:not_material' END, 'track') END) AS failures, fetched FROM r""",
    "g20_selection_gates": f"""WITH {_FACTS} SELECT doc_id, CASE WHEN host < 2 THEN 'low_value_host' WHEN financial THEN 'financial' WHEN valuable THEN NULL WHEN page_term THEN 'page_term' WHEN path > 0 THEN 'path' END AS low_value, hard,
  CASE WHEN category = 'excluded' THEN 'excluded' WHEN radar_only THEN 'radar_only' WHEN financial THEN 'financial' WHEN tier = 'D' THEN 'tier' WHEN NOT holds THEN 'gate' WHEN security AND NOT security_impact THEN 'security' WHEN long_term_low_value THEN 'long_term' WHEN f_general OR general_rail THEN 'general_rail' WHEN list_notice THEN 'list_notice'
    WHEN official_notice AND NOT notice_detail THEN 'official_notice' WHEN f_notice AND NOT valuable THEN 'service_notice' WHEN f_proxy AND NOT strong_detail THEN 'proxy' WHEN f_thin AND NOT valuable THEN 'thin' WHEN score < 45 THEN 'score' END AS selection,
  CASE WHEN category NOT IN ('technology', 'accident', 'policy', 'dispute') THEN 'kind' WHEN NOT in_scope THEN 'scope' WHEN hard IS NOT NULL THEN 'excluded' WHEN NOT dated THEN 'date' WHEN NOT sourced THEN 'source' WHEN score < CASE WHEN category = 'accident' THEN 62 ELSE 58 END THEN 'score' WHEN tier = 'C' AND score < 70 THEN 'media_score' WHEN NOT holds THEN 'gate' END AS fill_in FROM r""",
    "g22_rescue_gates": f"""WITH {_FACTS}, e AS (SELECT *, tier <> 'D' AND n_title >= 3 AND doc AS able FROM r)
SELECT doc_id, exclusion, annual, priority, priority AND (n_snippet < 24 OR snippet_size < 180) AS short, bought, able AND CASE WHEN family THEN fetched ELSE priority OR bought OR (subject AND action) END AS weekly, able AND CASE WHEN family THEN fetched ELSE annual END AS yearly FROM e""",
    "g2_text_gates": f"""
WITH s AS (SELECT lang, {", ".join(f"regexp_matches({_FOLD}, '{_re2(t)}') AS {n}" for n, t in PROSE.items())} FROM documents),
t AS (SELECT *, (mode OR operator OR (ambiguous_mode AND mode_context)) AND NOT (road_event AND NOT rail_detail) AS subject FROM s)
SELECT lang, subject, concat_ws(',', CASE WHEN financial THEN 'financial' END, CASE WHEN security THEN 'security' END, CASE WHEN NOT subject THEN 'subject' END, CASE WHEN NOT system THEN 'system' END, CASE WHEN NOT action THEN 'action' END) AS failures, count(*) AS n_docs FROM t GROUP BY ALL""",
    "g23_home_scope": f"""
WITH s AS (SELECT regexp_matches({_FOLD}, '{_re2(["the", "les"])}') AS home, CASE WHEN regexp_matches({_FOLD}, '{_re2(["of", "de"])}') THEN CASE WHEN regexp_matches({_FOLD}, '{_re2(["onre"])}') THEN 'first' WHEN regexp_matches({_FOLD}, '{_re2(["que"])}') THEN 'second' END END AS system,
  regexp_matches({_FOLD}, '{_re2(["license"])}') AS other, regexp_matches({_FOLD}, '{_re2(["idiot"])}') AS mover, regexp_matches({_FOLD}, '{_re2(["thing"])}') AS run FROM documents),
t AS (SELECT *, CASE WHEN NOT home THEN 'elsewhere' WHEN system IS NULL THEN CASE WHEN other THEN 'other_transport' ELSE 'no_system' END WHEN mover AND NOT run THEN 'people_mover' END AS reason FROM s)
SELECT reason IS NULL AS admitted, CASE WHEN home THEN system END AS system, reason, count(*) AS n_docs FROM t GROUP BY ALL""",
}
