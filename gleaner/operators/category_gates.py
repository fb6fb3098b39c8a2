"""Gates of categories: what a row must show to count as news of a kind.

A gate looks at named signals, never at terms: ``signals`` computes them once
from rule packs, so that a text is folded once and every pack is one
expression.  A gate is a list of named checks; a row fails it with the names
of those that don't hold (``gates.failures``), and passes with none.  Signals
that are unknown or null don't hold.

Row facts that gates ask for beside packs: ``dated``, ``sourced``, the source's
``tier`` (A to D) and ``grade``, ``page_type``, ``category``, ``score``, ``flags``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import contains_positive, fold, fragments, has_term, known_words, once, term_regex, wordish_count
from gleaner.functions.urls import host_suffixes
from gleaner.operators.gates import failures, first_reason, matrix, truth
from gleaner.operators.resolve import claim, strongest_claim

# fixed values: units in which a change of service is told
UNITS = r"(?i)\d+\s*(?:%|percent|minutes?|mins?|trains?|services?|車次|班次|分間隔)"

Signals = Callable[[str], Column]
Checks = list[tuple[str, Column]]


def signals(df: DataFrame, text: Column | str, packs: dict[str, Iterable[str]], out: str = "signals") -> DataFrame:
    """``df`` with the struct ``out``: for each pack of terms whether the text has one of them."""
    return view_signals(df, {"text": F.col(text) if isinstance(text, str) else text}, {"text": packs}, out)


def of(df: DataFrame, out: str = "signals") -> Signals:
    """The signals of ``df`` by name; those that it hasn't don't hold."""
    known = set(df.schema[out].dataType.names)
    return lambda name: truth(F.col(f"{out}.{name}")) if name in known else F.lit(False)


def _any(s: Signals, *names: str) -> Column:
    return F.greatest(F.lit(False), *[s(n) for n in names])


def passed(checks: Checks) -> Column:
    return F.size(failures(checks)) == 0


def documented(dated: Column, sourced: Column) -> Column:
    return truth(dated) & truth(sourced)


def relevant(s: Signals) -> Column:
    """About the subject: a mode, an operator, or an ambiguous name in context; other transport alone isn't."""
    named = _any(s, "mode", "operator")
    clear = named | (s("ambiguous_mode") & s("mode_context"))
    against = [
        (s("road_event") & ~s("rail_detail")),
        (s("civic_name") & ~named),
        s("people_mover_only"),
        (_any(s, "other_transport", "other_transport_strict") & ~clear),
    ]
    return s("standards_source") | (clear & ~F.greatest(*against))


def technical(s: Signals, subject: Column) -> Checks:
    """The triad of subject, system and action, with what rules a row out of it."""
    kept_out = ["financial", "security", "people_mover_only", "accessibility_only", "non_core_only", "project_only"]
    return [
        *((name, ~s(name)) for name in kept_out),
        ("subject", subject), ("system", s("system")), ("action", s("action")),
        ("context", ~s("non_technical") | _any(s, "core_term", "strong_detail", "implementation")),
    ]


def dispute(s: Signals, subject: Column, documented: Column, tier: Column) -> Column:
    """A conflict by signal, actor and impact, or by weaker ones where the source is good and the headline says it."""
    primary = s("dispute") & s("actor") & s("impact")
    secondary = documented & truth(tier.isin("A", "B")) & s("dispute_weak") & s("impact_weak") & s("dispute_headline")
    return subject & ~s("low_value") & (primary | secondary)


def operation_incident(s: Signals, subject: Column, documented: Column) -> Checks:
    """A fault, an event or a disruption of a system with an impact; each of the three stands in for what it implies."""
    event = s("event") & (~s("planned") | s("large_impact"))
    fault, disruption = s("fault"), s("disruption")
    felt = disruption & s("disruption_impact")
    impact = s("technical_impact") | event | felt
    system = _any(s, "core_term", "fault_named") | (disruption & s("control")) | (event & s("place"))
    return [
        ("subject", subject),
        ("fault", fault | event | disruption),
        ("disruption", disruption | fault | event),
        ("disruption_impact", ~disruption | felt | event),
        ("system", system), ("impact", impact),
        ("not_minor", ~s("minor") | impact),
        ("documented", documented),
        ("not_planned", ~s("planned") | event | s("large_impact")),
        ("not_low_value", ~s("low_value")),
    ]


def service_adjustment(s: Signals, subject: Column, documented: Column, text: Column) -> Checks:
    """A change of service that is substantive or told in numbers."""
    substantial = s("substantive") | truth(text.rlike(UNITS))
    return [("subject", subject), ("documented", documented), ("adjustment", s("adjustment")), ("substantial", substantial), ("not_routine", ~s("routine") | substantial)]


def policy(s: Signals, subject: Column, documented: Column, accident: Column, adjustment: Column, technical: Column) -> Column:
    """A policy of weight: an adjustment is one; otherwise rules in order are against it before its terms speak for it."""
    rules = [
        ("subject", ~(subject & documented)), ("notice", s("short_notice")), ("other_kind", accident | s("dispute_dominant")),
        ("adjustment", adjustment), ("technical", technical & ~s("policy_dominant")), ("low_value", s("low_value")), ("fares", s("fare_table")), ("road", s("road_riders") & ~s("rail_riders")),
        ("policy", _any(s, "policy", "policy_detail")),
    ]
    return truth(first_reason(rules).isin("adjustment", "policy"))


def opening(s: Signals, subject: Column, documented: Column) -> Checks:
    """Passenger service has begun; what is to come, planned or tested isn't enough."""
    actual = s("opened")
    return [
        ("subject", subject), ("documented", documented), ("not_general", ~s("general_rail")), ("not_future", ~s("future")),
        ("not_planning", ~s("planning") | actual), ("not_testing", ~s("testing") | actual), ("not_low_value", ~s("low_value")), ("opened", actual),
    ]


def procurement(s: Signals, subject: Column, scope: Column, systems: Column, core: Column, actions: Column, dated: Column, sourced: Column, tier: Column, grade: Column, page_type: Column) -> Checks:
    """A purchase of systems: ``systems`` and ``actions`` are the names found, ``core`` whether one of the systems is a core one."""
    some, acted = F.size(systems) > 0, F.size(actions) > 0
    ventilated = F.array_contains(systems, "ventilation") & ~s("structures")
    civil = s("civil") & ~s("separate_package") & ~ventilated
    graded = (truth(tier.isin("A", "B", "C")) | truth(grade.isin("A", "B", "C"))) & ~truth(tier == "D")
    return [
        ("subject", subject), ("scope", scope),
        ("core_system", ~some | truth(core) | s("cross_system") | s("generic_scope")),
        ("system", some | s("generic_scope")), ("action", acted),
        ("not_civil_only", ~civil | some), ("separable", ~civil | ~some),
        ("not_planning_only", ~s("study") | (s("detailed_design") & some & acted)),
        ("dated", truth(dated)), ("sourced", truth(sourced)), ("graded", graded),
        ("article", truth(F.coalesce(page_type, F.lit("")).isin("", "news_article"))),
    ]


def research(s: Signals, subject: Column, documented: Column, procured: Column) -> Checks:
    return [("subject", subject), ("documented", documented), ("activity", s("research")), ("object", s("technical_object")), ("status", s("result")), ("no_purchase", ~procured)]


def forward(s: Signals, subject: Column, triad: Column, family: Column, dated: Column, sourced: Column, tier: Column, grade: Column, information: Column) -> tuple[Checks, Column, Column]:
    """The checks of new technology and its tracks: A, the triad with object, novelty, validation and benefit; B, an emerging technology applied across systems. What lacks for a track counts only if neither is met."""
    based = documented(dated, sourced) & ~truth(tier == "D") & information.isNull()
    base_b = based & truth(grade.isin("A", "B", "C"))
    of_b = [
        ("subject", subject), ("emerging", s("emerging")), ("evidence", s("application_evidence")), ("technical_object", s("forward_object")), ("not_project_only", ~s("project_only")),
        ("base", base_b), ("not_marketing", ~s("generic_marketing")), ("not_material", ~s("generic_material")),
    ]
    of_a = [("subject", subject), ("application", s("application_object")), ("novelty", s("novelty")), ("validation", s("validation")), ("benefit", s("benefit"))]
    track_a, track_b = triad & s("application_object") & s("novelty") & s("validation") & s("benefit"), passed(of_b)
    either = track_a | track_b
    base = based & (truth(grade.isin("A", "B")) | (family & base_b))
    checks = [("family", family), ("base", base), ("not_project_only", ~s("project_only")), *((f"a:{n}", either | ok) for n, ok in of_a), *((f"b:{n}", either | ok) for n, ok in of_b), ("track", either)]
    return checks, track_a, track_b


def hard_low_value(s: Signals, hosts: list[Column], low_hosts: Iterable[str], valuable: Column, path: Column, path_marks: Iterable[str]) -> Column:
    """The first reason that rules a row out before any other test; what is of high value is spared the last two."""
    low = F.array(*[F.lit(h) for h in low_hosts])
    on_low = [F.arrays_overlap(host_suffixes(F.coalesce(h, F.lit(""))), low) for h in hosts]
    marked = F.lower(F.coalesce(path, F.lit(""))).rlike("|".join(path_marks) or "(?!)")
    return first_reason([("low_value_host", F.greatest(F.lit(False), *on_low)), ("financial", s("financial")), ("page_term", s("page_term") & ~valuable), ("path", marked & ~valuable)])


def information_issue(s: Signals, title: Column, snippet: Column, official: Column, valuable: Column) -> Column:
    """Why a row tells too little: a route page, a daily notice, too few words; null if it doesn't."""
    n_title, n_snippet, notice = wordish_count(title), wordish_count(snippet), s("notice") & ~valuable
    thin = ((n_title < 4) & (n_snippet < 10) & ~(truth(official) & valuable)) | ((n_snippet < 8) & ~valuable)
    return first_reason([("route_page", notice & s("route_term")), ("daily_notice", notice), ("thin", thin)])


def category_holds(category: Column, gates: dict[str, Column]) -> Column:
    """Whether the gate of the row's own category holds; a category without one needs none."""
    return truth(F.coalesce(*[F.when(category == name, ok) for name, ok in gates.items()], F.lit(True)))


def hard_excluded(s: Signals, category: Column, tier: Column, gates: dict[str, Column]) -> Column:
    """The first reason against a row as a substitute: kind of content, source, category and its gate, subject."""
    return first_reason([
        ("financial", s("financial")), ("tier", tier == "D"), ("excluded", category == "excluded"), ("radar_only", s("radar_only")), ("gate", ~category_holds(category, gates)),
        ("security", s("security") & ~s("security_impact")), ("long_term", s("long_term_low_value")), ("general_rail", _any(s, "general_rail", "general_rail_term")), ("list_notice", s("list_notice")),
        ("people_mover", s("people_mover_only")), ("low_value", s("report_low_value")), ("other_transport", s("other_transport_strict") & ~_any(s, "mode", "operator")), ("page", s("service_page")),
    ])


def selection_low_value(s: Signals, category: Column, tier: Column, score: Column, flags: Column, good: Column, detailed: Column, gates: dict[str, Column], least: int = 45) -> Column:
    """The first reason against selecting a row: as ``hard_excluded``, then flags that nothing outweighs, then a low score."""
    flagged = lambda f: truth(F.array_contains(flags, f))
    return first_reason([
        ("excluded", category == "excluded"), ("radar_only", s("radar_only")), ("financial", s("financial")), ("tier", tier == "D"), ("gate", ~category_holds(category, gates)),
        ("security", s("security") & ~s("security_impact")), ("long_term", s("long_term_low_value")), ("general_rail", flagged("general_rail") | s("general_rail")), ("list_notice", s("list_notice")),
        ("official_notice", s("official_notice") & ~s("notice_detail")), ("service_notice", flagged("service_notice") & ~good), ("proxy", flagged("proxy_page") & ~detailed),
        ("thin", flagged("insufficient") & ~good), ("score", F.coalesce(score, F.lit(0)) < least),
    ])


def borderline(category: Column, tier: Column, score: Column, excluded: Column, dated: Column, sourced: Column, selected: Iterable[str], in_scope: Column, gates: dict[str, Column], accident: str, least: tuple[int, int, int] = (62, 58, 70)) -> Column:
    """Why a row can't fill in, null if it can: its kind isn't wanted, out of scope, excluded, no date or source, a score below that of accidents, others, or plain media, its gate."""
    of_accident, of_others, of_media = least
    points = F.coalesce(score, F.lit(0))
    return first_reason([
        ("kind", ~truth(category.isin(*selected))), ("scope", ~truth(in_scope)), ("excluded", excluded.isNotNull()), ("date", ~truth(dated)), ("source", ~truth(sourced)),
        ("score", points < F.when(category == accident, of_accident).otherwise(of_others)), ("media_score", (tier == "C") & (points < of_media)), ("gate", ~category_holds(category, gates)),
    ])


def forward_enrichment(s: Signals, subject: Column, family: Column, dated: Column, sourced: Column, tier: Column) -> Column:
    """Worth fetching as new technology, before its snippet is held against the strict gate."""
    return truth(family) & truth(tier.isin("A", "B", "C")) & documented(dated, sourced) & subject & ~_any(s, "rescue_low_value", "generic_marketing") & _any(s, "emerging", "innovation")


def unsupported(category: Column, any_gate: Column) -> Column:
    """No category, or one that no gate supports."""
    return truth(F.coalesce(category, F.lit("")).isin("", "excluded")) | ~truth(any_gate)


def annual_exclusion(s: Signals, page_type: Column, in_scope: Column, path: Column, path_marks: Iterable[str]) -> Column:
    """The first reason against fetching a row of a yearly run."""
    marked = F.lower(F.coalesce(path, F.lit(""))).rlike("|".join(path_marks) or "(?!)")
    return first_reason([
        ("scope", ~truth(in_scope)), ("page_type", F.coalesce(page_type, F.lit("")) != "news_article"), ("financial", s("financial")), ("general_rail", s("general_rail")), ("list_notice", s("list_notice")),
        ("people_mover", s("people_mover_only")), ("security", s("security") & ~s("security_impact")), ("marketing", s("generic_marketing")), ("rescue_low_value", s("rescue_low_value")), ("project_only", s("project_only")),
        ("other_transport", s("other_transport_strict") & ~_any(s, "mode", "operator")), ("low_information", _any(s, "low_value", "page_term")), ("path", marked), ("status_page", s("service_page")),
    ])


def annual_rescue(subject: Column, tier: Column, status: Column, bucket: Column, sourced: Column, exclusion: Column, lacking: Column, information: Column) -> Column:
    """A verified row of a yearly run whose category isn't supported yet or that tells too little."""
    verified = truth(status == "verified") & truth(F.coalesce(bucket, F.lit("")) != "")
    return truth(tier.isin("A", "B", "C")) & verified & truth(sourced) & subject & exclusion.isNull() & (lacking | information.isNotNull())


def priority_rescue(s: Signals, subject: Column, tier: Column, dated: Column, sourced: Column, lacking: Column, information: Column) -> Column:
    """A row of high value whose category isn't supported yet or that tells too little."""
    lifts = s("lift") & ~s("lift_technology")
    return ~truth(tier == "D") & documented(dated, sourced) & subject & ~_any(s, "rescue_low_value", "generic_marketing") & ~lifts & s("high_value") & (lacking | information.isNotNull())


def short_snippet(rescue: Column, snippet: Column) -> Column:
    text = F.coalesce(snippet, F.lit(""))
    return rescue & ((wordish_count(text) < 24) | (F.length(F.trim(text)) < 180))


def procurement_rescue(s: Signals, subject: Column, tier: Column, domain: Column, suffixes: Iterable[str], dated: Column, sourced: Column, systems: Column) -> Column:
    """A purchase by an official source that names no system yet."""
    official = F.greatest(truth(tier.isin("A", "B")), *[truth(F.lower(domain).endswith(x)) for x in suffixes])
    return official & documented(dated, sourced) & subject & s("purchase") & (F.size(systems) == 0)


def prefetch(title: Column, tier: Column, dated: Column, sourced: Column, family: Column, lookback_days: int, forward: Column, annual: Column, rescues: list[Column], subject: Column, action: Column) -> Column:
    """Whether a row is fetched: good enough a source and a title, then by its lane."""
    enough = truth(tier.isin("A", "B", "C")) & (wordish_count(title) >= 3) & documented(dated, sourced)
    general = annual if lookback_days >= 365 else F.greatest(F.lit(False), *rescues) | (subject & action)
    return enough & F.when(truth(family), forward).otherwise(general)


def home_scope(df_text: Column, places: Iterable[str], systems: dict[str, Iterable[str]], context: Iterable[str], others: Iterable[str], people_mover: Iterable[str], operation: Iterable[str]) -> Column:
    """``struct(admitted, system, reason)`` of the home market: a place, then one of its systems in context, not a people mover alone."""
    t = fold(df_text)
    has = lambda terms: t.rlike(term_regex(terms))
    system = F.when(has(context), F.coalesce(*[F.when(has(terms), F.lit(name)) for name, terms in systems.items()]))
    reason = first_reason([("elsewhere", ~has(places)), ("other_transport", system.isNull() & has(others)), ("no_system", system.isNull()), ("people_mover", has(people_mover) & ~has(operation))])
    return F.struct(reason.isNull().alias("admitted"), F.when(has(places), system).alias("system"), reason.alias("reason"))


def view_signals(df: DataFrame, views: dict[str, Column], packs: dict[str, dict[str, Iterable[str]]], out: str = "signals") -> DataFrame:
    """``df`` with the struct ``out`` of the packs of all views, each asked of its own text: a headline, a headline with its snippet, all that is known.

    A view is folded once, and all views in one pass over the rows.  A pack
    belongs to one view, so the gates find their signals by name as ever.
    """
    names = [n for of_view in packs.values() for n in of_view]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"packs of more than one view: {sorted(twice)}")
    folded = df.withColumns({f"_view_{v}": fold(text) for v, text in views.items()})
    read = folded.withColumns({f"_words_{v}": known_words(F.col(f"_view_{v}"), [t for terms in of_view.values() for t in terms]) for v, of_view in packs.items()})
    held = lambda w: F.struct(*[has_term(F.col(f"_view_{v}"), w[v], terms).alias(n) for v, of_view in packs.items() for n, terms in of_view.items()])
    # a plain struct would be dissolved, and each signal looked for at every place that asks for it
    return read.withColumn(out, once(F.struct(*[F.col(f"_words_{v}").alias(v) for v in packs]), held)).drop(*[f"_{kind}_{v}" for v in views for kind in ("view", "words")])


def major_accident(text: Column, packs: dict[str, Iterable[str]], negators: Iterable[str], subject: Column, barred: Column) -> Column:
    """``struct(passes, signals, failures)`` of an accident of consequence.

    One sentence must have the subject's ``context``, an ``accident`` and
    something ``severe``: a severity that isn't denied and not of mere
    ``equipment``, what is severe by itself (``direct``), or equipment with a
    ``consequence``.  A sentence of ``research`` in which nothing ``occurred``
    isn't severe; one of a ``single`` person doesn't count without an
    ``exception``, nor one at a ``road`` of ``low_impact`` that is ``minor``.
    The whole text must have no ``other_context``, and not speak of research
    alone; ``barred`` is what else speaks against it (a response to an earlier
    accident, a crime).
    """
    terms = [t for pack in packs.values() for t in pack]
    read = lambda t: F.struct(t.alias("text"), known_words(t, terms).alias("words"))
    has = lambda t, name: has_term(t["text"], t["words"], packs.get(name, ()))
    # a clause's term is the text's, so that most texts aren't cut into clauses
    held = lambda t, name: has(t, name) & contains_positive(t["text"], packs.get(name, ()), negators)

    def severe(f: Column) -> Column:
        studied = has(f, "research") & ~held(f, "occurred")
        return ~studied & ((held(f, "severity") & ~held(f, "equipment")) | held(f, "direct") | (has(f, "equipment") & has(f, "consequence")))

    def counts(f: Column, whole: Column) -> Column:
        alone = has(f, "single") & ~has(whole, "exception")
        slight = has(f, "road") & has(f, "low_impact") & has(f, "minor")
        return has(f, "context") & has(f, "accident") & ~alone & ~slight

    def checked(whole: Column) -> Column:
        # no sentence without one of these is severe, so only few are cut into words
        told = term_regex([t for n in ("severity", "direct", "equipment") for t in packs.get(n, ())])
        parts = F.transform(F.filter(F.transform(fragments(text), fold), lambda f: f.rlike(told)), read)
        found = once(F.filter(parts, severe), lambda s: F.struct((F.size(s) > 0).alias("some"), F.exists(s, lambda f: counts(f, whole)).alias("one")))
        return F.struct(
            truth(subject).alias("subject"), has(whole, "accident").alias("accident"), found.alias("found"), (~has(whole, "other_context")).alias("not_other_context"),
            (~has(whole, "research") | held(whole, "occurred")).alias("not_research"), (~truth(barred)).alias("not_barred"),
        )

    def judged(c: Column) -> Column:
        checks = [("subject", c["subject"]), ("accident", c["accident"]), ("severity", c["found"]["some"]), *((n, c[n]) for n in ("not_other_context", "not_research", "not_barred")), ("one_sentence", c["found"]["one"])]
        shown = F.array_compact(F.array(*[F.when(ok, F.lit(n)) for n, ok in checks[:3]]))
        return once(failures(checks), lambda missing: F.struct((F.size(missing) == 0).alias("passes"), shown.alias("signals"), missing.alias("failures")))

    return once(once(read(fold(text)), checked), judged)


def evaluate(gates: dict[str, tuple[Column, Column]], subtypes: list[tuple[str, Column]], claims: list[tuple[str, str, int]], otherwise: str = "excluded") -> Column:
    """``struct(gates, reasons, subtype, category, rejected)`` of a row.

    ``gates`` has for each gate whether it holds and what it lacks;
    ``reasons`` are ``passed`` or that, joined.  ``subtype`` is the first of
    ``subtypes`` that holds; the category that of the gate with most dominance
    (``claims``: gate, category, dominance), the others are ``rejected``.
    """
    said = [F.when(truth(ok), F.lit("passed")).otherwise(F.array_join(lacks, ",")) for ok, lacks in gates.values()]
    best = strongest_claim([claim(gate, category, dominance, gates[gate][0]) for gate, category, dominance in claims], otherwise)
    return F.struct(
        matrix({n: ok for n, (ok, _) in gates.items()}).alias("gates"), F.map_from_arrays(F.array(*[F.lit(n) for n in gates]), F.array(*said)).alias("reasons"),
        first_reason(subtypes).alias("subtype"), best["category"].alias("category"), best["rejected"].alias("rejected"),
    )
