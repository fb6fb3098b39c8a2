"""Event identities: their components and ids, blocking keys, blocked pairs and their comparison."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.hashing import event_id
from gleaner.functions.text import BOUNDED, conflicting, fold, injuries, once, term_regex
from gleaner.operators.sizes import small
from gleaner.scratch import materialize

Named = list[tuple[str, list[str]]]
#: Components of an identity, in the order of their hash's fields but for the version.
SINGLE = ("event_class", "country", "city", "operator", "project", "package", "contract", "action", "event_object", "incident_type", "vendor")
SCOPE = ("city", "operator", "project")
#: Days that reports of one event may be apart: awards are told of for weeks.
WINDOW, AWARD_WINDOW = 3, 21
#: Rows of a chunk of a group whose pairs are made, and tasks that make them at most.
CHUNK_ROWS, TASKS = 1000, 8192


def blocking_keys(groups: dict[str, list[Column]]) -> Column:
    """One key for each named group whose parts are all known, such as ``type|city``."""
    keys = []
    for name, parts in groups.items():
        known = parts[0].isNotNull()
        for p in parts[1:]:
            known = known & p.isNotNull()
        keys.append(F.when(known, F.concat_ws("|", F.lit(name), *[p.cast("string") for p in parts])))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def pair_counts(rows: DataFrame, keys: str, ord_column: str) -> DataFrame:
    """``block, n_pairs``: how many pairs ``blocked_pairs`` has of each block, without making them.

    Pairs that share a set of keys are counted from its rows; those whose
    largest key is shared but that share smaller ones too are taken off and put
    back by the sizes of these sets.  A row of m keys is in 2^m - 1 sets, so m
    should be small; groups may be of any size.
    """
    sorted_keys = F.array_sort(keys)
    chosen = lambda mask: F.filter(sorted_keys, lambda _, i: F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1)
    sets = F.transform(F.sequence(F.lit(1).cast("long"), (F.pow(F.lit(2.0), F.size(sorted_keys)) - 1).cast("long")), chosen)
    held = rows.where(F.col(ord_column).isNotNull() & (F.size(keys) > 0)).select(F.explode(sets).alias("_set"), F.col(ord_column).alias("_ord"))
    n = F.col("_n")
    of_set = held.groupBy("_set", "_ord").agg(F.count("*").alias("_n")).groupBy("_set").agg(F.shiftright(F.sum(n) * F.sum(n) - F.sum(n * n), 1).alias("_pairs"))
    signed = F.when(F.size("_set") % 2 == 1, F.col("_pairs")).otherwise(-F.col("_pairs"))
    return of_set.groupBy(F.element_at("_set", -1).alias("block")).agg(F.sum(signed).alias("n_pairs")).where("n_pairs > 0")


def blocked_pairs(rows: DataFrame, keys: str, ord_column: str, carry: list[str], equal: Iterable[str] = (), no_conflict: Iterable[str] = ()) -> DataFrame:
    """Each pair of rows that share a key, once, with the columns ``carry`` as ``a_*`` and ``b_*``.

    Of those in ``equal`` both sides must be known and equal, of those in
    ``no_conflict`` they must not be known and differ; these pairs only are
    asked for their least key.

    A pair belongs to its least shared key only, so no distinct over pairs is
    needed.  Keys are as selective as their groups make them; rows of one key
    that have nothing else to tell them apart should be consolidated first.
    """
    exploded = rows.select(F.explode(keys).alias("_key"), F.col(keys).alias("_keys"), ord_column, *carry)
    side = lambda p: exploded.select("_key", F.col("_keys").alias(f"{p}_keys"), F.col(ord_column).alias(f"{p}_{ord_column}"), *[F.col(c).alias(f"{p}_{c}") for c in carry])
    on = F.col("_key") == F.col("_b_key")
    for c in equal:
        on &= F.col(f"a_{c}") == F.col(f"b_{c}")
    for c in no_conflict:
        on &= F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(True))
    on &= F.col(f"a_{ord_column}") < F.col(f"b_{ord_column}")
    pairs = side("a").join(side("b").withColumnRenamed("_key", "_b_key"), on).drop("_b_key")
    return pairs.where(F.col("_key") == F.array_min(F.array_intersect("a_keys", "b_keys"))).drop("a_keys", "b_keys").withColumnRenamed("_key", "block")


def group_pairs(rows: DataFrame, group: list[str], ord_column: str, carry: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """``group`` and the columns ``ord_column`` and ``carry`` of both, as ``a_`` and ``b_``, of each pair of rows of one known group, the earlier first.

    A group of n rows is cut into chunks of about ``size`` rows, and each two of
    them meet on their own, so that no task has more than two chunks of a group
    at a time, and the tasks become more with the pairs.
    """
    known = rows.where(~F.greatest(F.lit(False), *[F.col(c).isNull() for c in group]))
    sizes = known.groupBy(*group).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, int(pairs / size / size)))
    held = known.join(small(sizes.select(*group, F.ceil(F.col("_n") / size).cast("int").alias("_chunks"))), group)
    chunk, every = F.pmod(F.xxhash64(ord_column), F.col("_chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    keys = [*group, "_a", "_b"]
    side = lambda p, q: held.select(*group, chunk.alias(f"_{p}"), every.alias(f"_{q}"), *[F.col(c).alias(f"{p}_{c}") for c in (ord_column, *carry)]).repartition(tasks, *keys)
    return side("a", "b").join(side("b", "a"), keys).where(F.col(f"a_{ord_column}") < F.col(f"b_{ord_column}")).drop("_a", "_b")


def conflicts(components: list[tuple[str, Column, Column]]) -> Column:
    """Names of the components that both sides know and that differ."""
    return F.array_compact(F.array(*[F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(n)) for n, a, b in components]))


def matches(components: list[tuple[str, Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(a == b, F.lit(n)) for n, a, b in components]))


def same_event(matched: Column, conflicting: Column, days: Column, window: Column | int, least: int, anchors: list[str]) -> Column:
    """No conflict, dates within the window, ``least`` matches and one of the anchors among them."""
    window = F.lit(window) if isinstance(window, int) else window
    anchored = F.arrays_overlap(matched, F.array(*[F.lit(a) for a in anchors]))
    return (F.size(conflicting) == 0) & F.coalesce(F.abs(days) <= window, F.lit(True)) & (F.size(matched) >= least) & anchored


@dataclass(frozen=True)
class IdentityRules:
    """What identities are told by: for each component the groups of terms, the first of which that a text has names it."""

    named: dict[str, Named]
    country_of: dict[str, str] = field(default_factory=dict)
    contract: str = r"(?!)()"
    stations: str = r"(?!)()"
    purchase_actions: Named = field(default_factory=list)
    purchase_terms: list[str] = field(default_factory=list)
    other_actions: Named = field(default_factory=list)
    incident_category: str = "incident"
    purchase_category: str = "procurement"
    hurt: tuple[str, ...] = ()
    many_hurt: tuple[str, ...] = ()
    version: str = "1"


def _words(folded: Column) -> Column:
    return F.array_distinct(F.split(folded, "[^a-z0-9]+"))


def _single(terms: Iterable[str]) -> bool:
    """Whether all terms are single words, which are found among the words of a text."""
    return all(re.fullmatch("[a-z0-9]+", t.casefold()) for t in terms)


def first_named(folded: Column, groups: Named, words: Column | None = None) -> Column:
    """The name of the first group that a folded text has a term of; null without one.

    Terms that are single words are looked up among the text's distinct
    ``words``.  Of others one expression finds those of all groups: at each
    place of a text that of the first group, so the least of what is found is
    the first group.
    """
    if not groups:
        return F.lit(None).cast("string")
    rank = {}
    for i, (_, terms) in enumerate(groups):
        for term in terms:
            rank.setdefault(term.casefold(), i)
    if _single(rank):
        found = F.array_intersect(_words(folded) if words is None else words, F.array(*[F.lit(t) for t in rank]).cast("array<string>"))
    else:
        bounded = all(BOUNDED["phrase"](t) for t in rank)
        any_term = f"(?<![a-z0-9])(?=((?:{'|'.join(map(re.escape, rank))})(?![a-z0-9])))" if bounded else f"(?=({'|'.join(term_regex([t]) for t in rank)}))"
        found = F.array_distinct(F.regexp_extract_all(folded, F.lit(any_term), F.lit(1)))
    place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    return F.get(F.array(*[F.lit(n) for n, _ in groups]), F.array_min(F.transform(found, lambda t: place[t])))


def identity(text: Column, category: Column, date: Column, date_kind: Column, rules: IdentityRules, country: Column | None = None) -> Column:
    """The struct of an event's sixteen components (null where unknown) and ``event_id``, the hash of them; no publisher or query takes part.

    A text is folded and cut into words once, and each component found once.
    """
    own = [F.coalesce(country, F.lit(None).cast("string"))] if country is not None else []
    category = F.coalesce(category, F.lit(""))
    names = ("city", "operator", "project", "package", "vendor", "incident_type", "event_object")

    def read(s: Column) -> Column:
        t, words = s["t"], s["words"]
        parts = {n: first_named(t, rules.named.get(n, []), words) for n in names}
        bought = F.arrays_overlap(words, F.array(*[F.lit(x.casefold()) for x in rules.purchase_terms])) if rules.purchase_terms and _single(rules.purchase_terms) else t.rlike(term_regex(rules.purchase_terms))
        stations = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(rules.stations), F.lit(1))))
        parts |= {"contract": F.nullif(F.regexp_extract(t, rules.contract, 1), F.lit("")), "stations": stations, "bought": bought, "injury_count": injuries(t, rules.hurt, rules.many_hurt)}
        parts |= {"buying": first_named(t, rules.purchase_actions, words), "doing": first_named(t, rules.other_actions, words)}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def acted(p: Column) -> Column:
        hurt = p["incident_type"].isNotNull() | (category == rules.incident_category)
        action = (
            F.when(p["bought"] | (category == rules.purchase_category), F.coalesce(p["buying"], F.lit("procurement")))
            .when(hurt, "incident").otherwise(F.coalesce(p["doing"], F.lit("event")))
        )
        return F.struct(p.alias("p"), hurt.alias("hurt"), action.alias("action"))

    def whole(a: Column) -> Column:
        p, action = a["p"], a["action"]
        of_city = F.create_map(*[F.lit(x) for kv in rules.country_of.items() for x in kv])[p["city"]] if rules.country_of else F.lit(None).cast("string")
        of_purchase = action.isin(*[n for n, _ in rules.purchase_actions], "procurement") | p["bought"]
        thing = F.coalesce(p["event_object"], p["package"], F.when((F.size(p["stations"]) > 0) & (action == "opening"), "station"))
        values = {
            "event_class": F.when(a["hurt"], "incident").when(of_purchase, "procurement").otherwise("general"), "country": F.coalesce(*own, of_city), **{n: p[n] for n in (*names, "contract", "stations", "injury_count")}, "action": action, "event_object": thing,
            "event_date": date.cast("date"), "event_date_kind": date_kind, "contract_version": F.lit(rules.version),
        }
        order = ["contract_version", *SINGLE, "stations", "event_date", "event_date_kind", "injury_count"]
        # the id is hashed from the struct, so that every component is computed once
        return F.struct(*[values[n].alias(n) for n in order])

    cut = once(fold(text), lambda t: F.struct(t.alias("t"), _words(t).alias("words")))
    return once(once(once(cut, read), acted), whole)


def with_identity(rows: DataFrame, built: Column, out: str = "identity") -> DataFrame:
    """``rows`` with the struct of ``identity`` and the ``event_id`` of it beside."""
    rows = rows.withColumn(out, built)
    return rows.withColumn("event_id", event_id({n: F.col(f"{out}.{n}") for n in rows.schema[out].dataType.names}))


def identity_keys(i: str = "identity") -> Column:
    """The blocks that an identity can have an equal in: of a purchase its action and project; of an incident its type at its city, country or stations; of others each pair of known components, one of which tells of the scope."""
    at = lambda n: F.col(f"{i}.{n}")
    key = lambda *parts: F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    typed = (at("event_class") == "incident") & at("incident_type").isNotNull()
    places = [F.when(typed & at(n).isNotNull(), key("incident", at("incident_type"), n, at(n))) for n in ("city", "country")]
    stations = F.when(typed, F.transform(at("stations"), lambda x: key("incident", at("incident_type"), "station", x)))
    bought = F.when((at("event_class") == "procurement") & at("action").isNotNull() & at("project").isNotNull(), key("procurement", at("action"), at("project")))
    anchors, general = [*SCOPE, "event_object", "action"], F.coalesce((at("event_class") != "procurement") & ~typed, F.lit(False))
    pairs = [F.when(general & at(a).isNotNull() & at(b).isNotNull(), key("general", at("event_class"), a, at(a), b, at(b))) for k, a in enumerate(anchors) for b in anchors[k + 1 :] if a in SCOPE or b in SCOPE]
    return F.array_distinct(F.concat(F.array_compact(F.array(*places, bought, *pairs)), F.coalesce(stations, F.expr("cast(array() as array<string>)"))))


def pair_keys(i: str = "identity") -> Column:
    """Finer blocks than ``identity_keys``: what two identities must share beside a block for ``compare`` to call them one event.

    An incident needs two points more at one place, a purchase its package,
    its contract, or neither a package nor more than ``WINDOW`` days, others an
    anchor of something specific.  So no block is as large as a city or a
    project.
    """
    at = lambda n: F.col(f"{i}.{n}")
    every = lambda when, *names: F.when(when & ~F.greatest(F.lit(False), *[at(n).isNull() for n in names]), F.concat_ws("|", *[x for n in names for x in (F.lit(n), at(n).cast("string"))]))
    typed = F.coalesce((at("event_class") == "incident") & at("incident_type").isNotNull(), F.lit(False))
    bought = F.coalesce(at("event_class") == "procurement", F.lit(False))
    general = ~typed & ~bought
    of_incident = [every(typed, "incident_type", *n) for n in (("city", "operator"), ("city", "event_object"), ("city", "injury_count"), ("country", "injury_count"), ("country", "operator", "event_object"), ("city", "operator", "event_object"))]
    of_purchase = [every(bought, "event_class", "action", "project", n) for n in ("package", "contract")]
    of_others = [every(general, "event_class", *n) for n in (*(("project", x) for x in ("city", "operator", "event_object", "action")), ("event_object", "city"), ("event_object", "operator"))]
    stations = F.coalesce(at("stations"), F.expr("cast(array() as array<string>)"))
    at_station = F.transform(F.when(typed, stations).otherwise(F.expr("cast(array() as array<string>)")), lambda x: F.concat_ws("|", F.lit("station"), x, at("incident_type")))
    of_scope = lambda n: F.transform(stations, lambda x: F.concat_ws("|", F.lit("station"), x, F.lit(n), at(n)))
    scoped = [F.when(general & at(n).isNotNull(), of_scope(n)) for n in SCOPE]
    # dates at most WINDOW days apart are in one bucket of that width or in neighbouring ones
    bucket = F.floor(F.datediff(at("event_date"), F.lit("1970-01-01").cast("date")) / (WINDOW + 1))
    unpacked = bought & at("package").isNull() & at("action").isNotNull() & at("project").isNotNull() & at("event_date").isNotNull()
    days = F.when(unpacked, F.transform(F.array(bucket, bucket + 1), lambda d: F.concat_ws("|", F.lit("unpacked"), at("action"), at("project"), d.cast("string"))))
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.concat(F.array_compact(F.array(*of_incident, *of_purchase, *of_others)), at_station, *[F.coalesce(x, none) for x in (*scoped, days)]))


def compare(a: str, b: str, same_url: Column) -> Column:
    """``struct(same_event, article_duplicate, matched, conflicts, days, window)`` of two identities, the structs ``a`` and ``b``.

    Known components that differ conflict: places, project, package and
    contract always, others by the class of the two.  Without a conflict a
    common url tells of one article; incidents are one event by a score of what
    they share, at one place; purchases by their project and package or
    contract; others by two anchors, of a scope and of something specific.
    """
    left, right = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    truth = lambda c: F.coalesce(c, F.lit(False))
    equal, differ = (lambda n: truth(left(n) == right(n))), (lambda n: truth(left(n) != right(n)))
    both = lambda c: truth((left("event_class") == c) & (right("event_class") == c))
    apart, together = truth(conflicting(left("stations"), right("stations"))), truth(F.arrays_overlap(left("stations"), right("stations")))
    incident, bought, general = both("incident"), both("procurement"), both("general")
    days = F.abs(F.datediff(left("event_date"), right("event_date")))
    certain = truth((left("event_date_kind") != "publication_date") & (right("event_date_kind") != "publication_date"))
    awards = bought & truth((left("action") == "award") & (right("action") == "award"))
    window = F.when(awards & ~(certain & days.isNotNull()), AWARD_WINDOW).otherwise(WINDOW)
    late = certain & truth(days > window)
    rules = [
        *((n, differ(n)) for n in ("country", "city", "project", "package", "contract")), ("vendor", bought & differ("vendor")), ("procurement_action", bought & differ("action")), ("incident_type", incident & differ("incident_type")),
        ("event_object", general & differ("event_object")), ("station", (incident | general) & apart), ("action", general & differ("action")), ("event_date_window", late),
    ]
    conflicts = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]))
    free = F.size(conflicts) == 0
    article = truth(same_url) & free
    one_type, points = incident & equal("incident_type"), lambda n, by: F.when(equal(n), by).otherwise(0)
    score = points("city", 1) + F.when(together, 3).otherwise(0) + points("operator", 1) + points("event_object", 1) + points("injury_count", 2)
    of_incident = one_type & (score >= 2) & (equal("country") | equal("city") | together)
    nothing_packed = left("package").isNull() & right("package").isNull() & truth(days <= WINDOW)
    of_purchase = bought & equal("action") & equal("project") & (equal("package") | equal("contract") | nothing_packed)
    anchors = sum((points(n, 1) for n in (*SCOPE, "event_object", "action")), F.lit(0))
    other = truth(left("event_class") == right("event_class")) & ~one_type & ~(bought & equal("action"))
    scoped, specific = F.greatest(*[equal(n) for n in SCOPE]), equal("project") | equal("event_object") | together
    of_others = other & scoped & specific & (anchors >= 2)
    shared = lambda name, n, when: F.when(when & equal(n), F.lit(name))
    dated = F.when(days.isNotNull(), F.lit("bounded_date"))
    lists = [
        (one_type, [F.lit("incident_type"), shared("city", "city", F.lit(True)), shared("country", "country", ~equal("city")), F.when(together, F.lit("station")), *(shared(n, n, F.lit(True)) for n in ("operator", "event_object", "injury_count")), dated]),
        (bought & equal("action"), [*(shared(n, n, F.lit(True)) for n in ("project", "package", "contract", "vendor")), dated]),
        (other, [*(shared(n, n, F.lit(True)) for n in (*SCOPE, "event_object", "action")), F.when(together, F.lit("station")), dated]),
    ]
    matched = F.when(article, F.array(F.lit("canonical_article_url")))
    for when, names in lists:
        matched = matched.when(free & when, F.array_compact(F.array(*names)))
    matched = matched.otherwise(F.expr("cast(array() as array<string>)"))
    same = article | (free & (of_incident | of_purchase | of_others))
    return F.struct(same.alias("same_event"), article.alias("article_duplicate"), matched.alias("matched"), conflicts.alias("conflicts"), days.alias("days"), window.alias("window"))


def title_conflict(a: str, b: str, sets: Iterable[str] = ("lines", "numbered_lines", "entities"), most_days: int = 7) -> Column:
    """Rows ``a`` and ``b`` that a similar title can't make one: another region, sets of names without a common member, or dates too far apart."""
    truth = lambda c: F.coalesce(c, F.lit(False))
    region = truth((F.col(f"{a}.region") != "") & (F.col(f"{b}.region") != "") & (F.col(f"{a}.region") != F.col(f"{b}.region")))
    apart = [truth(conflicting(F.col(f"{a}.{n}"), F.col(f"{b}.{n}"))) for n in sets]
    return F.greatest(region, *apart, truth(F.abs(F.datediff(f"{a}.date", f"{b}.date")) > most_days))
