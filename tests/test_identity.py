"""Event leaders against a plain loop, on reports of few words."""

import dataclasses
import datetime
import difflib
import itertools
import random
from collections import Counter

import pytest

from gleaner.operators import identity, leaders
from gleaner.plans import events
from pyspark.sql import functions as F

NAMES = {"city": ["alville", "borton"], "operator": ["acme", "zenith"], "project": ["north line", "east loop"], "vendor": ["ironworks", "brightco"], "incident_type": ["fire", "collision"], "event_object": ["lift", "gate"]}
RULES = identity.IdentityRules(
    named={n: [(x, [x]) for x in names] for n, names in NAMES.items()} | {"package": [("signals", ["package s"]), ("power", ["package p"])]},
    country_of={"alville": "aland", "borton": "bland"}, contract=r"contract ([a-z][0-9]+)", stations=r"station ([a-z]+)",
    purchase_actions=[("award", ["awarded"]), ("tender", ["tender"])], purchase_terms=["awarded", "tender"], other_actions=[("upgrade", ["upgrade"]), ("opening", ["opens"])], hurt=(r"injures (\d{1,3})\b",),
)
SCHEMA = "ord long, report string, category string, date date, date_kind string, url_key string, title_key string"


def same_event(a, b, same_url):
    """``(same, conflicts)`` of two identities, by the rules in words."""
    known = lambda n: a[n] is not None and b[n] is not None
    eq, ne = (lambda n: known(n) and a[n] == b[n]), (lambda n: known(n) and a[n] != b[n])
    cls = a.event_class if a.event_class == b.event_class else None
    sa, sb = set(a.stations), set(b.stations)
    conflicts = [n for n in ("country", "city", "project", "package", "contract") if ne(n)]
    conflicts += [n for n in {"procurement": ["vendor", "action"], "incident": ["incident_type"], "general": ["event_object", "action"]}.get(cls, []) if ne(n)]
    if cls in ("incident", "general") and sa and sb and not sa & sb:
        conflicts.append("station")
    days = abs((a.event_date - b.event_date).days)
    certain = "publication_date" not in (a.event_date_kind, b.event_date_kind)
    if certain and days > 3:
        conflicts.append("date")
    if conflicts:
        return False, True
    if same_url:
        return True, False
    if cls == "incident" and eq("incident_type"):
        score = eq("city") + eq("operator") + eq("event_object") + 2 * eq("injury_count") + 3 * bool(sa & sb)
        return score >= 2 and (eq("city") or eq("country") or bool(sa & sb)), False
    if cls == "procurement" and eq("action"):
        return eq("project") and (eq("package") or eq("contract") or (a.package is None and b.package is None and days <= 3)), False
    anchors = [n for n in ("city", "operator", "project", "event_object", "action") if eq(n)]
    return bool(cls and set(anchors) & {"city", "operator", "project"} and (set(anchors) & {"project", "event_object"} or sa & sb) and len(anchors) >= 2), False


def leaders_of(rows, least=0.9):
    """The leader of each row and what it is followed by, one row after the other."""
    kept, out = [], {}
    for r in rows:
        by, found = "url", next((k for k in kept if r.url_key and k.url_key == r.url_key), None)
        first = next((k for k in kept if r.title_key and k.title_key == r.title_key), None)
        if not found and first and not same_event(first.identity, r.identity, False)[1]:
            by, found = "title", first
        if not found:
            near = [k for k in kept if set(k["keys"]) & set(r["keys"])]
            alike = next((k for k in near if r.title_key and k.title_key and difflib.SequenceMatcher(None, r.title_key, k.title_key).ratio() >= least), None)
            if alike and same_event(alike.identity, r.identity, False)[0]:
                by, found = "similar", alike
            else:
                by, found = "event", next((k for k in near if same_event(k.identity, r.identity, False)[0]), None)
        if found:
            out[r.ord] = found.ord, by
        else:
            kept.append(r)
            out[r.ord] = r.ord, None
    return out


def found_leaders(rows, **options):
    return {r.ord: (r.leader_ord, r.by) for r in leaders.event_leaders(rows, **options).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(12)
    one = lambda *x: rng.choice(x)
    out = []
    for i in range(260):
        words = [one("alville", "borton", ""), one("acme", "zenith", ""), one("north line", "east loop", ""), one("awarded to ironworks", "awarded to brightco", "tender out", "upgrade", "opens", "seen"), one("fire", "collision", "", "", "")]
        words += [one("package s", "package p", "", ""), one("contract a1", "contract b2", "", ""), one("station east", "station west", "", ""), one("lift", "gate", "", ""), one("injures 3", "injures 4", "")]
        date = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(30))
        out.append((i, " ".join(w for w in words if w), one("incident", None, None, None), date, one("publication_date", "incident_date"), one(f"u{rng.randrange(30)}", None, ""), one(f"a common beginning of title {rng.randrange(20)}", "", "")))
    return events.identified(spark.createDataFrame(out, SCHEMA), RULES).withColumn("keys", identity.identity_keys())


def test_leaders_match_a_loop(rows):
    want = leaders_of(sorted(rows.collect(), key=lambda r: r.ord))
    assert found_leaders(rows) == want
    assert {by for _, by in want.values()} == {None, "url", "title", "similar", "event"}


DAY = datetime.date(2024, 3, 1)
#: Reports in order (text, category, days after the first, kind of date, url, title), and what each follows: its place and why.
SCENARIOS = {
    "two reports of one incident": ([("alville fire station east injures 14", None, 0, "u1", "smoke in a tunnel"), ("alville station east fire injures 14", None, 0, "u2", "fourteen hurt below ground")], [None, (0, "event")]),
    "incidents of one day at two stations": ([("alville fire station east injures 14", None, 0, "u1", "a"), ("alville fire station west injures 14", None, 0, "u2", "b")], [None, None]),
    "an award that is told of again": ([("alville north line awarded package s", None, 0, "u1", "a"), ("north line package s awarded, to be signed", None, 10, "u2", "b")], [None, (0, "event")]),
    "one project, two packages": ([("north line awarded package s", None, 0, "u1", "a"), ("north line awarded package p", None, 0, "u2", "b")], [None, None]),
    "one vendor, two contracts under one title": ([("north line awarded to ironworks contract a1", None, 0, "u1", "t"), ("north line awarded to ironworks contract b2", None, 0, "u2", "t")], [None, None]),
    "tender and award": ([("north line tender package s", None, 0, "u1", "a"), ("north line awarded package s", None, 0, "u2", "b")], [None, None]),
    "one url, two texts": ([("alville fire", None, 0, "u1", "a"), ("borton collision", None, 0, "u1", "b")], [None, (0, "url")]),
    "one title, two cities": ([("alville awarded package s", None, 0, "u1", "t"), ("borton awarded package s", None, 0, "u2", "t")], [None, None]),
    "similar titles of one event": ([("alville acme upgrade north line", None, 0, "u1", "acme chosen for the north line"), ("acme upgrade north line", None, 0, "u2", "acme is chosen for the north line")], [None, (0, "similar")]),
    "similar titles of two events": ([("alville acme upgrade north line", None, 0, "u1", "acme chosen for the north line"), ("borton acme upgrade north line", None, 0, "u2", "acme is chosen for the north line")], [None, None]),
    "only the first leader of a title is asked": ([("alville upgrade", None, 0, "u1", "t"), ("borton upgrade", None, 0, "u2", "t"), ("borton acme upgrade", None, 0, "u3", "t"), ("upgrade", None, 0, "u4", "t")], [None, None, None, (0, "title")]),
    "a similar title before an earlier event": ([("alville fire station east injures 3", None, 0, "u1", "quite another headline"), ("alville collision", None, 0, "u2", "x"), ("alville acme fire station east", None, 0, "u1", "y"), ("alville fire injures 3 lift", None, 0, "u5", "quite another headlines")], [None, None, (0, "url"), (0, "similar")]),
}


def test_scenarios(spark):
    """All at once: the names of each have its number."""
    words = [w for names in NAMES.values() for w in names] + ["station east", "station west"]
    own = lambda text, k: " ".join(t + str(k) if t in " ".join(words).split() and t not in ("station", "line", "loop") else t for t in text.replace(",", "").split())
    n = range(len(SCENARIOS))
    rules = dataclasses.replace(RULES, named=RULES.named | {c: [(own(x, k), [own(x, k)]) for x in names for k in n] for c, names in NAMES.items()}, country_of={f"{c}{k}": f"{c[0]}land{k}" for c in ("alville", "borton") for k in n}, stations="station ([a-z]+[0-9]+)")
    rows = [(100 * k + i, own(text, k), kind, DAY + datetime.timedelta(days=late), "publication_date", f"{k} {url}", f"{k} {title}") for k, (given, _) in enumerate(SCENARIOS.values()) for i, (text, kind, late, url, title) in enumerate(given)]
    found = found_leaders(events.identified(spark.createDataFrame(rows, SCHEMA), rules))
    for k, (name, (_, want)) in enumerate(SCENARIOS.items()):
        assert {o - 100 * k: (x - 100 * k, by) for o, (x, by) in found.items() if o // 100 == k} == {i: (i, None) if w is None else w for i, w in enumerate(want)}, name


def test_entities_keep_similar_titles_apart(spark):
    rows = [(0, "acme upgrade north line", None, DAY, "publication_date", "u0", "works on the north line 1"), (1, "acme upgrade north line", None, DAY, "publication_date", "u1", "works on the north line 2")]
    built = events.identified(spark.createDataFrame(rows, SCHEMA), RULES).withColumn("facts", F.struct(F.lit("").alias("region"), *[F.array(F.regexp_extract("title_key", "[0-9]", 0)).alias(n) for n in ("lines", "numbered_lines", "entities")], F.col("date")))
    assert found_leaders(built) == {0: (0, None), 1: (0, "similar")}
    assert found_leaders(built, facts="facts", conflict=identity.title_conflict) == {0: (0, None), 1: (0, "event")}


def test_a_title_and_url_of_many_rows(spark):
    rows = [(i, f"seen {i}", None, DAY, "publication_date", "" if i % 3 else "one", "a title that all have") for i in range(5_000)]
    found = found_leaders(events.identified(spark.createDataFrame(rows, SCHEMA), RULES))
    assert found[0] == (0, None) and {x for i, x in found.items() if i and i % 3 == 0} == {(0, "url")} and {x for i, x in found.items() if i % 3} == {(0, "title")}


def test_compare_matches_the_rules_in_words(rows):
    held = {r.ord: r.identity for r in rows.collect()}
    a, b = (rows.where("ord < 90").select(F.col("ord").alias(f"{s}_ord"), F.col("identity").alias(s)) for s in "ab")
    got = a.crossJoin(b).where("a_ord < b_ord").select("a_ord", "b_ord", identity.compare("a", "b", F.lit(False)).alias("c")).collect()
    assert len(got) == 90 * 89 // 2
    for r in got:
        assert (r.c.same_event, bool(r.c.conflicts)) == same_event(held[r.a_ord], held[r.b_ord], False), r


def test_pair_keys_hold_every_pair_of_a_block(rows):
    held = rows.select("ord", "identity", "keys", identity.pair_keys().alias("fine")).collect()
    for a, b in itertools.combinations(held, 2):
        if set(a["keys"]) & set(b["keys"]) and same_event(a.identity, b.identity, False)[0]:
            assert set(a.fine) & set(b.fine), (a, b)


def test_pairs_of_a_large_group_are_dealt_over_tasks(spark):
    rows = [(i, "a" if i % 7 else "b", "x" if i % 50 else None, f"v{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "ord int, city string, operator string, value string")
    got = identity.group_pairs(df, ["city", "operator"], "ord", ["value"], 40).withColumn("task", F.spark_partition_id()).collect()
    want = {(a[0], b[0], a[1], a[3], b[3]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] and b[2]}
    assert {(r.a_ord, r.b_ord, r.city, r.a_value, r.b_value) for r in got} == want and len(got) == len(want)
    of_task = Counter(r.task for r in got)
    assert len(of_task) >= 20 and max(of_task.values()) < len(got) / 4
    assert identity.group_pairs(df.where("operator IS NULL"), ["city", "operator"], "ord", []).count() == 0


def test_identity_pairs_deal_their_largest_group(spark, monkeypatch, tmp_path):
    pages = [(i, f"http://h{i % 2}.com/en/{i}", "<title>t</title> thanly ingha") for i in range(300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(identity.group_pairs, "__defaults__", (30,))
    of_task = Counter(r.task for r in events.d2_identity_pairs(spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).collect())
    assert sum(of_task.values()) == 300 * 299 // 2 and max(of_task.values()) < 300 * 299 // 8


def test_a_report_is_read_once(spark):
    df = spark.createDataFrame([(1, "x", None, DAY, "publication_date", "u", "t")], SCHEMA)
    plan = events.identified(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2 and plan.count("regexp_extract_all(") == 1, plan


def test_unique_rows_are_never_compared(spark):
    for n in (40, 80):
        unique = spark.createDataFrame([(i, f"event number {i}", None, None, "publication_date", f"u{i}", f"t{i}") for i in range(n)], SCHEMA)
        built = events.identified(unique, RULES)
        assert leaders.alike_classes(built.select(F.col("event_id").alias("cls"), "identity").distinct()).count() == 0
        assert {x for x, _ in found_leaders(built).values()} == set(range(n))


def test_empty_table(rows):
    assert found_leaders(rows.limit(0)) == {}


def test_pairs_of_decided_identities_are_left_behind(spark, monkeypatch):
    alike, real = [], leaders.materialize

    def spy(df, tag):
        table = real(df, tag)
        if tag == "alike":
            alike.append((table.schema["one"].dataType.simpleString(), table.count()))
        return table

    monkeypatch.setattr(leaders, "materialize", spy)
    assert events.d4_event_leaders(spark, "/root/testdata/sf0.01").count() == 250
    assert len(alike) > 1 and all(kind == "bigint" for kind, _ in alike)
    assert alike[0][1] > 0 and all(2 * later < first for (_, first), (_, later) in zip(alike, alike[1:]) if first > 10)
