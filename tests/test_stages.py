"""Quarter queues, admission and the cascade of evidence against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evidence, intervals, queues, verdicts


def turns(rows, budget, cap):
    """The rows ``(id, bucket, capped, score)`` that a round robin takes, one after the other."""
    waiting = {b: sorted((r for r in rows if r[1] == b), key=lambda r: (-r[3], r[0])) for b in sorted({r[1] for r in rows if r[1]})}
    out, used = [], 0
    while len(out) < budget and any(waiting.values()):
        added = False
        for queue in waiting.values():
            while queue:
                row = queue.pop(0)
                if row[2] and used >= cap:
                    continue
                out.append(row[0])
                used += bool(row[2])
                added = True
                break
            if len(out) >= budget:
                break
        if not added:
            break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_queues_match_a_loop(spark, seed):
    rng = random.Random(seed)
    share = rng.choice([0.1, 0.5, 0.95])
    rows = [(i, rng.choice(["q1", "q1", "q1", "q2", "q3", "", None]), rng.random() < share, rng.randrange(20)) for i in range(rng.choice([0, 5, 120]))]
    df = spark.createDataFrame(rows, "id int, bucket string, capped boolean, score int")
    for budget, cap in ((rng.randint(1, 30), rng.randint(0, 6)), (40, 0), (200, 9)):
        got = queues.queue_budget(df, "bucket", [F.desc("score"), F.asc("id")], F.col("capped"), budget, cap).orderBy("place").collect()
        assert [r.id for r in got] == turns(rows, budget, cap) and [r.place for r in got] == list(range(1, len(got) + 1))


def admitted(rows, target, route_cap, total):
    """Outcomes and lookups of rows in order, one after the other."""
    out, urls, per_route, keys, n, used, denied = {}, {}, Counter(), set(), 0, 0, set()
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["stops"] and n >= target:
            out[r["ord"]] = "not_reached", False
            continue
        looked = False
        if r["eligible"] and r["needs"]:
            if r["url"] not in urls and (r["url"], r["stops"]) not in denied:
                if used < total and per_route[r["route"]] < route_cap:
                    urls[r["url"]] = True
                    per_route[r["route"]] += 1
                    used += 1
                else:
                    denied.add((r["url"], r["stops"]))
            looked = r["url"] in urls
        passes = r["eligible"] and (not r["needs"] or (looked and r["resolves"]))
        if not r["eligible"]:
            what = "ineligible"
        elif r["needs"] and not looked:
            what = "no_budget"
        elif not passes:
            what = "unresolved"
        elif r["key"] in keys:
            what = "duplicate"
        else:
            keys.add(r["key"])
            what = "admitted" if r["scored"] else "low_score"
            n += what == "admitted"
        out[r["ord"]] = what, looked
    return out


@pytest.mark.parametrize("seed", range(6))
def test_admission_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([0, 150, 150])
    coin = lambda p: rng.random() < p
    rows = [{"ord": i, "stops": i < 100, "eligible": coin(0.8), "needs": coin(0.5), "resolves": coin(0.7), "url": f"u{rng.randrange(90)}", "route": rng.choice("aaabc"), "key": f"k{rng.randrange(100)}", "scored": coin(0.8)} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "ord long, stops boolean, eligible boolean, needs boolean, resolves boolean, url string, route string, key string, scored boolean")
    for target, cap, total in ((10, 3, 8), (1000, 2, 30), (25, 50, 40)):
        got = {r.ord: (r.outcome, r.lookup) for r in queues.admit(df, target, cap, total).collect()}
        assert got == admitted(rows, target, cap, total)


SHELLS = evidence.Shells(("search",), ("topics",), ("results for", "refine your"), ("all topics", "browse by"), ("login", "cookies", "menu", "share"), ("the",))
LONG = "x" * 130


def test_reasons_in_their_order(spark):
    rows = [
        ("metro opens north", "short", None, "insufficient_text"), ("the", LONG, None, "missing_target_title"), ("metro opens north", f"metro opens {LONG}", "https://a.example/", "non_article_url"),
        ("metro opens north", f"metro opens {LONG}", "https://a.example/search/1", "search_results_page"), ("metro opens north", f"results for metro {LONG}", None, "search_results_shell"),
        ("metro opens north", f"metro opens, results for all, refine your words {LONG}", None, "search_results_shell"), ("metro opens north", f"metro opens, results for all {LONG}", None, None),
        ("metro opens north", f"all topics {LONG}", None, "index_or_navigation_shell"), ("metro opens north", f"metro {LONG}", "https://a.example/topics/metro", "index_or_navigation_shell"), ("metro opens north", f"metro opens {LONG}", "https://a.example/topics/metro", None),
        ("metro opens north", f"login cookies menu share {LONG}", None, "generic_navigation_boilerplate"), ("metro opens north", f"login cookies menu share metro opens {LONG}", None, None),
        ("metro opens north", f"metro {LONG}", None, "target_title_mismatch"), ("metro north", f"metro {LONG}", None, None), (None, None, None, "insufficient_text"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, title string, text string, url string")
    got = {r.i: r.reason for r in df.select("i", evidence.evidence_reason(F.col("title"), F.col("text"), F.col("url"), SHELLS).alias("reason")).collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}


def test_a_text_is_cleaned_once(spark):
    df = spark.createDataFrame([(1, "metro opens", LONG, None)], "id int, title string, text string, url string")
    found, _ = evidence.cascade(df, "id", "title", [("only", df.select("id", "text", "url"))], SHELLS)
    judged = df.select(F.when(F.length("text") > 0, evidence.evidence_reason(F.col("title"), F.col("text"), F.col("url"), SHELLS)).alias("reason"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1 and plan.count("lower(") <= 10, plan
    assert found.collect()[0].reason == judged.collect()[0].reason == "target_title_mismatch"


def test_only_unsatisfied_rows_go_on(spark):
    wanted = spark.createDataFrame([(i, "metro opens north") for i in range(6)], "id int, title string")
    landed = lambda *rows: spark.createDataFrame([(i, f"{t} {LONG}" if t else t, None) for i, t in rows], "id int, text string, url string")
    places = [("first", landed((0, "metro opens"), (1, "login"), (2, None))), ("second", landed((0, "metro opens"), (1, "north metro"), (2, "all topics"))), ("third", landed((3, "metro opens"), (2, None)))]
    found, tried = evidence.cascade(wanted, "id", "title", places, SHELLS)
    assert {r.id: (r.place, r.reason) for r in found.collect()} == {0: ("first", None), 1: ("second", None), 2: (None, "index_or_navigation_shell"), 3: ("third", None), 4: (None, "not_found"), 5: (None, "not_found")}
    assert [sorted(r._k for r in t.collect()) for t in tried] == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [2, 3, 4, 5]]
    assert evidence.cascade(wanted, "id", "title", [], SHELLS)[0].where("reason = 'not_found'").count() == 6


def test_points_in_periods_match_a_loop(spark):
    rng = random.Random(2)
    periods = [(rng.choice("ab"), s := rng.randrange(-50, 1000), s + rng.choice([0, 1, 2, 3, 7, 8, 64, 500, -3]), f"p{i}") for i in range(60)]
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(-60, 1600)])) for i in range(500)]
    df = spark.createDataFrame(points, "id int, r string, at int")
    found = intervals.in_periods(df, F.col("at"), F.col("r"), spark.createDataFrame(periods, "route string, start long, stop long, label string"), "id")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        fits = [p[3] for p in periods if r.at is not None and p[0] == r.r and p[1] <= r.at < p[2]]
        assert (r.n_periods, r.label) == (len(fits), fits[0] if len(fits) == 1 else None) and r.status == {0: "none", 1: "exactly_one"}.get(len(fits), "several")
    none = intervals.in_periods(df, F.col("at"), F.col("r"), spark.createDataFrame([], "route string, start long, stop long, label string"), "id")
    assert none.where("status = 'none'").count() == 500


def test_points_are_neither_multiplied_nor_shuffled(spark):
    periods = spark.createDataFrame([("a", 0, 1000 + i, f"p{i}") for i in range(60)], "route string, start long, stop long, label string")
    points = spark.createDataFrame([(i, "a", i) for i in range(1100)], "id long, r string, at long")
    found = intervals.in_periods(points, F.col("at"), F.col("r"), periods, "id")
    got = {r.id: (r.n_periods, r.label) for r in found.collect()}
    assert got == {i: (60 if i < 1000 else max(0, 1059 - i), "p59" if i == 1058 else None) for i in range(1100)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan and "explode" not in plan, plan


def test_stretches_match_a_loop(spark, monkeypatch):
    rng = random.Random(22)
    periods = []
    for i in range(90):
        start, size = rng.choice([None, *range(-20, 80)]), rng.choice([None, -1, 0, 1, 2, 5, 30, 300])
        periods.append((rng.choice(["a", "b", "b", "b", None]), start, None if start is None or size is None else start + size, rng.choice([f"p{i}", f"p{i}", None])))
    df = spark.createDataFrame(periods, "route string, start int, stop int, label string")
    fits = lambda r, t: [p[3] for p in periods if r is not None and p[0] == r and None not in p[1:3] and p[1] <= t < p[2]]
    for edges in (3, 1000):
        found = intervals.stretches(df, edges).collect()
        at = {(r.route, t): (r.n, r.label) for r in found for t in range(r.start, r.stop)}
        assert len(at) == sum(r.stop - r.start for r in found)
        want = {(r, t): (len(f), f[0] if len(f) == 1 else None) for r in "ab" for t in range(-30, 400) if (f := fits(r, t))}
        assert at == want
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-30, 400)])) for i in range(300)]
    got = intervals.in_periods(spark.createDataFrame(points, "id int, r string, at int"), F.col("at"), F.col("r"), df, "id").collect()
    assert len(got) == 300
    for r in got:
        f = [] if r.at is None else fits(r.r, r.at)
        assert (r.n_periods, r.label) == (len(f), f[0] if len(f) == 1 else None)


def test_verdicts_match_a_loop(spark):
    rng = random.Random(3)
    levels = {"r1": "repair", "r2": "repair", "t1": "retry", "h1": "hold", "b1": "block"}
    rows = [(rng.randrange(60), i, *[rng.random() < p for p in (0.1, 0.05, 0.06, 0.05, 0.03)]) for i in range(300)]
    rows = [(None if r[0] == 7 else r[0], *r[1:-1], None if r[0] == 9 else r[-1]) for r in rows]
    extra = [(3, "section", "retry"), (99, "section", "retry"), (99, "another", "hold")]
    df = spark.createDataFrame(rows, f"report int, pos int, {', '.join(f'{n} boolean' for n in levels)}")
    got = verdicts.judge(df, "report", "pos", [verdicts.Check(n, F.col(n), v) for n, v in levels.items()], spark.createDataFrame(extra, "report int, name string, level string")).collect()
    reports = {r[0] for r in rows} | {99}
    assert len(got) == len(reports)
    for r in got:
        found = [(pos, k, n, levels[n]) for rep, pos, *flags in rows if rep == r.report for k, (n, bad) in enumerate(zip(levels, flags, strict=True)) if bad]
        whole = [(n, v) for rep, n, v in extra if rep == r.report]
        all_levels = {f[3] for f in found} | {v for _, v in whole}
        want = "ok" if not all_levels else "repairable" if all_levels == {"repair"} else "fail" if "block" in all_levels or "retry" not in all_levels else "retry"
        first = min(found, default=None)
        assert (r.verdict, r.n_issues, r.n_failed_blocks, r.first_block) == (want, len(found) + len(whole), len({f[0] for f in found}), first[0] if first else None)
        assert r.first_issue == (first[2] if first else min((n for n, _ in whole), default=None))
        assert r.counts == Counter([f[2] for f in found] + [n for n, _ in whole])
    assert {r.verdict for r in got} == {"ok", "repairable", "retry", "fail"}


def test_levels_are_known():
    with pytest.raises(ValueError):
        verdicts.issues([verdicts.Check("x", F.lit(True), "never")])
