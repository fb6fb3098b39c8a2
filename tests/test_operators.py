import random
import re
from functools import partial

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import category_gates, dedupe, diagnostics, gates, identity, report, resolve, score, select
from gleaner.streaming import dedupe as streams
from gleaner.streaming.dedupe import run_to_end


def test_greedy_leaders_match_a_plain_loop(spark):
    rng = random.Random(4)
    for n, kinds in ((40, 60), (300, 500), (120, 20)):
        rows = [(i, [f"k{rng.randrange(kinds)}" for _ in range(rng.randrange(3))]) for i in range(n)]
        leaders, want = {}, {}
        for i, keys in rows:
            hit = next(((leaders[k], k) for k in keys if k in leaders), None)
            want[i] = hit or (i, None)
            if not hit:
                for k in keys:
                    leaders.setdefault(k, i)
        got = dedupe.greedy_leaders(spark.createDataFrame(rows, "ord long, keys array<string>"), "keys", "ord").collect()
        assert {r.ord: (r.leader_ord, r.matched_key) for r in got} == want


def replayed(rows, same=None):
    leaders, want = {}, {}
    for i, keys, *values in rows:
        hit = next(((j, k) for k in keys for j, v in leaders.get(k, []) if same is None or same(v, values)), None)
        want[i] = hit or (i, None)
        if not hit:
            for k in keys:
                leaders.setdefault(k, []).append((i, values))
    return want


def test_hot_keys_are_not_held_by_one_task(spark, monkeypatch):
    held, apply = [], GroupedData.applyInPandas

    def spy(self, *args):
        held.append(self.count().agg(F.max("count")).first()[0] or 0)
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInPandas", spy)
    monkeypatch.setattr(dedupe, "BATCH_ROWS", 20)
    rng = random.Random(8)
    hot = [(i, ["hot"] * (rng.random() < 0.4) + [f"k{rng.randrange(200)}" for _ in range(rng.randrange(3))]) for i in range(300)]
    chain = [(i, [f"c{i}", f"c{i + 1}"]) for i in range(300, 400)]
    rows = hot + chain
    got = dedupe.greedy_leaders(spark.createDataFrame(rows, "ord long, keys array<string>"), "keys", "ord").collect()
    assert {r.ord: (r.leader_ord, r.matched_key) for r in got} == replayed(rows)
    assert max(held, default=0) <= 20 * 3  # rows have three keys at most
    rows = [(i, [f"k{rng.randrange(20)}" for _ in range(rng.randrange(3))], rng.randrange(3)) for i in range(90)]
    got = dedupe.greedy_leaders(spark.createDataFrame(rows, "ord long, keys array<string>, v int"), "keys", "ord", lambda a, b: a[0] == b[0], ["v"]).collect()
    assert {r.ord: (r.leader_ord, r.matched_key) for r in got} == replayed(rows, lambda a, b: a[0] == b[0])


def test_provenance_is_whole(spark):
    rows = spark.createDataFrame([(1, i, "ab"[i % 2], str(i // 2 % 9)) for i in range(40)], "key int, ord int, lane string, query string")
    got = dedupe.merge_provenance(rows, "key", "ord", "lane", ["query"]).first()
    assert got.lanes == ["a", "b"] and got.provenance == [f"{'ab'[i % 2]}|{i // 2}" for i in range(18)]
    assert dedupe.merge_provenance(rows, "key", "ord", "lane", ["query"], 10).first().provenance == got.provenance[:10]
    assert [r.pos for r in dedupe.provenance(rows, "key", "ord", "lane", ["query"]).orderBy("pos").collect()] == list(range(1, 19))


def test_what_was_dropped_drops_nothing(spark):
    rows = [(1, ["u1", "t1"]), (2, ["u2", "t1"]), (3, ["u2", "t3"])]
    got = {r.ord: r.leader_ord for r in dedupe.greedy_leaders(spark.createDataFrame(rows, "ord long, keys array<string>"), "keys", "ord").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_leaders_by_a_comparison(spark):
    rows = [(1, ["k"], 5), (2, ["k"], 9), (3, ["k"], 5), (4, ["k"], 9)]
    got = dedupe.greedy_leaders(spark.createDataFrame(rows, "ord long, keys array<string>, v int"), "keys", "ord", lambda a, b: a == b, ["v"]).collect()
    assert {r.ord: r.leader_ord for r in got} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_unique_records_make_no_pairs(spark):
    rows = spark.range(160).select(F.col("id"), F.array(F.concat(F.lit("k"), F.col("id"))).alias("keys"))
    assert identity.blocked_pairs(rows, "keys", "id", []).count() == 0
    assert dedupe.greedy_leaders(rows, "keys", "id").where("leader_ord = id").count() == 160


def test_a_pair_of_several_keys_is_one_pair(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["b"])], "id long, keys array<string>")
    assert sorted((r.a_id, r.b_id) for r in identity.blocked_pairs(rows, "keys", "id", []).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_precedence(spark):
    e = resolve.evidence
    pieces = [e(F.lit("b"), 5), e(F.lit("a"), 5, 3), e(F.lit("c"), 1, eligible=False), e(F.lit(None).cast("string"), 0)]
    r = spark.range(1).select(resolve.resolve(pieces).alias("r")).first().r
    assert r.winner.value == "b" and [c.value for c in r.conflicts] == ["a", "c"]


def test_caps_hold_down_what_comes_before(spark):
    yes = F.lit(True)
    got = spark.range(1).select(score.capped(50, [("a", "add", yes, 30), ("c", "cap", yes, 60), ("b", "add", yes, 10)]).alias("x"), score.capped(50, [("a", "add", yes, 90)]).alias("y"), score.capped(5, [("a", "add", F.lit(None).cast("boolean"), 90)]).alias("z")).first()
    assert (got.x, got.y, got.z) == (70, 100, 5)


def test_contract_lists_every_violation(spark):
    rows = spark.createDataFrame([(1, "x", 2), (None, "", 9)], "a int, b string, c int")
    got = [r[0] for r in rows.select(gates.contract(["a", "b"], [("range", F.col("c") < 5)])).collect()]
    assert got == [[], ["missing:a", "missing:b", "range"]]


def test_diverse_matches_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(i, f"g{i % 2}", float(rng.randrange(50)), rng.randrange(3), rng.randrange(2)) for i in range(80)]
    got = select.diverse(spark.createDataFrame(rows, "id long, g string, s double, t int, u int"), "g", "s", ["t", "u"], 9, 7.0, "id").collect()
    want = []
    for g in ("g0", "g1"):
        left, seen = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), {}
        for k in range(9):
            best = max(left, key=lambda r: (r[2] - 7.0 * (seen.get(("t", r[3]), 0) + seen.get(("u", r[4]), 0)), r[2], -r[0]))
            seen["t", best[3]], seen["u", best[4]] = seen.get(("t", best[3]), 0) + 1, seen.get(("u", best[4]), 0) + 1
            left.remove(best)
            want.append((g, best[0], k + 1))
    assert sorted((r.g, r.id, r.pick) for r in got) == sorted(want)


def test_source_diverse_prefers_new_sources(spark):
    rows = [(1, "g", "s", 9.0), (2, "g", "s", 8.0), (3, "g", "t", 6.0)]
    got = select.source_diverse(spark.createDataFrame(rows, "id long, g string, src string, s double"), "g", "s", "src", 2, 4.0, "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pick)] == [1, 3]


def test_rebalance_swaps_within_the_tolerance(spark):
    rows = [(1, "g", 1, 9.0), (2, "g", 1, 8.0), (3, "g", 2, 7.5), (4, "g", 3, 1.0)]
    got = select.rebalance(spark.createDataFrame(rows, "id long, g string, b int, s double"), "g", "b", "s", 2, 1.0, "id").collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_water_filling():
    assert select.water_fill(["a", "b", "c"], 8, 4) == {"a": 3, "b": 3, "c": 2}
    assert select.water_fill(["a", "b"], 100, 3) == {"a": 3, "b": 3}
    assert select.water_fill([], 5, 3) == {} and select.water_fill(["a", "b", "c"], 2, 4) == {"a": 1, "b": 1, "c": 0}


def test_streaks(spark):
    rows = spark.createDataFrame([(i, i in (2, 3, 7)) for i in range(9)], "i int, hit boolean")
    assert sorted((r.start, r.length) for r in diagnostics.streaks(rows, [], "i", F.col("i"), F.col("hit")).collect()) == [(2, 2), (7, 1)]


def test_quotes_match_a_plain_search(spark):
    texts = [(1, "the quick  brown\nfox jumps over it all day"), (2, "xquick brown foxes"), (3, None), (4, "")]
    quotes = [(1, "quick brown fox"), (2, "quick brown\tfox jumps over it all"), (3, ""), (4, "ick brown fo"), (5, "absent words here"), (6, None), (7, "fox")]
    got = report.find_quotes(spark.createDataFrame(texts, "id long, t string"), "t", ["id"], spark.createDataFrame(quotes, "q long, s string"), "s", "q").collect()
    assert sorted((r.id, r.quote_key) for r in got) == [(1, 1), (1, 2), (1, 4), (1, 7), (2, 1), (2, 4)]


def test_grounding(spark):
    rows = spark.createDataFrame([("a  b", "x a b c"), ("", "x"), (None, "x"), ("q", None)], "q string, e string")
    assert [r[0] for r in rows.select(report.grounded(F.col("q"), F.col("e"))).collect()] == [True, False, False, False]


def test_blocks(spark):
    text = "intro\n<!-- candidate_id: 4 -->\nfirst\n<!--candidate_id:5-->second"
    got = report.blocks(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "t", ["id"]).collect()
    assert [(r.pos, r.candidate_id, r.block) for r in got] == [(1, 4, "first"), (2, 5, "second")]


def test_blocks_of_any_signs(spark):
    text = "<!-- candidate_id: 4 -->\nfirst\n\n3\u0001\u0000 half <!-- note -->\n\n<!-- candidate_id: 5 -->\n12\u0001 x"
    got = report.blocks(spark.createDataFrame([(1, text)], "id int, t string"), "t", ["id"]).collect()
    assert [(r.pos, r.candidate_id, r.block) for r in got] == [(1, 4, "first\n\n3\u0001\u0000 half <!-- note -->"), (2, 5, "12\u0001 x")]


def test_attach_once(spark):
    a, b = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, o int"), spark.createDataFrame([("k", 7, "x")], "key string, o int, v string")
    assert sorted((r.key, r.o, r.v) for r in resolve.attach_once(a, b, ["key"], "o").collect()) == [("k", 1, "x"), ("k", 2, None), ("m", 3, None)]


def test_streams_write_all_that_has_landed(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(10).repartition(3).write.parquet(path)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    assert run_to_end(stream.where("id % 2 = 0")).count() == 5


def test_streams_keep_events_that_come_late(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "read_landed", partial(streams.read_landed, files_per_batch=1))
    path = f"file://{tmp_path}/events.parquet"
    for day in ("2024-06-01", "2024-06-01", "2024-06-01", "2024-01-01"):
        spark.sql(f"SELECT 1L AS user_id, 'view' AS event_type, timestamp_ntz'{day} 10:20:00' AS ts").write.mode("append").parquet(path)
    assert sorted(str(r.hour) for r in streams.first_events(spark, path).collect()) == ["2024-01-01 10:00:00", "2024-06-01 10:00:00"]


@pytest.mark.parametrize("budget", [0, 3])
def test_backfill_is_short_of_the_target(spark, budget):
    pool = spark.range(10).select("id", (F.col("id") * 1.0).alias("s"))
    got = select.backfill(pool.where("id < 2"), pool, "id", [F.desc("s")], 6, budget).collect()
    assert sum(r.filled for r in got) == budget and len(got) == 2 + budget


def test_interleave_by_blocks_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(select, "RANK_BLOCK", 3)
    rng = random.Random(3)
    rows = [(i, f"r{min(rng.randrange(9), 4)}", rng.randrange(100)) for i in range(120)]
    got = {r.id: r.pick for r in select.interleave(spark.createDataFrame(rows, "id long, route string, s int"), "route", [F.desc("s"), F.asc("id")], "id").collect()}
    by, first = {}, {}
    for i, r, s in rows:
        by.setdefault(r, []).append((-s, i))
        first.setdefault(r, i)
    want, k = {}, 0
    for rank in range(max(map(len, by.values()))):
        for r in sorted(by, key=lambda r: (first[r], r)):
            if rank < len(by[r]):
                k += 1
                want[sorted(by[r])[rank][1]] = k
    assert got == want


def test_labels_are_corrected_in_order(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],)], "l array<string>")
    got = [r[0] for r in rows.select(resolve.correct_labels(F.col("l"), [(F.array_contains("l", "a"), "c")], [(F.array_contains("l", "b"), "a")])).collect()]
    assert got == [["b", "c"], []]


def test_titles_need_agreeing_metadata(spark):
    t, f = F.lit(True), F.lit(False)
    cases = [(0.95, f, f, 0, f, t), (0.95, f, f, 0, f, f), (0.5, t, f, 0, f, t), (0.5, f, t, 4, t, t), (0.5, f, t, 3, t, t)]
    got = spark.range(1).select(*[resolve.accept_title(F.lit(r), e, tr, F.lit(n), p, a).alias(f"c{i}") for i, (r, e, tr, n, p, a) in enumerate(cases)]).first()
    assert list(got) == [True, False, True, True, False]


def test_gate_changes(spark):
    a, b = F.create_map(F.lit("x"), F.lit(True), F.lit("y"), F.lit(False)), F.create_map(F.lit("x"), F.lit(False), F.lit("y"), F.lit(True))
    assert spark.range(1).select(diagnostics.gate_changes(a, b)).first()[0] == ["gained:y", "lost:x"]


def test_no_sample_has_no_share(spark):
    assert spark.range(1).select(diagnostics.share(F.lit(1), F.lit(0))).first()[0] is None


def test_protected_kind_takes_the_last_place(spark):
    pool = spark.createDataFrame([(1, "a", 9), (2, "a", 8), (3, "b", 1)], "id int, kind string, s int")
    got = select.protect_coverage(pool.where("id < 3"), pool, "id", F.col("kind") == "b", [F.desc("s")], 2).collect()
    assert sorted(r.id for r in got) == [1, 3]
    full = select.protect_coverage(pool.where("id < 3"), pool, "id", F.col("kind") == "b", [F.desc("s")], 3).collect()
    assert sorted(r.id for r in full) == [1, 2, 3]


def scored(rng, n):
    return [(rng.choice("ab"), i, rng.choice("qrstu"), rng.randrange(40), rng.random() < 0.7, rng.choice("xyz")) for i in range(n)]


def test_rebalance_matches_a_loop(spark):
    rng = random.Random(3)
    for recent in (None, "recent"):
        rows = scored(rng, 120)
        df = spark.createDataFrame(rows, "g string, ord long, bucket string, score long, recent boolean, source string")
        got = {(r.g, r.ord) for r in select.rebalance(df, "g", "bucket", "score", 6, 8, "ord", recent).collect()}
        want = set()
        for g in "ab":
            pool = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))
            held = pool[:6]
            for b in sorted({r[2] for r in pool} - {r[2] for r in held}):
                best = next(r for r in pool if r[2] == b)
                several = [r for r in held if sum(x[2] == r[2] for x in held) > 1]
                if several and several[-1][3] - best[3] <= 8:
                    held = sorted([r for r in held if r is not several[-1]] + [best], key=lambda r: (-r[3], r[1]))
            for r in [r for r in pool if not r[4] and r not in held] if recent else []:
                now = [x for x in held if x[4]]
                if len(now) <= int(len(held) * 0.6):
                    break
                held = sorted([x for x in held if x is not now[-1]] + [r], key=lambda r: (-r[3], r[1]))
            want |= {r[:2] for r in held}
        assert got == want


def test_source_diverse_matches_a_loop(spark):
    rows = scored(random.Random(4), 150)
    df = spark.createDataFrame(rows, "g string, ord long, bucket string, score long, recent boolean, source string")
    got = {(r.g, r.ord, r.pick) for r in select.source_diverse(df, "g", "score", "source", 7, 5.0, "ord").collect()}
    want = set()
    for g in "ab":
        left, seen = [r for r in rows if r[0] == g], set()
        for pick in range(1, 8):
            best = max(left, key=lambda r: (r[3] + 5.0 * (r[5] not in seen), r[3], -r[1]))
            seen.add(best[5])
            left.remove(best)
            want.add((g, best[1], pick))
    assert got == want


def test_signals_are_looked_for_once(spark):
    texts = ["The of the line", "thex of", "xthe", "ofthe-the", "STRASSE 12", "straße", "a.b", "a b", "", None, "of  the", "1the", "the"]
    packs = {"one": ["the", "12"], "two": ["of the"], "three": ["a.b", "line"], "four": ["straße"], "five": [], "six": ["Σας", "of"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = category_gates.view_signals(df, {"v": F.col("text")}, {"v": packs})
    s = category_gates.of(got)
    asked = got.withColumn("any", F.greatest(*[s(n) for n in packs])).select("i", "any", *[s(n).alias(n) for n in packs], *[(s(n) & ~s("one")).alias(f"{n}_more") for n in packs])
    want = {i: {n: bool(re.search(text.term_regex(p).replace("(?!)", "(?!x)x"), (t or "").lower().replace("ß", "ss"))) for n, p in packs.items()} for i, t in enumerate(texts)}
    assert {r.i: {n: r[n] for n in packs} for r in asked.collect()} == want
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("of\\ the") == 1 and plan.count("split(") == 1, plan


def test_pairs_are_counted_without_being_made(spark):
    rng = random.Random(3)
    rows = [(rng.choice((None, *range(90))), sorted({f"{rng.choice('abc')}|{rng.randint(0, 4)}" for _ in range(rng.randint(0, 4))}, key=lambda _: rng.random())) for _ in range(120)]
    df = spark.createDataFrame(rows, "id int, keys array<string>")
    want = {r.block: r["count"] for r in identity.blocked_pairs(df, "keys", "id", []).groupBy("block").count().collect()}
    counts = identity.pair_counts(df, "keys", "id")
    assert {r.block: r.n_pairs for r in counts.collect()} == want and len(want) > 10
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_meet_where_they_may_be_equal(spark):
    rows = [(i, ["k"], u, t) for i, (u, t) in enumerate([("u", "x"), ("u", "x"), ("u", None), ("v", "x"), (None, "x"), ("u", "y"), (None, "x")])]
    df = spark.createDataFrame(rows, "id int, keys array<string>, user string, type string")
    got = identity.blocked_pairs(df, "keys", "id", ["user", "type"], equal=["user"], no_conflict=["type"])
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == [(0, 1), (0, 2), (1, 2), (2, 5)]
