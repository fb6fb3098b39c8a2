"""The feeds' data source, the scan over all feeds and the first-wins stream, against plain loops."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import dedupe
from gleaner.sources import feeds
from gleaner.streaming import dedupe as streams

URLS = {"blocked_paths": ["/ads/"], "blocked_hosts": ["bad.example"], "blocked_suffixes": ["pdf"]}


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link><description>rail news</description><pubDate>{d or ''}</pubDate></item>" for t, u, d in items) + "</channel></rss>"


NEW, OLD = "Fri, 01 Mar 2024 10:00:00 GMT", "Sun, 01 Jan 2023 10:00:00 GMT"
FILES = {
    "a": rss(("First metro", "https://a.example/1", NEW), ("Second metro", "https://a.example/2", NEW), ("", "https://a.example/3", NEW), ("Old metro", "https://a.example/4", OLD)),
    "broken": "<rss><channel><item>", "blank": " \n",
    "b": rss(("first METRO!", "https://b.example/9", NEW), ("Third metro", "https://a.example/2?x=1", NEW), ("Fourth metro", "https://b.example/4", NEW)),
    "off": rss(("Weather", "https://w.example/1", NEW)), "ads": rss(("Metro sale", "https://a.example/ads/1", NEW), ("Metro deal", "https://x.bad.example/2", NEW)),
    "atom": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Fifth metro</title><link href="https://c.example/5"/><summary>x</summary><updated>2024-03-02T00:00:00Z</updated></entry></feed>',
    "many": rss(*((f"Metro number {i}", f"https://m.example/{i}", NEW) for i in range(5))),
}
#: source, file, fallback, period, known bad
FEEDS = [("one", "a", None, None, False), ("bad, no fallback", "broken", None, None, False), ("bad, with fallback", "broken", "b", None, False), ("bad, of a period", "broken", "atom", "2024-Q1", False), ("gone, with fallback", "nowhere", "atom", None, False), ("both bad", "blank", "broken", None, False), ("topic", "off", None, None, False), ("blocked", "ads", None, None, False), ("known", "a", "b", None, True), ("long", "many", None, None, False)]


@pytest.fixture
def manifest(tmp_path):
    for name, data in FILES.items():
        (tmp_path / f"{name}.xml").write_text(data)
    place = lambda n: f"{tmp_path}/{n}.xml" if n else None
    (tmp_path / "manifest").mkdir()
    for i, (source, path, fallback, period, known) in enumerate(FEEDS):
        line = {"ord": i, "source": source, "path": place(path), "fallback": place(fallback), "period": period, "known_bad": known}
        (tmp_path / "manifest" / f"{i:03}.json").write_text(json.dumps(line) + "\n")
    return f"{tmp_path}/manifest"


def scanned(rows):
    return feeds.scan(rows, F.lit("2024-01-01").cast("date"), lambda t: text.contains_any(t, ["metro"]), lambda t: text.contains_any(t, ["secret"]), URLS, 3)


def test_statuses_and_entries(spark, manifest):
    found = scanned(feeds.read_feeds(spark, manifest))
    got = {r.source: (r.status, r.by_fallback, r.n_entries, r.n_duplicate, r.n_off_topic, r.n_blocked) for r in found.statuses.collect()}
    assert got == {
        "one": ("ok", False, 2, 0, 0, 0), "bad, no fallback": ("unreadable", False, 0, 0, 0, 0), "bad, with fallback": ("fallback_ok", True, 1, 2, 0, 0), "bad, of a period": ("unreadable", False, 0, 0, 0, 0),
        "gone, with fallback": ("fallback_ok", True, 1, 0, 0, 0), "both bad": ("empty", False, 0, 0, 0, 0), "topic": ("off_topic", False, 0, 0, 1, 0), "blocked": ("blocked", False, 0, 0, 0, 2), "known": ("known_bad", False, 0, 0, 0, 0), "long": ("ok", False, 3, 0, 0, 0),
    }
    entries = {(r.source, r.pos): r.reject for r in found.entries.collect()}
    assert [entries["one", i] for i in (1, 2, 3, 4)] == [None, None, "empty_title", "not_recent"]
    assert [entries["bad, with fallback", i] for i in (1, 2, 3)] == ["duplicate", "duplicate", None]
    assert [entries["long", i] for i in range(1, 6)] == [None] * 3 + ["over"] * 2


def test_only_wanted_feeds_are_opened(spark, manifest):
    one = feeds.read_feeds(spark, manifest, ["one"], ["feed"])
    assert [(r.source, r.status) for r in one.collect()] == [("one", "read")] and one.rdd.getNumPartitions() == 1
    assert feeds.read_feeds(spark, manifest, ["one", "long"]).rdd.getNumPartitions() == 2
    assert feeds.read_feeds(spark, manifest, ["long"], ["entry"]).count() == 5
    assert feeds.read_feeds(spark, manifest, ["none"]).count() == 0
    rows = feeds.read_feeds(spark, manifest)
    assert rows.rdd.getNumPartitions() == len(FEEDS)
    assert rows.where("source = 'one' AND kind = 'feed'").count() == 1 and rows.where("source = 'long' AND kind = 'entry'").count() == 5 and rows.where("kind = 'feed'").count() == len(FEEDS)


def test_too_many_feeds_are_an_error(spark, manifest, monkeypatch):
    monkeypatch.setattr(feeds, "MOST_FEEDS", 3)
    with pytest.raises(ValueError):
        feeds.manifest_feeds([f"{manifest}/{i:03}.json" for i in range(5)], feeds._opened(manifest)[0])


def test_stream_reads_what_is_new_in_the_manifest(spark, manifest, tmp_path):
    stream = feeds.stream_feeds(spark, manifest)
    seen = []
    for more in (None, {"ord": 50, "source": "later", "path": f"{tmp_path}/many.xml"}):
        if more:
            (tmp_path / "manifest" / "900.json").write_text(json.dumps(more))
        query = stream.writeStream.foreachBatch(lambda batch, _: seen.append({r.source for r in batch.where("kind = 'feed'").collect()})).option("checkpointLocation", f"{tmp_path}/progress").start()
        end = time.time() + 60
        while time.time() < end and not any(more is None or "later" in s for s in seen):
            time.sleep(0.2)
        query.stop()
    assert seen[0] == {f[0] for f in FEEDS} and {"later"} in seen


def test_keyed_state_gives_what_a_batch_gives(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", None, *(f"t{k}" for k in range(40))]), rng.choice(["", None, *(f"u{k}" for k in range(60))])) for i in range(400)]
    titles, addresses, want = set(), set(), []
    for i, t, u in rows:
        if not ((t and t in titles) or (u and u in addresses)):
            want.append((i, t or "", u or ""))
            titles.add(t)
            addresses.add(u)
    for files in (1, 7):
        rng.shuffle(rows)
        folder = f"{tmp_path}/{files}"
        for k in range(files):
            spark.createDataFrame(rows[k::files], "ord long, title_key string, url_key string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("ord long, title_key string, url_key string").option("maxFilesPerTrigger", 2).parquet(folder)
        assert sorted(map(tuple, streams.first_wins(stream).collect())) == want
    batch = spark.createDataFrame(rows, "ord long, t string, u string").withColumn("keys", F.array_compact(F.array(*[F.concat(F.lit(c), F.nullif(c, F.lit(""))) for c in "tu"])))
    assert sorted(r.ord for r in dedupe.greedy_leaders(batch, "keys", "ord").where("ord = leader_ord").collect()) == [w[0] for w in want]


def test_what_is_forgotten_changes_nothing(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 - k, "t", "u"), (100 + k, "t", "other")], "ord long, title_key string, url_key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    stream = spark.readStream.schema("ord long, title_key string, url_key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f")
    assert [tuple(r) for r in streams.first_wins(stream, ttl_ms=1).collect()] == [(8, "t", "u")]


def test_many_feeds_are_read_by_few_tasks(tmp_path):
    lines = [json.dumps({"ord": i, "source": f"s{i}", "path": f"{tmp_path}/none-{i}"}) for i in range(1000)]
    (tmp_path / "manifest.json").write_text("\n".join(lines))
    reader = feeds.FeedReader({"manifest": str(tmp_path / "manifest.json")})
    parts = reader.partitions()
    assert len(parts) <= 300
    read = [b.column("source")[0].as_py() for p in parts for b in reader.read(p)]
    assert sorted(read) == sorted(f"s{i}" for i in range(1000))
