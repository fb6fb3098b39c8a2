import datetime as dt

from pyspark.sql import functions as F

from gleaner.sources import landed

RULES = {"blocked_paths": ["/video/"], "blocked_hosts": ["bad.example"], "blocked_suffixes": ["pdf"]}

RSS = """<rss><channel><title>Feed</title>
<item><title><![CDATA[First & best]]></title><link>https://a.example/1</link><description>&lt;p&gt;x</description><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate><source url="https://s.example">S</source></item>
<item><title></title><link>https://a.example/2</link></item></channel></rss>"""
ATOM = """<feed><entry><title>Second</title><link rel="alternate" href="https://a.example/3"/><summary>sum</summary><updated>2025-01-07T00:00:00Z</updated></entry></feed>"""


def test_feeds_are_read(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    got = {r.link: r for r in landed.read_rss(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 3
    assert got["https://a.example/1"].title == "First & best" and got["https://a.example/1"].source.href == "https://s.example"
    assert got["https://a.example/3"].summary == "sum" and got["https://a.example/3"].updated.startswith("2025-01-07")


def test_reasons_keep_their_order(spark):
    rows = [
        ("Rail news", "https://x.example/a", "s", "Mon, 06 Jan 2025 10:00:00 GMT"), ("", "https://x.example/b", "rail", None), ("Rail old", "https://x.example/c", "", "2024-01-01"), ("Rail bus", "https://x.example/d", "", None),
        ("Sports", "https://x.example/e", "", None), ("Rail clip", "https://x.example/video/f", "", None), ("Rail undated", "https://x.example/g", "", None), (None, None, None, None),
    ]
    entries = spark.createDataFrame(rows, "title string, link string, summary string, published string").withColumn("updated", F.lit(None).cast("string"))
    got = [r.reject for r in landed.normalize_feed(entries, "2025-01-01", ["rail"], ["bus"], RULES).collect()]
    assert got == [None, "empty_title", "not_recent", "excluded_topic", "off_topic", "url", None, "empty_title"]
    closed = [r.reject for r in landed.normalize_feed(entries, "2025-01-01", ["rail"], ["bus"], RULES, keep_undated=False).collect()]
    assert closed[6] == "not_recent"


def test_hits(spark):
    rows = [("https://ok.example/a", "2025-01-09", None), ("https://ok.example/2024/01/01/x", None, None), ("https://bad.example/a", None, None), ("https://ok.example/b", "soon", None)]
    got = landed.normalize_hits(spark.createDataFrame(rows, "href string, date string, published string"), "2025-01-10", "2025-01-20", 3, RULES).collect()
    assert [r.reject for r in got] == [None, "date", "blocked_host", None] and got[0].published_date == dt.date(2025, 1, 9)


def test_metadata_of_pages(spark):
    html = """<meta content="2025-02-03" name="citation_publication_date"><meta name='empty' content=''><script type="application/ld+json">{bad</script><script type="application/ld+json">{"a": 1}</script><link rel="canonical" href="https://c.example/x">"""
    row = landed.page_metadata(spark.createDataFrame([(html,), (None,), ("",)], "html string"), "html", ["citation_publication_date", "empty"]).collect()
    assert row[0].meta == {"citation_publication_date": "2025-02-03"} and row[0].json_ld == '{"a": 1}' and row[0].canonical == "https://c.example/x"
    assert row[2].meta == {} and row[2].json_ld is None and row[2].canonical is None


def test_cascade_takes_the_first_known_value(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, None, "x")], "k int, u string, v string"), spark.createDataFrame([(1, "p", "q"), (2, "r", None)], "k int, u string, v string")
    got = {r.k: (r.origin, r.u, r.v) for r in landed.enrich(rows, "k", [("a", a), ("b", b)], ["u", "v"]).collect()}
    assert got == {1: ("a", "p", "x"), 2: ("b", "r", None), 3: (None, None, None)}


def test_best_link(spark):
    html = '<a href="/1">Metro opens today</a> <a class="m" href="/long">metro line opens</a><a href=\'/2\'>metro line opens</a>'
    links = landed.anchors(spark.createDataFrame([(1, "New metro line opens", html)], "id int, title string, html string"), "html", ["id", "title"])
    assert links.count() == 3
    assert [tuple(r) for r in landed.best_link(links, "id", "title", "href", "label", ["new"]).collect()] == [(1, "/2", "metro line opens")]


def test_blocks_of_labelled_lines(spark):
    got = landed.parse_blocks(spark.createDataFrame([(1, "x\n## hit\nTitle: A: b\n url：http://u\n## hit\nTitle:\n"), (2, None)], "id int, t string"), "t", ["id"], "## hit\n", {"title": "Title", "url": "url"}).collect()
    assert [(r.pos, r.title, r.url) for r in got] == [(1, "A: b", "http://u"), (2, None, None)]


def test_records_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, lane string")
    landed.write_records(rows, f"file://{tmp_path}/p", "lane")
    landed.write_records(rows, f"file://{tmp_path}/j", form="json")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 2
    assert sorted(r.id for r in landed.read_json(spark, f"file://{tmp_path}/j", "id int, lane string").collect()) == [1, 2]
