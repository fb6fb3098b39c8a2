import datetime as dt
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates, hashing, text, urls


def values(spark, rows, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_boundaries_of_terms(spark):
    rows = [("The cat-5 cable",), ("concat",), ("CAT",), ("地鐵cat",), (None,), ("straße",)]
    assert values(spark, rows, text.contains_any("t", ["cat"])) == [True, False, True, True, False, False]
    assert values(spark, rows, text.contains_any("t", ["cat"], "never")) == [True, True, True, True, False, False]
    assert values(spark, rows, text.contains_any("t", ["STRASSE", "地鐵"])) == [False, False, False, True, False, True]
    assert values(spark, rows, text.contains_any("t", [])) == [False] * 6


@pytest.mark.parametrize("mode", ["phrase", "token", "short", "tiny", "never"])
def test_compiled_terms_match_a_plain_search(spark, mode):
    terms = ["rail", "light rail", "a.b", "r&d", "地铁", "été", "abcd", "abcde"]
    texts = ["light railway", "light rail.", "xa.by", "a.b", "R&D unit", "r&ds", "地铁站", "l'été", "étés", "abcdx", "abcd x", "xabcde", "abcdef"]

    def plain(t):
        for term in terms:
            body = re.escape(term)
            if re.search(rf"(?<![a-z0-9]){body}(?![a-z0-9])" if text.BOUNDED[mode](term) else body, t.casefold()):
                return True
        return False

    assert values(spark, [(t,) for t in texts], text.contains_any("t", terms, mode)) == [plain(t) for t in texts]


def test_negation_ends_with_the_clause(spark):
    rows = [("no delay here",), ("no crash. delay here",), ("delay, not minor",), ("not a delay; a delay",), (None,)]
    assert values(spark, rows, text.contains_positive("t", ["delay"], ["no", "not"])) == [False, True, True, True, False]
    hits = values(spark, [("a crash",)], text.positive_hits({"title": F.col("t"), "body": F.lit("no crash, fire")}, ["crash", "fire"], ["no"], 5))
    assert [tuple(h) for h in hits[0]] == [("title", "crash")]


def test_spans_and_counts(spark):
    assert values(spark, [("é a cat",)], text.first_span("t", ["cat"]))[0].asDict() == {"start": 4, "stop": 7}
    assert values(spark, [("cat cat concat",)], text.term_count("t", ["cat"])) == [2]
    assert values(spark, [("two words 地鐵",)], text.wordish_count("t")) == [4]


def test_normalisation(spark):
    assert values(spark, [("  Ünder_the – 捷運 A-é!",)], text.normalize_title("t")) == ["ünder_the 捷運 a é"]
    assert values(spark, [("A%20b&C+d",), ("100%",)], text.slug("t")) == ["abandcd", "100"]
    assert values(spark, [("<p>a&nbsp;<b>b</b>\n c</p>",), (None,)], text.clean_text("t")) == ["a b c", ""]
    assert values(spark, [("abcdef",), ("abc",)], text.shorten(F.col("t"), 4)) == ["abc…", "abc"]
    assert values(spark, [("alpha beta gamma",), ("alphabetagamma",)], text.compact_words(F.col("t"), 10)) == ["alpha beta", ""]


def test_extraction(spark):
    rows = [("12 people were injured",), ("a dozen hurt",), ("over a dozen hurt, 14 in all",), ("More than a dozen ill",), ("Subway fire injures 14",), ("7 hospitalised, 2 hurt",), ("1234 injured",), ("none",), (None,)]
    patterns = [r"injures (\d{1,3})\b", r"\b(\d{1,3}) (?:people )?(?:were )?(?:injured|hurt|hospitalised)\b"]
    assert values(spark, rows, text.injuries("t", patterns, ["more than a dozen", "over a dozen"])) == [12, None, 14, 12, 14, 7, None, None, None]
    assert values(spark, [('x ```json\n{"a": 1}\n``` {',), ('so {"a": {"b": 2}} ok',), ("{broken",), (None,)], text.loose_json("t")) == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
    assert values(spark, [("see doi:10.1000/X-1.",), ("10.12/x",)], text.doi("t")) == ["10.1000/x-1", None]
    assert values(spark, [("EN 50126-1 and",), ("ISO9001",), ("SEN 1",)], text.standard_id("t", ["EN", "ISO"])) == ["EN 50126-1", "ISO9001", None]
    assert values(spark, [("saves money by 20%",), ("20% of " + "x" * 90 + " saves",)], text.near("t", ["saves"], r"\d+%")) == [True, False]
    assert values(spark, [("fire in hall. crash out",), ("fire and crash in hall",)], text.any_fragment("t", ["fire"], ["crash"])) == [False, True]
    assert values(spark, [("the Red line b12",)], text.meaningful_tokens("t", ["the"])) == [["b12", "line", "red"]]


def test_similarity_is_the_library_ratio(spark):
    rows = [("metro line opens", "metro line 2 opens"), ("a", ""), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(text.similarity("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


def test_urls(spark):
    rows = [("https://WWW.Ex.com:8080/a//b/?b=2&utm_x=1&a=1#f",), ("http://ex.com",), (None,), ("/x",)]
    assert values(spark, rows, urls.domain("t")) == ["ex.com:8080", "ex.com", "", ""]
    assert values(spark, rows, urls.canonical_key(F.col("t"))) == ["https://ex.com/a/b?a=1&b=2", "https://ex.com/", None, None]
    assert values(spark, [("http://a.b/c;p?q#f/",), ("http://a.b/c//",)], urls.dedupe_url("t")) == ["http://a.b/c", "http://a.b/c"]
    assert values(spark, [("a.b.c",)], urls.host_suffixes(F.col("t"))) == [["a.b.c", "b.c", "c"]]
    assert values(spark, [("x.a.com",), ("xa.com",), ("a.com",)], urls.host_matches(F.col("t"), "a.com")) == [True, False, True]
    assert values(spark, [("x.gov.uk",), ("m.news.com",), ("z",)], urls.source_class(F.col("t"), [("official", ["gov.uk"]), ("media", ["news.com"])], "other")) == ["official", "media", "other"]
    assert values(spark, [("see site:abc.org now",)], urls.original_domain(F.lit(None), F.lit("x"), F.col("t"))) == ["abc.org"]


def test_dates(spark):
    rows = [("2025-1-9 x",), ("2025-02-30",), ("Mon, 06 Jan 2025 10:00:00 GMT",), ("1999-05-06",), ("2024年3月5日",), ("since 2023",), ("none",), (None,)]
    d = dt.date
    assert values(spark, [("date unknown 2026",), ("tba, 2026-03-04",), ("2026",), (None,)], dates.loose_date("t", ["unknown", "tba"])) == [None, None, d(2026, 1, 1), None]
    assert values(spark, rows, dates.loose_date("t")) == [d(2025, 1, 9), None, d(2025, 1, 6), d(1999, 5, 6), d(2024, 3, 5), d(2023, 1, 1), None, None]
    assert values(spark, [("https://a/2024/02/03/x",), ("https://a/2024-02-03",), ("https://a/2024/13/03/",)], dates.path_date("t")) == [d(2024, 2, 3), d(2024, 2, 3), None]


def test_quarter_buckets_are_contiguous_and_clipped(spark):
    p = spark.createDataFrame([(dt.date(2025, 8, 24), dt.date(2026, 8, 25)), (dt.date(2025, 1, 1), dt.date(2025, 1, 1))], "s date, e date")
    got = sorted((r.label, r.bucket_start, r.bucket_end) for r in dates.quarter_buckets(p, "s", "e").collect())
    assert [g[0] for g in got] == ["2025-Q3", "2025-Q4", "2026-Q1", "2026-Q2", "2026-Q3"]
    assert got[0][1] == dt.date(2025, 8, 24) and got[-1][2] == dt.date(2026, 8, 25)
    assert all(a[2] == b[1] for a, b in zip(got, got[1:]))


def test_recency_policies(spark):
    rows = [(dt.date(2025, 1, 10),), (dt.date(2025, 1, 9),), (None,)]
    cutoff = F.lit(dt.date(2025, 1, 9))
    assert values(spark, rows, dates.is_recent(F.col("t"), cutoff, True), "t date") == [True, False, True]
    assert values(spark, rows, dates.is_recent(F.col("t"), cutoff, False), "t date") == [True, False, False]
    assert values(spark, rows, dates.in_period(F.col("t"), F.lit(dt.date(2025, 1, 9)), 0), "t date") == [True, True, False]


def test_ids_keep_nulls_and_sort_fields(spark):
    row = spark.range(1).select(hashing.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("j"), hashing.ingest_id({"b": F.lit(1)}).alias("i")).first()
    assert row.j == '{"a":null,"b":1}' and row.i.startswith("raw_") and len(row.i) == 28
