"""Every registered curation query against its DuckDB SQL, on the smallest table set."""

import datetime
import itertools
import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import similarity
from gleaner.plans import ORACLE_SQL, QUERIES, picks, sources
from gleaner.sources import landed

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    if not Path(FOLDER).is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    result = engine.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    found = QUERIES[name](spark, FOLDER).count()
    assert found > 0 or name.startswith("f14_")  # too few pages there


def test_similar_titles_match_a_loop(spark, tmp_path):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "line", "station"]) for _ in range(6)) for _ in range(12)]
    titles = [t for b in base for t in (b, b.replace("alpha", "alphas", 1), b + " x", b[:-3])]
    pages = [(i, f"<html><title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    first = {t: titles.index(t) for t in titles}
    want = {}
    for a, b in itertools.combinations(sorted(first, key=first.get), 2):
        if (ratio := SequenceMatcher(None, b, a).ratio()) >= 0.84:
            want[first[a], first[b]] = round(ratio, 6)
    got = {(r.a_page, r.b_page): r.ratio for r in QUERIES["f14_similar_title_pairs"](spark, f"file://{tmp_path}").collect()}
    assert got == want and len(want) > 20


def page_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    return [(r.page_id, m[0] if (m := re.findall("<title>([^<]*)</title>", r.html)) else "", r.html) for r in rows]


def squeezed(t):
    return re.sub(r"[\W_]+", "", t.lower().replace("ß", "ss"))


def normalised(t):
    return re.sub(r"[^\w]+", " ", t.lower().replace("ß", "ss")).strip()


def test_no_similar_rows_are_lost(spark):
    rows = [(i, normalised(t)) for i, t, _ in page_rows(spark)]
    want = {}
    for (a, x), (b, y) in itertools.combinations(sorted(rows), 2):
        if x and y and x != y:
            m = SequenceMatcher(None, y, x)
            if m.real_quick_ratio() >= 0.72 and m.quick_ratio() >= 0.72 and 0.72 <= m.ratio() < 0.999:
                want[b, a] = round(m.ratio(), 6)
    got = {(r.later, r.earlier): r.ratio for r in QUERIES["f14_similar_rows"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and want


def test_paraphrases_match_a_loop(spark):
    def says_again(title, html):
        m = re.search(r"(?s)<p>(?:<b>)?([^<.]*[<.][^<.]*)", html)
        t, s = squeezed(title), squeezed(m[1] if m else "")
        return len(t) >= 12 and len(s) >= 12 and len(s) <= len(t) + 36 and 0.72 <= SequenceMatcher(None, t, s).ratio() < 0.999

    want = {i: says_again(t, h) for i, t, h in page_rows(spark)}
    assert {r.page_id: r.paraphrase for r in QUERIES["f15_title_paraphrases"](spark, "/root/testdata/sf0.01").collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_title_lookup_matches_a_loop(spark):
    docs = [(r.doc_id, r.lang, normalised((r.text or "").split(".")[0])) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.page_id: r.doc_id for r in QUERIES["r22_title_lookup"](spark, "/root/testdata/sf0.01").collect()}
    want = {}
    for i, title, html in page_rows(spark):
        t, lang = normalised(title), re.findall('<html lang="([a-z]*)"', html)[0]
        if t:
            fits = [d for d, its, begin in docs if its == lang and begin.split(" ")[:3] == t.split(" ")[:3] and (begin == t or SequenceMatcher(None, t, begin).ratio() >= 0.93 or (len(title) >= 60 and len(t.split(" ")) >= 4 and begin.startswith(t)))]
            want[i] = min(fits, default=None)
    assert got == want and {x is None for x in want.values()} == {True, False}


def test_copies_of_titles_make_no_pairs(spark, monkeypatch, tmp_path):
    title, sizes, keep = "Harbour line opens after long works " + "x" * 30, [], similarity.materialize
    pages = [(i, f'<html lang="en"><title>{title[: 59 + 3 * (i % 2)]}</title>') for i in range(40)] + [(40, '<html lang="fr"><title>Harbour line opens</title>'), (41, None)]
    texts = {9: title + " and more. Then", 7: title + " and more", 5: title[:58] + "y", 3: "Harbour line opens late.", 2: title[:59], 1: None}
    docs = [(100 * copy + i, "en", t) for copy in range(40) for i, t in texts.items()]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def spy(df, tag):
        table = keep(df, tag)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(similarity, "materialize", spy)
    got = {r.page_id: r.doc_id for r in QUERIES["r22_title_lookup"](spark, str(tmp_path)).collect()}
    assert got == {i: 2 for i in range(40)} | {40: None} and sum(sizes) <= 12, sizes


def test_title_lookup_finds_beginnings_of_other_first_words(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(similarity, "CHUNK", 9)
    rng, words = random.Random(3), "harbour line opens after long works near old market station today again".split()
    base = [" ".join(rng.sample(words, rng.choice((5, 8, 11)))) for _ in range(30)]
    changed = lambda t, at: t[:at] + rng.choice("xyz") + t[at + rng.randint(0, 1) :]
    pages = [(i, rng.choice(("en", "fr")), changed(t, rng.randrange(9))) for i, t in enumerate(base)] + [(30, "en", "Harbor line opens after long works in town"), (31, "en", "line"), (32, "en", "a" * 300)]
    docs = [(i, rng.choice(("en", "fr", None)), changed(t, rng.randrange(len(t)))) for i, t in enumerate(base * 4)]
    docs += [(200, "fr", "Harbour line opens after long works in town"), (201, "en", "Harbour line opens after long works in town"), (202, "en", "Harbor line opens after long works in town"), (203, "en", "lines"), (204, "en", "b" + "a" * 299), (205, "en", None)]
    spark.createDataFrame([(i, f'<html lang="{lang}"><title>{t}</title>') for i, lang, t in pages], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, lang, None if t is None else t + ". Then") for i, lang, t in docs], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, lang, t in pages:
        fits = [(d, b) for d, its, b in docs if its == lang and b and (normalised(b) == normalised(t) or SequenceMatcher(None, normalised(t), normalised(b)).ratio() >= 0.93 or (len(t) >= 60 and len(t.split()) >= 4 and normalised(b).startswith(normalised(t))))]
        want[i] = min(fits, default=(None, None))
    got = {r.page_id: r.doc_id for r in QUERIES["r22_title_lookup"](spark, str(tmp_path)).collect()}
    assert got == {i: d for i, (d, _) in want.items()} and got[30] == 201 and got[31] is None
    assert sum(b is not None and b.split()[:3] != pages[i][2].split()[:3] for i, (_, b) in want.items()) >= 10


def test_short_texts_of_few_letters_lose_no_pair(spark):
    rng = random.Random(9)
    texts = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 14))).strip() for _ in range(150)} - {""})
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for least in (0.6, 0.84, 0.95):
        ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
        want = {(a, b): (round(ratio(texts[b], texts[a]), 9), round(ratio(texts[a], texts[b]), 9)) for a, b in itertools.combinations(range(len(texts)), 2)}
        got = {(r.a, r.b): (round(r.ratio, 9), round(r.back, 9)) for r in similarity.similar_texts(rows, "i", "t", least, chunk=20).collect()}
        assert got == {k: v for k, v in want.items() if max(v) >= least}


def test_composed_texts_are_bounded(spark, monkeypatch):
    sizes, parse = [], landed.parse_blocks
    monkeypatch.setattr(sources, "COMPOSED", 10, raising=False)

    def spy(texts, column, *rest):
        sizes.extend(r[0] for r in texts.select(F.size(F.split(column, "== source\n")) - 1).collect())
        return parse(texts, column, *rest)

    monkeypatch.setattr(landed, "parse_blocks", spy)
    rows = QUERIES["s17_block_parser"](spark, "/root/testdata/sf0.01").collect()
    assert max(sizes) <= 10 and len(rows) == sum(sizes)
    assert {r.c_nationkey: r.pos for r in sorted(rows, key=lambda r: r.pos)} == Counter(r.c_nationkey for r in rows)


def test_report_blocks_hold_whole_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(picks, "COMPOSED", 3, raising=False)
    turns = [(c, t, f"line {t}\n\n" + "x" * (50 * c + t)) for c in (1, 2) for t in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = QUERIES["o13_whole_blocks"](spark, f"file://{tmp_path}").collect()
    assert sorted((r.conv_id, r.pos, r.candidate_id, r.size) for r in got) == [(c, t + 1, t * 10, len(s)) for c, t, s in turns]


def test_documents_of_one_beginning_are_not_duplicates(spark, tmp_path):
    start, end = "the same beginning " * 5, " the same end" * 6
    texts = [(1, start + "one" + end, "en", "a"), (2, start + "two" + end, "en", "b"), (3, start + "ONE" + end, "en", "b")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    turns = [(1, 0, "The first"), (1, 1, "The second"), (1, 2, "the  second!"), (1, 3, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    run = lambda name: QUERIES[name](spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: r.leader_ord for r in run("d4_greedy_leader")} == {1: 1, 2: 2, 3: 1}
    assert [(r.doc_id, r.leader) for r in run("d6_same_texts")] == [(3, 1)]
    assert [r.n_ids for r in run("d9_conflicting_texts")] == [2]
    assert sorted(r.turn for r in run("d13_whole_sections")) == [0, 1, 3]


def against_sql(spark, folder, name, tables):
    """The rows of a query and of its SQL over the given tables: ``(rows, schema)`` by name."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, f"file://{folder}")
    columns = ", ".join(df.columns)
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()))


def test_names_of_turns_are_folded(spark, tmp_path):
    turns = [(1, 1, "aßzz"), (1, 2, "asszz"), (1, 3, "sszz")]
    got, want = against_sql(spark, tmp_path, "d5_title_conflicts", {"conversations": (turns, "conv_id long, turn long, text string")})
    assert got == want == ["(1, 1, False)", "(1, 2, True)"]


def test_sentences_are_folded(spark, tmp_path):
    texts = [(1, "the ofß", "de"), (2, "the of", "de"), (3, "une. que", "fr"), (4, None, "fr")]
    got, want = against_sql(spark, tmp_path, "f13_fragment_gate", {"documents": (texts, "doc_id long, text string, lang string")})
    assert got == want == ["('de', 1, 2)", "('fr', 0, 2)"]


def test_entries_are_folded(spark, tmp_path):
    page = "<html><title>{}</title><p>{}</p>"
    pages = [(i, f"http://a.example/{i}", page.format(*t)) for i, t in enumerate([("", ""), ("one", "dieß"), ("two", "die"), ("three", "die ßonre"), ("four", "die onre")], 28)]
    got, want = against_sql(spark, tmp_path, "s2_feed_normaliser", {"pages": (pages, "page_id long, url string, html string")})
    assert got == want and sorted(eval(r, {"datetime": datetime})[0] for r in got) == ["empty_title", "excluded_topic", "kept", "off_topic"]


def test_numbers_of_standards_are_not_cut(spark, tmp_path):
    parts = [(k,) for k in (998_998, 999_000, 1_200_000, 1_200_001)]
    got, want = against_sql(spark, tmp_path, "f21_identifiers", {"part": (parts, "p_partkey long")})
    assert got == want == ["(1200000, None, '10.1234/ab.1200000')", "(1200001, None, '10.1234/ab.1200001')", "(998998, 'EN 999998-2', '10.1234/ab.998998')", "(999000, None, '10.1234/ab.999000')"]


def test_few_pairs_of_titles_are_compared(spark, monkeypatch):
    seen, real = {}, similarity.materialize

    def spy(df, tag):
        table = real(df, tag)
        seen[tag] = table.count()
        return table

    monkeypatch.setattr(similarity, "materialize", spy)
    titles = [(i, normalised(t)) for i, t, _ in page_rows(spark)]
    found = similarity.similar_texts(spark.createDataFrame(titles, "i long, t string"), "i", "t", 0.72).count()
    assert 0 < found <= seen["met"] <= 3 * found + 20


def test_chunks_and_long_texts_lose_no_pair(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((5, 60, 64, 65, 130, 150)))).strip() for _ in range(60)]
    texts = sorted({x for t in texts for x in (t, t[: len(t) * 2 // 3] + "zz", t[1:])})
    rows = spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate(texts)], "i string, t string")
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = {(f"k{a:03}", f"k{b:03}") for a, b in itertools.combinations(range(len(texts)), 2) if max(ratio(texts[b], texts[a]), ratio(texts[a], texts[b])) >= 0.7}
    got = [(r.a, r.b) for r in similarity.similar_texts(rows, "i", "t", 0.7, chunk=17).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_few_pairs_of_titles_are_stepped_through():
    rng, letters = random.Random(5), list("the old thing on the other street was not in their interest")
    titles = ["".join(rng.sample(letters, len(letters))) for _ in range(300)]
    titles += [t[:20] + t[23:40] + "xy" + t[40:] for t in titles[:40]]
    texts = similarity.Texts(pd.DataFrame({"text": titles}))
    stepped, real = [], similarity.common_subsequences
    with pytest.MonkeyPatch.context() as m:
        m.setattr(similarity, "common_subsequences", lambda codes, texts, left, *rest: stepped.append(len(left)) or real(codes, texts, left, *rest))
        found = {frozenset((texts.rows["text"][i], texts.rows["text"][j])) for x, y in similarity.block_pairs(texts, texts, 0.84) for i, j in zip(x, y, strict=True)}
    near = {frozenset((a, b)) for k, a in enumerate(titles) for b in titles[:k] if SequenceMatcher(None, a, b).ratio() >= 0.84 or SequenceMatcher(None, b, a).ratio() >= 0.84}
    assert near <= found and len(near) >= 40
    assert sum(stepped) < len(titles) * 10, sum(stepped)  # all pairs have their characters in common


def test_few_pairs_of_alike_letters_are_stepped_through_at_a_low_ratio():
    rng, letters = random.Random(6), list("the old thing on the other street was not in their interest")
    titles = ["".join(rng.sample(letters, len(letters))) for _ in range(300)]
    titles += [t[:15] + t[24:40] + "wxyz" + t[40:] for t in titles[:40]]
    texts = similarity.Texts(pd.DataFrame({"text": titles}))
    stepped, real = [], similarity.common_subsequences
    with pytest.MonkeyPatch.context() as m:
        m.setattr(similarity, "common_subsequences", lambda codes, texts, left, *rest: stepped.append(len(left)) or real(codes, texts, left, *rest))
        found = {frozenset((texts.rows["text"][i], texts.rows["text"][j])) for x, y in similarity.block_pairs(texts, texts, 0.72) for i, j in zip(x, y, strict=True)}
    near = {frozenset((a, b)) for k, a in enumerate(titles) for b in titles[:k] if SequenceMatcher(None, a, b).ratio() >= 0.72 or SequenceMatcher(None, b, a).ratio() >= 0.72}
    assert near <= found and len(near) >= 40
    assert sum(stepped) < len(titles) * 10, sum(stepped)  # all pairs have their characters in common


@pytest.mark.parametrize("many", [0, 1])
def test_parts_of_the_alphabet_lose_no_pair(monkeypatch, many):
    for name, value in {"OFTEN": -1000, "LOWS": 30, "MANY": many, "PAIRS": 50}.items():  # each text against the whole chunk, in words of both sizes
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 3, 20, 60, 64, 65, 130, 200)))) for letters in ("ab", "abcdefghij klmn", "äöü ßабвгд漢字", "a" * 9 + "bc") for _ in range(18)]
    texts = sorted({x for t in texts for x in (t, t[: len(t) * 3 // 4] + "zz", t[1:] + "b", t[::-1])} - {""})
    ratio = lambda x, y: max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio())
    alike = {frozenset((a, b)) for a, b in itertools.combinations(texts, 2) if 2 * min(len(a), len(b)) >= 0.72 * (len(a) + len(b)) and ratio(a, b) >= 0.72}
    whole, left, right = (similarity.Texts(pd.DataFrame({"text": t})) for t in (texts, texts[::2], texts[1::2]))
    for low, high in ((whole, whole), (left, right), (right, left)):
        got = [frozenset((low.rows["text"][i], high.rows["text"][j])) for x, y in similarity.block_pairs(low, high, 0.72) for i, j in zip(x, y, strict=True)]
        want = alike if low is high else {p for p in alike if any({a, b} == p for a in p for b in p if a in set(texts[::2]) and b in set(texts[1::2]))}
        assert len(got) == len(set(got)) and want <= set(got) and len(want) > 100


def test_kinds_by_letters_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 16)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(5)) for letters in ("aeiort", "mnopqrs", "äöülk", "abцдф") for _ in range(40)]
    texts = sorted({x for t in texts for x in (t, t[:20] + "xyz", t[3:])})
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    known = rows.select(F.col("t").alias("text"))
    assert known.select(similarity.kinds_by_letters(known).alias("kind")).distinct().count() >= 4
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if max(ratio(texts[b], texts[a]), ratio(texts[a], texts[b])) >= 0.72}
    got = [(r.a, r.b) for r in similarity.similar_texts(rows, "i", "t", 0.72, chunk=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_no_texts_have_no_pairs(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "i int, t string")
    assert similarity.similar_texts(rows, "i", "t", 0.72).collect() == []
    asked = spark.createDataFrame([(1, "en", "a title")], "p int, lang string, t string")
    items = spark.createDataFrame([], "d int, lang string, b string")
    assert [(r.p, r.d) for r in similarity.first_acceptable(asked, items, ["lang"], "d", "t", "b").collect()] == [(1, None)]
