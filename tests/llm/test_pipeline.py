"""The pipeline against a plain version of each stage over a small table."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_quality import brute
from tokenizers import Tokenizer

from gleaner.llm import packing, pii
from gleaner.llm.tokenizer_files import WORD_TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(4000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += [t + " mail a.b@c.example or 10.1.2.3 end secret=0123456789abcdef0" for t in texts[:3]]
    texts += [None, "", "too short", "spam " * 300, "x " * 40_000] + texts[:4]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["s1", "s2", None]), len(t or ""), i) for i, t in enumerate(texts)] + [(None, texts[1] or "y " * 60, "en", "s1", 1, 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    return "file://" + path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs[-1], folder).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_columns_stay_but_in_the_last_stage(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality(stages):
    rows = stages[0].collect()
    found = brute([(k, r.text, r.source) for k, r in enumerate(rows)])
    want = [rows[int(k)].doc_id for k, _, _, kept in found if kept]
    assert 0 < len(want) < len(rows)
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in stages[1].collect())


def test_near_duplicates(stages):
    rows = stages[1].collect()
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        best[g] = min(best.get(g, float("inf")), float("inf") if r.doc_id is None else r.doc_id)
    assert sorted(best.values()) == sorted(float("inf") if r.doc_id is None else r.doc_id for r in stages[2].collect())


def test_personal_data(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[2:4])
    assert before.keys() == after.keys()
    trees, hidden = pii.fit(stages[2]), 0
    for i, r in before.items():
        text = re.sub("secret=[0-9a-f]{16,}", "secret=<SECRET>", r.text)
        hidden += text != r.text
        for _, a, b, _ in sorted(pii.find(text, trees), key=lambda s: -s[1]):
            text = text[:a] + next(f"<{k.upper()}>" for k, x, y in pii.base_spans(text) if (x, y) == (a, b)) + text[b:]
        assert after[i].text == text and after[i].n_chars == len(text)
    assert hidden


def test_mixing(stages):
    before, after = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    assert set(after) <= {r.doc_id for r in before}
    assert 0.5 * len(before) < sum(after.values()) < 1.6 * len(before)


def test_packing(stages):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    want = Counter()
    for r in stages[4].collect():
        want[str(r.doc_id)] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    pieces = stages[5].collect()
    got, copies = Counter(), {}
    for r in pieces:
        got[str(r.doc_id)] += r.length
        copies.setdefault(r.doc_row, []).append(r)
    assert got == want and len(copies) == stages[4].count()
    texts = Counter((str(r.doc_id), (*tokenizer.encode(r.text, add_special_tokens=False).ids, 2)) for r in stages[4].collect())
    assert Counter((str(c[0].doc_id), tuple(x for r in sorted(c, key=lambda r: r.start) for x in r.ids)) for c in copies.values()) == texts
    windows = packing.sequences(stages[5]).collect()
    assert sum(len(w.ids) for w in windows) == sum(r.length for r in pieces) and all(len(w.ids) <= 4096 for w in windows)


def test_run_is_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id", "start", "length", "ids_crc32").count().collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[5].groupBy("doc_id", "start", "length", "ids_crc32").count().collect()))


def test_columns_of_documents_may_have_any_name(spark, folder):
    clashing = ["kept", "n_links", "class_id", "component_id", "copy_no", "_row", "_text", "redacted", "a.b", "doc_row", "_kept"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in clashing:
        docs = docs.withColumn(c, docs["extra"] + len(c))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.count() > 0
            break
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == r["extra"] + len(c) for r in rows for c in clashing), name
