import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing
from gleaner.llm.tokenizer_files import WORD_TOKENIZER

TEXTS = [
    None, "", "   \n", "Hello, world! It's naïve — don’t", "<|endoftext|> a<|startoftext|>b", "x " * 9000, "İstanbul ΣΑΣ ǅ ﬁ é", "tab\tvt\x0bff\x0cfs\x1cnel\x85nb\xa0ls end",
    "a" * 50_000, "repeat me", "repeat me", "日本語 テスト 12345 67", "́ start",
]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "no id")], "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "'clash' as length", "1 as offset")
    return packing.pack(docs, WORD_TOKENIZER, with_ids=True).collect()


def ids(text):
    return [*Tokenizer.from_file(WORD_TOKENIZER).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_pieces_are_the_documents_ids(packed):
    for i, text in [*enumerate(TEXTS), (None, "no id")]:
        pieces = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        want = ids(text)
        assert [x for r in pieces for x in r.ids] == want
        assert all(r.doc_tokens == len(want) for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)


def test_rows_of_a_document_are_told_apart(packed):
    twins = {r.doc_row for r in packed if r.doc_id is not None and TEXTS[r.doc_id] == "repeat me"}
    assert len(twins) == 2
    for r in packed:
        assert len({x.doc_id for x in packed if x.doc_row == r.doc_row}) == 1


def test_other_tokenizers_encode_whole_texts(spark):
    assert packing.cuts_at_space(Tokenizer.from_file(WORD_TOKENIZER))
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert not packing.cuts_at_space(tokenizer)
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    got = {}
    for r in packing.pack(docs, path, with_ids=True).orderBy("start").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(TEXTS)}


def test_sequences_have_no_gaps(packed):
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_query_without_ids_gives_the_same_pieces(spark, packed):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "no id")], "doc_id long, text string")
    key = lambda r: (str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, packing.pack(docs, WORD_TOKENIZER, shard_pieces=3).collect())) == sorted(map(key, packed))


def test_sequences_join_the_tokens(packed, spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    row = packing.sequences(packing.pack(docs, WORD_TOKENIZER, with_ids=True)).collect()
    assert len(row) == 1 and sum(row[0].lengths) == len(row[0].ids)


def tightest(lengths, window):
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        at = min(fits, key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(window)
            at = len(rooms) - 1
        rooms[at] -= n
    return sorted(rooms)


def test_best_fit_matches_a_plain_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 400):
        lengths = rng.integers(1, 65, n)
        number, offset = packing.best_fit_decreasing(lengths, 64)
        used = np.bincount(number, lengths) if n else np.zeros(0)
        assert sorted((64 - used).astype(int).tolist()) == tightest(lengths.tolist(), 64)


def test_forgetting_does_not_change_ids():
    import pyarrow as pa

    small = packing.WordIds(Tokenizer.from_file(WORD_TOKENIZER), memory=4)
    for text in ["a b c d e f", "a b g h", "c d e f g h i j", "a j"]:
        got, _ = small.encode(pa.array([text]), 2)
        assert got.tolist() == ids(text)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD_TOKENIZER).collect() == []
