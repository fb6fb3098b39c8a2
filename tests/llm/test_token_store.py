import glob
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gleaner.llm import token_store
from gleaner.llm.tokenizer_files import BYTE_TOKENIZER, WORD_TOKENIZER

RNG = random.Random(11)
PIECES = ["word", "Word,", "don't", "12", "3.5", "\n", "\t", " ", "  ", "   ", " ", " ", "\x0b", "\x85", "é", "漢字", "😀", "<|endoftext|>", "'s", ".", "...", "a.b,", "\r\n", "_x", "\x00"]
TEXTS = [None, "", " ", "a  b", "a   b", "\n b", " b", "a \n b", "x" * 3_000, *("".join(RNG.choice(PIECES) + RNG.choice(["", " ", " "]) for _ in range(RNG.randint(1, 60))) for _ in range(300))]


def brute(rows, path, end_id):
    tokenizer, at, out = Tokenizer.from_file(path), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out, at


ROWS = [(i * 37 % 1009 - 300, t) for i, t in enumerate(TEXTS)] + [(5, "twice"), (5, "twice"), (None, "no key")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, doc int").repartition(5)


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
@pytest.mark.parametrize("sizes", [{}, {"sequence": 8, "file_sequences": 3}, {"sequence": 50, "file_sequences": 2, "range_bytes": 900}])
def test_round_trip_against_brute_force(docs, path, sizes):
    got = token_store.round_trip(docs, path, **sizes).collect()
    want, _ = brute(ROWS, path, 0)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files_are_arrow_files_of_equal_sequences(docs):
    folder = tempfile.mkdtemp(prefix="spark-") + "/files"
    token_store.write_files(docs, folder, BYTE_TOKENIZER, sequence=64, file_sequences=4)
    want, total = brute(ROWS, BYTE_TOKENIZER, 0)
    files = sorted((token_store.Sequences(f) for f in glob.glob(f"{folder}/part-*")), key=lambda f: (f.range, f.part))
    ids = np.concatenate([f.ids(i)[f.mask(i).to_numpy(zero_copy_only=False)] for f in files for i in range(len(f))])
    assert len(ids) == total and ids.dtype == np.uint16
    ends = np.cumsum([n for _, _, n, _ in want])
    assert [zlib.crc32(ids[b - n : b].astype("<u4").tobytes()) for b, (_, _, n, _) in zip(ends, want, strict=True)] == [r[3] for r in want]
    with pa.memory_map(glob.glob(f"{folder}/part-*")[0]) as raw:
        table = pa.ipc.open_file(raw).read_all()
        assert table.schema.field("ids").type == pa.list_(pa.uint16(), 64) and table.schema.field("mask").type == pa.list_(pa.bool_(), 64)


def test_sequences_copy_nothing(docs):
    builder = token_store.FileBuilder(np.dtype("<u2"), 4, 3)
    builder.add(1, 0, np.arange(10, dtype="<u2"))
    buffer = pa.py_buffer(builder.file(0, 0))
    found = token_store.Sequences(buffer)
    assert len(found) == 3 and found.ids(2).tolist() == [8, 9, 0, 0] and found.mask(2).to_pylist() == [True, True, False, False]
    assert buffer.address <= found.ids(1).__array_interface__["data"][0] < buffer.address + buffer.size


def test_parts_give_the_ids_of_whole_texts():
    tokenizer = Tokenizer.from_file(BYTE_TOKENIZER)
    assert token_store.cuts_before_space(tokenizer) and not token_store.cuts_before_space(Tokenizer.from_file(WORD_TOKENIZER))
    texts = pa.array(TEXTS)
    got, want = token_store.SpaceIds(tokenizer, memory=20), token_store.WholeIds(tokenizer)
    for part in (texts, texts[:5], texts[100:]):
        (a, cut_a), (b, cut_b) = got.encode(part, 0), want.encode(part, 0)
        assert a.tolist() == b.tolist() and cut_a.tolist() == cut_b.tolist()


def test_checksums_combine():
    for _ in range(50):
        x, y = RNG.randbytes(RNG.randint(0, 40)), RNG.randbytes(RNG.randint(0, 400))
        assert token_store.crc_combine(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_empty_table(docs):
    assert token_store.round_trip(docs.limit(0), BYTE_TOKENIZER).count() == 0
