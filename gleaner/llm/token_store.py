"""Token ids in Arrow files of equal-length sequences.

Documents are brought into ascending order of their keys by a range shuffle,
encoded, and each range is written as files of the Arrow IPC file format: the
record batches have the columns ``ids`` and ``mask``, fixed-size lists of
``SEQUENCE`` values, so that sequence s of a file is a slice of memory at a
known place (``Sequences`` maps a file and copies nothing).  A range's ids run
on from sequence to sequence; the mask is false on what fills up the last one.
Ids take two bytes where the vocabulary allows it.  The metadata of a file
lists the documents in it, one row per piece: a document is cut only where a
file ends.

Files are Spark rows until they are written by Spark's own writer, so any
store that Spark reaches will do, and a task that is lost is repeated.  The
number of ids of a file is bounded, so is a task's memory.

Defined results: a null or empty text is the end id alone; rows of a null key
come first; rows of one key stay in the order of the input; an empty table
gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import crc32, lookup_join, slices, small_batches
from gleaner.llm.packing import WholeIds, WordIds, ranges
from gleaner.scratch import materialize, scratch_path

SEQUENCE, END_ID = 2048, 0
#: Sequences of a record batch and of a file; bytes of text of a range of keys at most, on average.
BATCH, FILE, RANGE_BYTES = 256, 4096, 1 << 30
#: Bytes of text that are encoded at a time.
BYTES = 6 << 20
#: A space between white space and white space (or the end): what a byte-level tokenizer may not be cut before.
TIGHT = r"[\s\x0b\x85\p{Z}] ([\s\x0b\x85\p{Z}]|$)"
#: A part that ends in letters or digits and marks after them; such marks are never part of a special token.
MARKED = r"^(?P<word>.*[\p{L}\p{N}])(?P<marks>[.,;:!?*#$%&)]+)$"
#: Keys of a file's metadata: the pieces of documents in it, as an Arrow file, and its place.
DOCUMENTS, PLACE = b"documents", b"place"
PIECES = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
#: What an Arrow file ends with; Spark's writer puts it at the end of each row.
MAGIC = b"ARROW1"


def cuts_before_space(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer is byte-level with the usual pattern, which joins a space only to what follows it."""
    form = json.loads(tokenizer.to_str())
    cut = form["pre_tokenizer"] or {}
    return not form["normalizer"] and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in form["added_tokens"])


class SpaceIds(WordIds):
    """Ids of texts by the ids of their parts, each with the space before it.

    The pre-tokeniser never joins across the place before a space, unless that
    space has white space on both sides; texts that have such a one are encoded whole.
    """

    def __init__(self, tokenizer: Tokenizer, memory: int = 1_000_000):
        self.tokenizer, self.memory = tokenizer, memory
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.whole = WholeIds(tokenizer)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and where each text's ids begin."""
        texts = pc.fill_null(texts, "")
        tight = pc.match_substring_regex(texts, TIGHT)
        if pc.any(tight).as_py():
            rows = [tight.to_numpy(zero_copy_only=False) == x for x in (False, True)]
            found = [self._by_parts(texts.filter(pc.invert(tight)), end_id), self.whole.encode(texts.filter(tight), end_id)]
            size = np.empty(len(texts), np.int64)
            begin = np.empty(len(texts), np.int64)
            for r, (_, cut), shift in zip(rows, found, (0, len(found[0][0])), strict=True):
                size[r], begin[r] = np.diff(cut), cut[:-1] + shift
            return np.r_[found[0][0], found[1][0]][ranges(begin, size)], np.r_[0, np.cumsum(size)]
        return self._by_parts(texts, end_id)

    def _by_parts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = lists.flatten()
        first = np.zeros(len(parts), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = len(coded.dictionary)
        used, place = np.unique(np.where(first, codes, codes + kinds), return_inverse=True)
        own = coded.dictionary.take(pa.array(used[used < kinds]))
        spaced = pc.binary_join_element_wise("", coded.dictionary.take(pa.array(used[used >= kinds] - kinds)), " ")
        flat, lengths = self.of_parts(pa.concat_arrays([own, spaced]))
        start = np.cumsum(lengths) - lengths
        ends_at = np.cumsum(sizes + 1) - 1
        codes = np.full(int((sizes + 1).sum()), len(lengths), np.int64)
        real = np.ones(len(codes), bool)
        real[ends_at] = False
        codes[real] = place
        size = np.r_[lengths, 1][codes]
        run = np.r_[0, np.cumsum(size)]
        ids = np.r_[flat, np.uint32(end_id)]
        return ids[ranges(np.r_[start, len(flat)][codes], size)], np.r_[0, run[ends_at + 1]]

    def of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts one after the other, and the length of each one's.

        The marks that a word ends in are a token of their own for the
        pre-tokeniser, so words share ids whatever marks follow them.
        """
        split = pc.extract_regex(parts, MARKED)
        stem = pc.if_else(split.is_valid(), pc.struct_field(split, "word"), parts).dictionary_encode()
        marks = pc.fill_null(pc.struct_field(split, "marks"), "").dictionary_encode()
        both = pa.concat_arrays([stem.dictionary, marks.dictionary]).dictionary_encode()
        at = self.places(both.dictionary)[both.indices.to_numpy(zero_copy_only=False)]
        begin = np.cumsum(self.lengths) - self.lengths
        halves = np.stack([at[stem.indices.to_numpy(zero_copy_only=False)], at[len(stem.dictionary) + marks.indices.to_numpy(zero_copy_only=False)]], axis=1).ravel()
        size = self.lengths[halves]
        return self.ids[ranges(begin[halves], size)], size.reshape(-1, 2).sum(axis=1)


@lru_cache(maxsize=2)
def _ids(path: str) -> SpaceIds | WholeIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
    tokenizer = Tokenizer.from_file(path)
    return SpaceIds(tokenizer) if cuts_before_space(tokenizer) else WholeIds(tokenizer)


def id_type(tokenizer_path: str) -> np.dtype:
    return np.dtype("<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4")


class FileBuilder:
    """One file of sequences, built up document by document."""

    def __init__(self, kind: np.dtype, sequence: int, most: int):
        self.kind, self.sequence, self.room = kind, sequence, sequence * most
        self.ids = np.zeros(self.room, kind)
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, doc_id: int | None, doc: int, ids: np.ndarray) -> np.ndarray:
        """Take as many ids as fit in; what is left is returned."""
        n = min(len(ids), self.room - self.used)
        self.ids[self.used : self.used + n] = ids[:n]
        self.pieces.append((doc_id, doc, self.used, n))
        self.used += n
        return ids[n:]

    @property
    def full(self) -> bool:
        return self.used == self.room

    def file(self, place: int, part: int) -> bytes:
        """The file, as number ``part`` of the range of keys ``place``."""
        rows = -(-self.used // self.sequence)
        ids, mask = pa.array(self.ids[: rows * self.sequence]), pa.array(np.arange(rows * self.sequence) < self.used)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (ids, mask)]
        columns = [pa.array(c, pa.int64()) for c in zip(*self.pieces, strict=True)]
        pieces = to_file(pa.Table.from_arrays(columns, schema=PIECES))
        about = {DOCUMENTS: pieces, PLACE: json.dumps({"range": place, "part": part}).encode()}
        return to_file(pa.Table.from_arrays(lists, names=["ids", "mask"]).replace_schema_metadata(about), BATCH)


def to_file(table: pa.Table, rows: int | None = None) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=rows)
    return out.getvalue().to_pybytes()


class Sequences:
    """Sequences of a file of ids by number; they point into the file's memory."""

    def __init__(self, source: str | pa.Buffer | pa.NativeFile):
        self.file = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else source)
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.rows = self.batches[0].num_rows if self.batches else 1
        place = json.loads(self.file.schema.metadata[PLACE])
        self.range, self.part = place["range"], place["part"]

    def documents(self) -> pa.Table:
        """The pieces of documents in this file: ``doc_id``, the document's number in its range, first id and number of ids."""
        return pa.ipc.open_file(pa.py_buffer(self.file.schema.metadata[DOCUMENTS])).read_all().combine_chunks()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _flat(self, batch: int, name: str) -> tuple[pa.Array, int]:
        column = self.batches[batch].column(name)
        return column.flatten(), column.type.list_size

    def ids(self, number: int) -> np.ndarray:
        flat, size = self._flat(number // self.rows, "ids")
        return flat.to_numpy()[number % self.rows * size :][:size]

    def mask(self, number: int) -> pa.Array:
        flat, size = self._flat(number // self.rows, "mask")
        return flat.slice(number % self.rows * size, size)

    def all_ids(self) -> np.ndarray:
        """All ids one after the other, those that fill up included."""
        parts = [self._flat(i, "ids")[0].to_numpy() for i in range(len(self.batches))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, file_sequences: int = FILE, range_bytes: int = RANGE_BYTES) -> None:
    """Write ``docs`` into the folder ``path``, in files of at most ``file_sequences`` sequences.

    A file's metadata has the number of its range of keys and its own in the
    range, both from 0; Spark's text writer, which takes any bytes, names the
    files ``part-*.txt``.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer_path)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, part, doc, place = FileBuilder(kind, sequence, file_sequences), 0, 0, 0

        def row() -> pa.RecordBatch:
            # the writer ends each row with the bytes that the file ends with
            return pa.RecordBatch.from_arrays([pa.array([builder.file(place, part)[: -len(MAGIC)]], pa.binary())], names=["value"])

        for batch in batches:
            for some in slices(batch, "text", BYTES):
                found, cut = _ids(tokenizer_path).encode(some.column("text"), end_id)
                found = found.astype(kind)
                for doc_id, place, a, b in zip(some.column("doc_id").to_pylist(), some.column("place").to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # noqa: B007
                    ids = found[a:b]
                    while len(ids):
                        ids = builder.add(doc_id, doc, ids)
                        if builder.full:
                            yield row()
                            builder, part = FileBuilder(kind, sequence, file_sequences), part + 1
                    doc += 1
        if builder.used:
            yield row()

    small_batches(spark)
    ordered = rows.repartitionByRange(n_ranges, "doc_id", "doc_row").sortWithinPartitions("doc_id", "doc_row").select("doc_id", "text", F.spark_partition_id().alias("place"))
    # bytes that a string column carries are written as they are
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", MAGIC.decode()).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def crc_combine(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one after the other, from those of each and the ``length`` of the second."""

    def times(matrix: list[int], vector: int) -> int:
        found = 0
        for row in matrix:
            if vector & 1:
                found ^= row
            vector >>= 1
        return found

    # fixed value: the reflected polynomial of CRC-32
    zeros = [0xEDB88320, *(1 << i for i in range(31))]  # what one bit of zero does to a checksum
    for _ in range(3):
        zeros = [times(zeros, r) for r in zeros]
    while length:
        if length & 1:
            first = times(zeros, first)
        zeros = [times(zeros, r) for r in zeros]
        length >>= 1
    return first ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents of the files in ``path``, found in the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = Sequences(pa.py_buffer(content.as_buffer()))
                pieces = file.documents()
                start, length = (pieces.column(c).to_numpy() for c in ("start", "length"))
                raw = memoryview(file.all_ids().astype("<u4").tobytes())
                crc = [crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                place = [pa.array([x] * len(pieces), pa.int32()) for x in (file.range, file.part)]
                yield from pa.Table.from_arrays([*place, *pieces.columns, pa.array(crc, pa.int64())], names=["range", "part", *PIECES.names, "crc"]).to_batches()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pieces in batch.column("pieces").to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc_combine(crc, p["crc"], 4 * p["length"])
                found.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(spark)
    found = spark.read.format("binaryFile").load(path)
    pieces = materialize(found.select("content").mapInArrow(run, "range int, part int, doc_id long, doc long, start long, length long, crc long"), "pieces")
    # ranges are few: their sizes are summed in order, then those of files in each
    sizes = materialize(pieces.groupBy("range", "part").agg(F.sum("length").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last")), "sizes")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_range = sizes.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.orderBy("range")).alias("base"))
    of_file = sizes.select("range", "part", before(Window.partitionBy("range").orderBy("part")).alias("at"))
    bases = materialize(of_file.join(of_range, "range").select(F.col("range").alias("_range"), F.col("part").alias("_part"), (F.col("base") + F.col("at")).alias("base")), "bases")
    based = lookup_join(pieces, bases, (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part")))
    based = based.select("range", "part", "doc_id", "doc", (F.col("start") + F.col("base")).alias("start"), "length", "crc")
    # only documents that lie over the end of a file have several pieces
    ends = lookup_ends(based, sizes)
    whole = ends.where(~F.col("cut")).select("doc_id", "start", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = ends.where("cut").groupBy("range", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "length", "crc"))).alias("pieces"))
    return whole.unionByName(cut.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def lookup_ends(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pieces`` with ``cut``: whether the document goes on in the next file or comes from the one before."""
    w = Window.partitionBy("range").orderBy("part")
    over = sizes.select("range", F.col("last").alias("_doc"), (F.lead("first").over(w) == F.col("last")).alias("goes_on"))
    over = materialize(over.where("goes_on").select(F.col("range").alias("_range"), "_doc").distinct(), "cut-documents")
    joined = lookup_join(pieces, over, (F.col("range") == F.col("_range")) & (F.col("doc") == F.col("_doc")), "left")
    return joined.withColumn("cut", F.col("_doc").isNotNull()).drop("_range", "_doc")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, **sizes: int) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return the documents that are read from them."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer_path, end_id, **sizes)
    return read_documents(docs.sparkSession, path)
