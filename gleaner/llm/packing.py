"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; what remains of each is
placed, longest first, into the open window that it fills best, found in a
segment tree over remaining capacities.  Pieces are dealt at random over
shards of a bounded number of pieces and each shard is packed by one task, so
no task grows with the corpus; at tens of thousands of pieces a shard the
padding that the division costs is a few windows a shard.

Defined results: a null or empty text is one token, the end id; a document
row that occurs twice is packed twice; a null ``doc_id`` stays null; an empty
table gives no pieces; other columns are ignored.  Each row of the input has a
number of its own, ``doc_row``, so that copies of a document can be told apart.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import crc32, slices, small_batches
from gleaner.scratch import materialize

WINDOW = 4096
END_ID = 2
#: Pieces that one task packs.
SHARD_PIECES = 50_000
#: Words whose ids a worker remembers, and bytes of text that it encodes at a time.
MEMORY, BYTES = 1_000_000, 6 << 20

# fixed values: how a tokenizer must cut texts for ``WordIds`` to apply to it
LOWERED = ["NFC", "Replace", "Lowercase"]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_row long"


def cuts_at_space(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer lowers letters and then cuts texts by the pattern ``CUT``, in which nothing reaches across white space."""
    form = json.loads(tokenizer.to_str())
    steps = (form["normalizer"] or {}).get("normalizers", [])
    parts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
    lowers = [s["type"] for s in steps] == LOWERED and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
    cuts = [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": CUT} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    return lowers and cuts and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or " " in a["content"] for a in form["added_tokens"])


class WholeIds:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and where each text's ids begin."""
        found = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        cut = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(cut[-1])), cut


class WordIds:
    """Ids of texts by the ids of their white-space separated parts.

    The pre-tokeniser never joins across ASCII white space, so a text's ids are
    those of its parts in order; each distinct part is encoded once and
    remembered, in flat arrays that stay small beside the texts.
    """

    def __init__(self, tokenizer: Tokenizer, memory: int = MEMORY):
        self.tokenizer, self.memory = tokenizer, memory
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.marks = [self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"]

    def _keep(self, parts: pa.Array, lengths: np.ndarray, ids: np.ndarray, uses: np.ndarray) -> None:
        self.parts, self.lengths, self.ids, self.uses = parts, lengths, ids, uses

    def _forget(self) -> None:
        """Keep the more used half of the parts."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.memory // 2])
        mask = np.zeros(len(self.parts), bool)
        mask[keep] = True
        self._keep(self.parts.take(pa.array(keep)), self.lengths[keep], self.ids[np.repeat(mask, self.lengths)], np.zeros(len(keep), np.int64))

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of distinct parts are; unknown ones are encoded and added."""
        if len(self.parts) > self.memory:
            self._forget()
        at = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(at.is_null())
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.uses[place[place >= 0]] += 1
        if len(new):
            place[place < 0] = len(self.parts) + np.arange(len(new))
            lengths, ids = [], []
            for a in range(0, len(new), 4096):
                found = [e.ids for e in self.tokenizer.encode_batch_fast(new[a : a + 4096].to_pylist(), add_special_tokens=False)]
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
            lengths, flat = np.concatenate(lengths), np.concatenate(ids)
            self._keep(pa.concat_arrays([self.parts, new]), np.r_[self.lengths, lengths], np.r_[self.ids, flat], np.r_[self.uses, np.ones(len(new), np.int64)])
        return place

    def of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts one after the other, and the length of each one's.

        The normaliser lowers letters and the pre-tokeniser cuts a full stop or
        comma off, so a part of ASCII letters shares the ids of its lower-case form.
        """
        plain = pc.match_substring_regex(parts, "^[A-Za-z]+[.,]?$")
        marked = pc.and_(plain, pc.match_substring_regex(parts, "[.,]$"))
        stem = pc.if_else(plain, pc.ascii_lower(pc.ascii_rtrim(parts, ".,")), parts).dictionary_encode()
        place = self.places(stem.dictionary)[stem.indices.to_numpy(zero_copy_only=False)]
        mark = marked.to_numpy(zero_copy_only=False)
        first = np.r_[0, np.cumsum(self.lengths)]
        size = self.lengths[place]
        lengths = size + mark
        run = np.cumsum(lengths)
        flat = np.empty(int(run[-1]) if len(run) else 0, np.uint32)
        ends = np.zeros(len(flat), bool)
        ends[run[mark] - 1] = True
        flat[~ends] = self.ids[ranges(first[place], size)]
        flat[ends] = np.where(pc.ends_with(parts.filter(marked), ".").to_numpy(zero_copy_only=False), *self.marks)
        return flat, lengths

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and where each text's ids begin."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids, lengths = self.of_parts(coded.dictionary)
        ids, lengths = np.r_[ids, np.uint32(end_id)], np.r_[lengths, 1]
        ends_at = np.cumsum(sizes + 1) - 1
        codes = np.full(int((sizes + 1).sum()), len(lengths) - 1, np.int32)
        real = np.ones(len(codes), bool)
        real[ends_at] = False
        codes[real] = coded.indices.to_numpy(zero_copy_only=False)
        size = lengths[codes]
        run = np.r_[0, np.cumsum(size)]
        return ids[ranges((np.cumsum(lengths) - lengths)[codes], size)], np.r_[0, run[ends_at + 1]]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] ... starts[i] + sizes[i] - 1`` of all i, one after the other."""
    run = np.cumsum(sizes)
    return np.arange(run[-1] if len(run) else 0) + np.repeat(starts - (run - sizes), sizes)


@lru_cache(maxsize=2)
def _ids(path: str) -> WordIds | WholeIds:
    tokenizer = Tokenizer.from_file(path)
    return WordIds(tokenizer) if cuts_at_space(tokenizer) else WholeIds(tokenizer)


def document_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``window`` ids: ``doc_id, start, length, ids_crc32, doc_tokens, doc_row``, and ``ids`` if asked for."""
    schema = PIECE + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_row", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BYTES):
                ids, cut = _ids(tokenizer_path).encode(part.column("text"), end_id)
                total = np.diff(cut)
                n = -(-total // window)
                row = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, total[row] - start)
                begin = cut[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                out = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row]), part.column("doc_row").take(pa.array(row))]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(ids)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("doc_row")).mapInArrow(run, schema)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.at: dict[int, list[int]] = defaultdict(list)

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the window of least capacity that holds ``need``: its capacity and number."""
        node = self.base + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.base
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset in it of each length (1 to ``window``)."""
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == window).sum())
    number[order[:full]], offset[order[:full]] = np.arange(full), 0
    opened, tree = full, OpenWindows(window)
    for i, need in zip(order[full:].tolist(), lengths[order[full:]].tolist(), strict=True):
        if found := tree.tightest(need):
            room, at = found
        else:
            room, at, opened = window, opened, opened + 1
        number[i], offset[i] = at, window - room
        if room > need:
            tree.put(room - need, at)
    return number, offset


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)``: the pieces of ``document_pieces`` with their ``sequence_id`` and ``offset``."""
    pieces = materialize(document_pieces(docs, tokenizer_path, window, end_id, with_ids).withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_uid", kind="stable")  # a task that is run again gives the same windows
        number, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pd.DataFrame({"_uid": pdf["_uid"], "sequence_id": pdf["_shard"].to_numpy().astype(np.int64) * (1 << 32) + number, "offset": offset})

    keyed = pieces.withColumn("_shard", F.pmod(F.xxhash64("_uid"), F.lit(shards)).cast("int"))
    if with_ids:  # only lengths are placed; the ids stay where they are until the join
        placed = keyed.select("_uid", "_shard", "length").groupBy("_shard").applyInPandas(place, "_uid long, sequence_id long, offset long")
        return pieces.join(placed, "_uid").drop("_uid").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_row", "ids")

    def place_all(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.merge(place(pdf), on="_uid").drop(columns=["_uid", "_shard"]).astype({"doc_id": "Int64"})

    return keyed.groupBy("_shard").applyInPandas(place_all, PIECE + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Training rows of ``pack(..., with_ids=True)``: the tokens of each sequence in order and the length of each of its pieces."""
    piece = F.struct("offset", "doc_id", "doc_row", "start", "ids")
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(piece)).alias("p"))
        .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.doc_row").alias("doc_rows"), F.col("p.start").alias("starts"), F.transform("p.ids", F.size).alias("lengths"))
    )
