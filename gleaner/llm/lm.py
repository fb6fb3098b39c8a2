"""Scoring of texts by a trigram model with deleted interpolation.

log10 P(text) = sum over tokens w after u, v of log10(l3 c(u, v, w) / c(u, v) + (1 - l3) P2(w after v)),
P2 = l0 / (V + 1) + l1 c(w) / N + l2 c(v, w) / c(v).
The weights of a token are those of the frequency buckets of its contexts: l0
to l2 by c(v), l3 by c(u, v).  Expectation-maximisation learns them on held-out
counts: each training token in turn is deleted from the counts and then
predicted by the rest of them.  A text is its words, A-Z in lower case, and
one end token, which is also the context of the first word; a first word has
no second word before it, so its l3 is 0.  So is that of contexts found once:
without the token itself nothing is left of them to learn from, and nothing is
looked up for them.

How the counts meet the texts: words become 64-bit hashes, pairs and triples
56-bit ones of these; ``V``, ``n_known`` and the counts are those of hashes,
which differ from those of words only where two words share one (for a
vocabulary of ten million with a probability of 3e-6; of a billion pairs one in
seventy million shares its hash).  Documents are kept as chunks of a bounded
size; each chunk sends its distinct keys, once each, to the task that counts
that range of hashes over all chunks, and gets the totals back in the same
order.  A frequent pair is one key a chunk, so no range grows with it, and
what is sent grows with the corpus in proportion: at most a row a key, where
chunks and ranges are so many that each meets in one.  Chunks and their tokens
are tables in buckets of the chunk's number, which are joined in place.

Defined results: a null or empty text is one end token; rows with equal
``doc_id`` are scored one by one; a null ``doc_id`` is empty text for the
fold; with no training rows every word is unknown; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Words, crc_bucket, mix, slices, small_batches
from gleaner.scratch import discard, materialize, scratch_path

#: Bytes of text in a chunk, and keys that one counting task gets.
CHUNK_BYTES = 4 << 20
RANGE_KEYS = 1_200_000
FOLDS = 10
END = np.uint64(0x5DEECE66D1234567)
#: Steps of the decimal logarithm in the histogram that the weights are learned from, and its last bin.
STEPS, LAST = 20, 300
ROUNDS = 200
UNIGRAM, BIGRAM, TRIGRAM = 1, 2, 3
#: Bits of the hashes of each kind.
BITS = {UNIGRAM: 64, BIGRAM: 56, TRIGRAM: 56}


def put(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, their low bytes first."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def get(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def chunks(docs: DataFrame) -> DataFrame:
    """``chunk, n_docs, n_tokens, n_words, doc_ids, train, counts, codes, words``: a row holds the tokens of many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words = Words(t.column("text"), lower=True)
            hashes = np.r_[words.hashes(), END]
            counts = (words.counts + 1).astype(np.int32)
            ends = np.cumsum(counts) - 1
            codes = np.full(int(counts.sum()), len(hashes) - 1, np.int32)
            codes[np.delete(np.arange(len(codes)), ends)] = words.codes
            cells = [[len(t)], [len(codes)], [len(hashes)], [t.column("doc_id").cast(pa.int64()).to_pylist()], [t.column("train").to_pylist()], [put(counts)], [put(codes)], [put(hashes)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["n_docs", "n_tokens", "n_words", "doc_ids", "train", "counts", "codes", "words"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(part)
                size += part.column("text").nbytes
                if size >= CHUNK_BYTES:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    schema = "n_docs long, n_tokens long, n_words long, doc_ids array<long>, train array<boolean>, counts binary, codes binary, words binary"
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id())


def joint(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """56-bit hashes of pairs of hashes."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(8)


def context_of(of_pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token the count of the two before it: that of the pair that ends before it; 0 for the ``first`` of a document."""
    out = np.r_[0, of_pair[:-1]]
    out[first] = 0
    return out


class Chunk:
    """A row of ``chunks`` with its distinct words and pairs in the order of their hashes."""

    def __init__(self, row):
        self.doc_ids, self.train = row.doc_ids, np.array(row.train, bool)
        self.counts = get(row.counts, np.int32, row.n_docs)
        codes, words = get(row.codes, np.int32, row.n_tokens), get(row.words, np.uint64, row.n_words)
        before = np.r_[np.int32(len(words) - 1), codes[:-1]]  # what ends a document stands before the next one
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.word, self.context = rank[codes], rank[before]
        self.words = words[order]
        hashed = joint(words[before], words[codes])
        self.pairs, self.pair = np.unique(hashed, return_inverse=True)
        self.first = np.r_[0, np.cumsum(self.counts)[:-1]]
        self.triple = joint(np.r_[np.uint64(0), hashed[:-1]], words[codes])  # of a document's first token it is never used

    def triples(self, of_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens have a context of two words found twice or more and a pair found at all, their distinct triples, and the place of each one's."""
        context = context_of(of_pair, self.first)
        use = (context > 1) & (of_pair > 0)
        keys, place = np.unique(self.triple[use], return_inverse=True)
        return use, keys, place

    def tokens_train(self) -> np.ndarray:
        return np.repeat(self.train, self.counts)

    def keys(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        train = self.tokens_train().astype(np.float64)
        return [
            (UNIGRAM, self.words, np.bincount(self.word, train, len(self.words)).astype(np.uint32)),
            (BIGRAM, self.pairs, np.bincount(self.pair, train, len(self.pairs)).astype(np.uint32)),
        ]


def cuts(keys: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of hashes begins among sorted keys."""
    bounds = np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(keys, bounds), len(keys)].astype(np.int64)


def frames(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pd.DataFrame:
    """A row for each range of hashes that has keys of the chunk."""
    cut = cuts(keys, ranges, BITS[kind])
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pd.DataFrame({"chunk": chunk, "kind": kind, "part": [i for i, _, _ in spans], "n": [b - a for _, a, b in spans], "keys": [put(keys[a:b]) for _, a, b in spans], "counts": [put(counts[a:b]) for _, a, b in spans]})


FRAME = "chunk long, kind int, part int, n long, keys binary, counts binary"


def send_pairs(parts: DataFrame, ranges: int) -> DataFrame:
    """The words and pairs of each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                for kind, keys, counts in Chunk(row).keys():
                    yield frames(row.chunk, kind, keys, counts, ranges)

    return parts.mapInPandas(run, FRAME)


def send_triples(rows: DataFrame, ranges: int) -> DataFrame:
    """The triples of each chunk whose context is found twice or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                c = Chunk(row)
                use, keys, place = c.triples(get(row.of_pair, np.int64, row.n_tokens))
                counts = np.bincount(place, c.tokens_train()[use].astype(np.float64), len(keys)).astype(np.uint32)
                if len(keys):
                    yield frames(row.chunk, TRIGRAM, keys, counts, ranges)

    return rows.mapInPandas(run, FRAME)


def totals(sent: DataFrame) -> DataFrame:
    """``chunk, kind, part, n, totals``: training counts over all chunks of each chunk's keys; rows of chunk -1 have ``n`` distinct training keys and their sum ``total``."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        keys = np.concatenate([get(k, np.uint64, n) for k, n in zip(pdf["keys"], pdf["n"], strict=True)])
        counts = np.concatenate([get(c, np.uint32, n) for c, n in zip(pdf["counts"], pdf["n"], strict=True)])
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
        sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first))
        of_key = np.empty(len(keys), np.int64)
        of_key[order] = sums[np.cumsum(first) - 1]
        ends = np.cumsum(pdf["n"].to_numpy())
        back = [put(x) for x in np.split(of_key, ends[:-1])]
        kind, part = int(pdf["kind"].iloc[0]), int(pdf["part"].iloc[0])
        head = pd.DataFrame({"chunk": [-1], "kind": kind, "part": part, "n": int((sums > 0).sum()), "total": int(sums.sum()), "totals": [b""]})
        return pd.concat([head, pd.DataFrame({"chunk": pdf["chunk"], "kind": kind, "part": part, "n": pdf["n"], "total": 0, "totals": back})])

    return sent.groupBy("kind", "part").applyInPandas(total, "chunk long, kind int, part int, n long, total long, totals binary")


def counted(parts: DataFrame, replies: DataFrame) -> DataFrame:
    """``chunk, of_word, of_pair, ends``: the training counts of each token and of the pair that ends in it, and of the end token."""

    def join(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = next(pdf.itertuples())
        c = Chunk(row)
        got = {k: np.concatenate([get(t, np.int64, n) for t, n in zip(g["totals"], g["n"], strict=True)]) for k, g in back.sort_values("part").groupby("kind")}
        word, pair = got[UNIGRAM], got[BIGRAM][c.pair]
        return pd.DataFrame({"chunk": [row.chunk], "of_word": [put(word[c.word])], "of_pair": [put(pair)], "ends": int(word[c.context[0]])})

    return parts.groupBy("chunk").cogroup(replies.where("chunk >= 0").groupBy("chunk")).applyInPandas(join, "chunk long, of_word binary, of_pair binary, ends long")


def in_buckets(table: DataFrame, tag: str, buckets: int) -> DataFrame:
    """``table`` written in buckets by ``chunk``, so that joins by it need no shuffle; ``forget`` takes it out of the catalogue again."""
    spark = table.sparkSession
    path = scratch_path(spark, tag)
    name = f"{tag}_{path.rpartition('-')[2]}".replace("-", "_")
    table.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", path).saveAsTable(name)
    written = spark.table(name)
    written._scratch, written._name = path, name
    return written


def forget(table: DataFrame) -> None:
    """Remove a table of ``in_buckets`` that no later step reads."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._name}")
    discard(table)


def bucket(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 for unseen, else 1 and the binary logarithm's floor."""
    return np.frexp(context.astype(np.float64))[1]


def _bins(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-STEPS * np.log10(p)), LAST - 1), LAST).astype(np.int64)


class Counts:
    """The counts of a chunk's tokens: ``word``, ``context``, ``pair``, ``context2`` (of the two words before), and which token is of a training text."""

    def __init__(self, row):
        self.counts = get(row.counts, np.int32, row.n_docs)
        self.first = np.r_[0, np.cumsum(self.counts)[:-1]].astype(np.int64)
        self.train = np.repeat(np.array(row.train, bool), self.counts)
        self.word, self.pair = get(row.of_word, np.int64, row.n_tokens), get(row.of_pair, np.int64, row.n_tokens)
        self.context = np.r_[row.ends, self.word[:-1]]  # a first token's is the end token before it
        self.context2 = context_of(self.pair, self.first)


def mixed(weights: np.ndarray, word: np.ndarray, context: np.ndarray, pair: np.ndarray, n_train: int, vocabulary: int) -> np.ndarray:
    """P2 of tokens of these counts."""
    w = weights[bucket(context)]
    return w[:, 0] / (vocabulary + 1) + w[:, 1] * word / max(1, n_train) + w[:, 2] * pair / np.maximum(context, 1)


def deleted_histogram(rows: DataFrame, n_train: int) -> DataFrame:
    """``bucket, one, two, n``: training tokens by their context's bucket and by the bins of their two estimates without them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                c = Counts(row)
                word, context, pair = (x[c.train] - 1 for x in (c.word, c.context, c.pair))
                one = _bins(word / max(1, n_train - 1))
                two = _bins(np.where(context > 0, pair / np.maximum(context, 1), 0.0))
                key, n = np.unique((bucket(context) * (LAST + 1) + one) * (LAST + 1) + two, return_counts=True)
                yield pd.DataFrame({"bucket": key // (LAST + 1) ** 2, "one": key // (LAST + 1) % (LAST + 1), "two": key % (LAST + 1), "n": n})

    return rows.mapInPandas(run, "bucket int, one int, two int, n long").groupBy("bucket", "one", "two").agg(F.sum("n").alias("n"))


def with_triples(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks' tokens with the count of the triple that ends in each (0 where none was looked up)."""

    def join(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = next(pdf.itertuples())
        use, keys, place = Chunk(row).triples(get(row.of_pair, np.int64, row.n_tokens))
        triple = np.zeros(row.n_tokens, np.int64)
        if len(keys):
            back = back.sort_values("part")
            triple[use] = np.concatenate([get(t, np.int64, n) for t, n in zip(back["totals"], back["n"], strict=True)])[place]
        return pd.DataFrame({"n_docs": [row.n_docs], "n_tokens": row.n_tokens, "doc_ids": [row.doc_ids], "train": [row.train], "counts": [row.counts], "of_word": [row.of_word], "of_pair": [row.of_pair], "ends": row.ends, "of_triple": [put(triple)]})

    schema = "n_docs long, n_tokens long, doc_ids array<long>, train array<boolean>, counts binary, of_word binary, of_pair binary, ends long, of_triple binary"
    return rows.groupBy("chunk").cogroup(replies.where("chunk >= 0").groupBy("chunk")).applyInPandas(join, schema)


def deleted_triples(rows: DataFrame, weights: np.ndarray, n_train: int, vocabulary: int) -> DataFrame:
    """``bucket, one, two, n``: training tokens by the bucket of the two words before them and by the bins of P2 and of the triple's estimate, both without them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                c = Counts(row)
                at = c.train & (c.context2 > 1)
                triple = get(row.of_triple, np.int64, row.n_tokens)[at] - 1
                one = _bins(mixed(weights, c.word[at] - 1, c.context[at] - 1, c.pair[at] - 1, n_train - 1, vocabulary))
                two = _bins(triple / (c.context2[at] - 1))
                key, n = np.unique((bucket(c.context2[at]) * (LAST + 1) + one) * (LAST + 1) + two, return_counts=True)
                yield pd.DataFrame({"bucket": key // (LAST + 1) ** 2, "one": key // (LAST + 1) % (LAST + 1), "two": key % (LAST + 1), "n": n})

    return rows.mapInPandas(run, "bucket int, one int, two int, n long").groupBy("bucket", "one", "two").agg(F.sum("n").alias("n"))


def learn_triple_weights(hist: pd.DataFrame) -> np.ndarray:
    """The weight of the triple's estimate for contexts of each bucket; 0 for those found less than twice."""
    weights = np.zeros(65)

    def em(cells: pd.DataFrame) -> float:
        one, two = (np.where(cells[c] < LAST, 10.0 ** (-cells[c] / STEPS), 0.0) for c in ("one", "two"))
        n, w = cells["n"].to_numpy(np.float64), 0.5
        for _ in range(ROUNDS):
            w = float((n * w * two / np.maximum(w * two + (1 - w) * one, 1e-300)).sum() / n.sum())
        return min(w, 1 - 1e-9)

    if len(hist):
        weights[2:] = em(hist)
    for b, cells in hist.groupby("bucket"):
        weights[b] = em(cells)
    return weights


def learn_weights(hist: pd.DataFrame, vocabulary: int) -> np.ndarray:
    """Row b: the weights of the uniform, the unigram and the bigram estimate for contexts of bucket b."""
    weights = np.tile(np.array([0.1, 0.9, 0.0]), (65, 1))
    weights[1:] = [0.1, 0.5, 0.4]

    def em(cells: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        p = np.stack([np.full(len(cells), 1 / (vocabulary + 1)), *(np.where(cells[c] < LAST, 10.0 ** (-cells[c] / STEPS), 0.0) for c in ("one", "two"))], 1)
        n, w = cells["n"].to_numpy(np.float64), start
        for _ in range(ROUNDS):
            share = p * w
            w = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
        return np.maximum(w, [1e-9, 0, 0]) / np.maximum(w, [1e-9, 0, 0]).sum()

    if len(hist):
        everywhere = em(hist, np.array([0.1, 0.5, 0.4]))
        weights[1:] = everywhere
        weights[0] = np.r_[everywhere[:2] / everywhere[:2].sum(), 0.0]
    for b, cells in hist.groupby("bucket"):
        if b:  # a context seen once is alone in bucket 1; without itself it tells nothing
            weights[b] = em(cells, everywhere)
        else:
            weights[0] = em(cells, weights[0])
    return weights


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = in_buckets(chunks(docs.select("doc_id", "text", (crc_bucket("doc_id", folds) != 0).alias("train"))), "lm_chunks", buckets)
    tokens = parts.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(1, -(-tokens // RANGE_KEYS))
    replies = materialize(totals(send_pairs(parts, ranges)), "lm-counts")
    known = replies.where(f"chunk = -1 AND kind = {UNIGRAM}").agg(F.sum("n"), F.sum("total")).first()
    vocabulary, n_train = int(known[0] or 0), int(known[1] or 0)
    counts = in_buckets(counted(parts, replies), "lm_tokens", buckets)
    rows = parts.join(counts.hint("merge"), "chunk")
    discard(replies)
    weights = learn_weights(deleted_histogram(rows, n_train).toPandas(), vocabulary)  # at most 65 * 301 * 301 bins
    triples = materialize(totals(send_triples(rows, ranges)), "lm-triples")
    rows = materialize(with_triples(rows, triples), "lm-rows")
    for table in (parts, counts):
        forget(table)
    of_triples = learn_triple_weights(deleted_triples(rows, weights, n_train, vocabulary).toPandas())  # at most 65 * 301 * 301 bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                c = Counts(row)
                l3, triple = of_triples[bucket(c.context2)], get(row.of_triple, np.int64, row.n_tokens)
                p = l3 * triple / np.maximum(c.context2, 1) + (1 - l3) * mixed(weights, c.word, c.context, c.pair, n_train, vocabulary)
                base = np.log10((c.word + 0.1) / (n_train + 0.1 * (vocabulary + 1)))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(row.doc_ids, "Int64"), "held_out": ~np.array(row.train, bool), "n_tokens": c.counts.astype(np.int64), "n_known": np.add.reduceat((c.word > 0).astype(np.int64), c.first),
                        "train_tokens": n_train, "base_score": np.add.reduceat(base, c.first), "score": np.add.reduceat(np.log10(p), c.first),
                    }
                )

    return rows.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
