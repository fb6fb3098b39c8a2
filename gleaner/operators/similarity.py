"""Joins of short texts by their Ratcliff-Obershelp ratio, without comparing all pairs.

The ratio of two texts is 2 * M / (m + n): M characters lie in blocks that
both have in one order, so M is at most the number of characters that they have
in common, at most a third of one more than their lengths and their common runs
of two, and at most the length of their longest common subsequence.  All are
upper bounds of the ratio that no pair is lost by.  The first is a product of
matrices; the second is counted in bits, where the first holds; the third, where
both hold, in words of 64 bits, one step a character, for as long as enough
characters are left.  Only what all allow for is compared exactly.

Texts are cut into chunks by their lengths, and each pair of chunks whose
lengths allow for the ratio is a block of its own; where questions are held
against answers, a block has a chunk of each.  Many texts are first sorted into
kinds by their letters, so that chunks are of one language, more or less: on
kinds depends how fast a block is, not what it finds.  A pair of texts is met in
one block only, and no task holds more than two chunks.  Texts of a small
alphabet share all their runs of two and three characters, so no index of such
runs is selective below a ratio of about 0.9: the blocks grow with the square of
the distinct texts, at some 10 nanoseconds a pair of different languages and 20
to 60 of one for a ratio of 0.72.

Texts are titles and the like, of up to some hundred characters.  Null and
empty texts are like nothing; equal texts are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import similarity
from gleaner.scratch import materialize

#: Texts of a chunk at most, and chunks at least of many texts; texts that are held against a chunk at a time, pairs of them.
CHUNK, CHUNKS, SLICE, PAIRS = 8192, 8, 256, 1 << 15
#: Groups of characters, and how many of each are counted; the same of frequent runs of two; groups of rare ones.
GROUPS, DEEP, RUN_GROUPS, RUN_DEEP, RARE_GROUPS = 64, 8, 128, 4, 256
#: Characters after which it is asked whether a pair can still be alike; tasks at most that blocks are dealt over.
STEPS, TASKS = 16, 2000
#: Kinds that groups of questions and answers are hashed to at most; texts that kinds by letters are made from, and rounds of it.
KINDS, SAMPLE, ROUNDS = 1024, 4096, 10
#: Characters of texts and of alphabets up to which a text is held against a chunk by parts of the alphabet; pairs a text must have for that to be faster; texts for which that is done at a time.
LONGEST, ALPHABET, OFTEN, LOWS = 255, 256, 64, 8192
#: Characters of a part for words of 16 and 32 bits; the share of pairs of 16 from which on 32 are faster.
FILL, MANY = {16: 16, 32: 24}, 0.04


class Texts:
    """Texts by length, as codes one after another, with the counts of their characters."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows.iloc[np.argsort(rows["text"].str.len().to_numpy(), kind="stable")].reset_index(drop=True)
        self.n = self.rows["text"].str.len().to_numpy().astype(np.int64)
        self.codes = np.frombuffer("".join(self.rows["text"]).encode("utf-32-le"), np.uint32).astype(np.intp)
        self.start = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.counted, self.over = unary(len(self.n), self.row, self.codes % GROUPS, GROUPS, DEEP)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The text and the code of each run of two characters."""
        within = self.row[1:] == self.row[:-1]
        return self.row[1:][within], (self.codes[:-1] << 21 | self.codes[1:])[within]


def unary(n: int, row: np.ndarray, group: np.ndarray, groups: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` texts the counts of groups as so many ones, up to ``deep``, and how many there are beyond."""
    counts = np.bincount(row * groups + group, minlength=n * groups).reshape(-1, groups)
    return (np.arange(deep) < counts[:, :, None]).reshape(n, -1), (counts - np.minimum(counts, deep)).sum(axis=1)


def counted_runs(low: Texts, high: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both the counts of runs of two characters in bits, and what is beyond; frequent runs have groups of their own, rare ones share some."""
    runs = [low.runs(), high.runs()]
    known, place, count = np.unique(np.concatenate([code for _, code in runs]), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(known))
    out = []
    for texts, (row, _), group in zip((low, high), runs, np.split(rank[place], [len(runs[0][1])]), strict=True):
        often = group < RUN_GROUPS
        frequent, over = unary(len(texts.n), row[often], group[often], RUN_GROUPS, RUN_DEEP)
        rare, more = unary(len(texts.n), row[~often], group[~often] % RARE_GROUPS, RARE_GROUPS, 1)
        out.append((np.packbits(np.column_stack([frequent, rare]), axis=1).view(np.uint64), over + more))
    return out


def sharing_characters(low: Texts, high: Texts, least: float) -> Callable[[slice], tuple[np.ndarray, np.ndarray]]:
    """For a slice of ``high`` the pairs that have enough characters in common, or a few more: places in ``low``, places in ``high``; of one chunk (the same ``Texts``) each pair once.

    Counts in unary have their sum of minima as a product, so a slice is one
    product of matrices.
    """
    used = low.counted.any(axis=0) & high.counted.any(axis=0)
    ours = np.column_stack([low.counted[:, used], low.over - low.n * least / 2]).astype(np.float32)
    theirs = np.column_stack([high.counted[:, used], np.ones(len(high.n))]).astype(np.float32)
    enough = (high.n * least / 2 - 0.01 - 1e-6 * (low.n[-1] + high.n[-1])).astype(np.float32)
    first = np.searchsorted(low.n, np.ceil(np.round(high.n * least / (2 - least), 9)), side="left")

    def of_slice(rows: slice) -> tuple[np.ndarray, np.ndarray]:
        of = slice(first[rows.start], rows.stop if low is high else len(low.n))
        shared = theirs[rows] @ ours[of].T
        y, x = np.divmod(np.flatnonzero(shared >= enough[rows, None]), max(shared.shape[1], 1))
        spare, x, y = shared[y, x] - enough[y + rows.start], x + of.start, y + rows.start
        own = (x >= first[y]) & (spare >= low.over[x] - np.minimum(low.over[x], high.over[y]))  # what is beyond in one text only isn't shared
        own &= (x < y) | (low is not high)
        return x[own], y[own]

    return of_slice


def shared_runs(ours: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many runs of two characters each pair has in common, or more."""
    got = np.minimum(ours[1][x], theirs[1][y])
    for word in range(ours[0].shape[1]):
        got += np.bitwise_count(ours[0][x, word] & theirs[0][y, word])
    return got


def character_masks(codes: np.ndarray, texts: Texts, rows: slice, size: int) -> list[np.ndarray]:
    """For each 64 characters of the texts of ``rows`` the places of each of the alphabet's ``size`` characters in them, as bits: ``text * size + character``."""
    n, start = texts.n[rows], texts.start[rows]
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key, masks = row * size + codes[np.repeat(start, n) + place], []
    for word in range(-(-int(n.max()) // 64)):
        mine = place // 64 == word
        masks.append(np.zeros(len(n) * size, np.uint64))
        np.bitwise_or.at(masks[-1], key[mine], np.uint64(1) << (place[mine] % 64).astype(np.uint64))
    return masks


def common_subsequences(codes: np.ndarray, texts: Texts, left: np.ndarray, masks: list[np.ndarray], base: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of pairs: texts ``left``, ascending, and those whose masks begin at ``base``; a pair that can't come to ``need`` any more is left early, with less."""
    state = [np.full(len(left), ~np.uint64(0)) for _ in masks]
    start, n, at_pair, out = texts.start[left], texts.n[left], np.arange(len(left)), np.zeros(len(left), np.int64)
    length = lambda: sum(np.bitwise_count(~held).astype(np.int64) for held in state)
    for j in range(n[-1]):
        if j % STEPS == 0 and j:
            got = length()
            can = got + np.maximum(n - j, 0) >= need
            out[at_pair[~can]] = got[~can]
            state, (start, n, at_pair, base, need) = [held[can] for held in state], (x[can] for x in (start, n, at_pair, base, need))
        live = np.searchsorted(n, j, side="right")
        if live == len(n):
            break
        at, carry = codes[start[live:] + j] + base[live:], None
        for mask, held in zip(masks, state, strict=True):
            v = held[live:]
            u = v & mask[at]
            total = v + u
            if len(masks) > 1:
                out_of = total < u
                if carry is not None:
                    total += carry
                    out_of |= total < carry
                carry = out_of.astype(np.uint64)
            held[live:] = total | (v - u)
    out[at_pair] = length()
    return out


def in_words(high: Texts, codes: tuple[np.ndarray, np.ndarray], size: int, word: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The part of each of the alphabet's ``size`` characters, parts being about as frequent; the places of each character within its part of the texts of ``high``, as bits of a word; and for each part how many characters are beyond the word."""
    bits = np.iinfo(word).bits
    count = -(-int(high.n[len(high.n) * 19 // 20]) // FILL[bits])  # a few longer texts don't make more parts, which are a looser bound
    many, load, part = np.bincount(np.concatenate(codes), minlength=size), np.zeros(count, np.int64), np.zeros(size, np.int64)
    for letter in np.argsort(-many, kind="stable"):
        part[letter] = load.argmin()
        load[part[letter]] += many[letter]
    masks, beyond = np.zeros((size, len(high.n)), word), []
    for p in range(count):
        mine = part[codes[1]] == p
        row, letter = high.row[mine], codes[1][mine]
        own = np.bincount(row, minlength=len(high.n))
        place = np.arange(len(row)) - (np.cumsum(own) - own)[row]
        fits = place < bits
        np.bitwise_or.at(masks, (letter[fits], row[fits]), word(1) << place[fits].astype(word))
        beyond.append(np.maximum(own - bits, 0).astype(np.uint8))
    return part, masks, beyond


def common_of_part(low: list[bytes], masks: list[np.ndarray], beyond: np.ndarray, common: np.ndarray) -> None:
    """Add to a row of ``common`` for each text of ``low`` the lengths of its longest common subsequences with all texts of ``masks``, of one part of the alphabet. Texts go in order, so that what they begin with alike is stepped through once."""
    word = masks[0].dtype
    state = [np.full(len(beyond), np.iinfo(word).max, word)] + [np.empty(len(beyond), word) for _ in range(max(map(len, low)))]
    both, got, last = np.empty(len(beyond), word), np.empty(len(beyond), np.uint8), None
    for i in sorted(range(len(low)), key=low.__getitem__):
        text = low[i]
        if text != last:
            depth = next((d for d, (x, y) in enumerate(zip(text, last or b"", strict=False)) if x != y), min(len(text), len(last or b"")))
            for letter in text[depth:]:
                held, then = state[depth], state[depth + 1]
                np.bitwise_and(held, masks[letter], both)
                np.add(held, both, then)
                np.subtract(held, both, both)
                np.bitwise_or(then, both, then)
                depth += 1
            np.bitwise_count(np.invert(state[depth], both), got)
            got += beyond
            last = text
        common[i] += got


def common_in_parts(low: Texts, at: np.ndarray, low_codes: np.ndarray, words: tuple[np.ndarray, np.ndarray, list[np.ndarray]], since: int) -> np.ndarray:
    """For the texts of ``low`` at places ``at`` and those in ``words`` from ``since`` the sums of their longest common subsequences of the characters of each part."""
    part, masks, beyond = words
    common, n = np.zeros((len(at), masks.shape[1] - since), np.uint8), low.n[at]
    row = np.repeat(np.arange(len(at)), n)
    letters = low_codes[np.repeat(low.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    asked = masks.any(axis=1)[letters]
    for p, over in enumerate(beyond):
        mine = (part[letters] == p) & asked
        joined, ends = letters[mine].astype(np.uint8).tobytes(), np.cumsum(np.bincount(row[mine], minlength=len(at))).tolist()
        common_of_part([joined[x:y] for x, y in zip([0, *ends], ends, strict=False)], [mask[since:] for mask in masks], over[since:], common)
    return common


def sharing_parts(low: Texts, high: Texts, codes: tuple[np.ndarray, np.ndarray], size: int, needed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``low`` and in ``high`` of the pairs whose longest common subsequences of the characters of each part of the alphabet are long enough together; of one chunk each pair once.

    A part of a text of ``high`` is a word of 16 bits or, where too many pairs
    share enough in these, one of 32, and what is beyond counts as common; one
    text of ``low`` is held against all of ``high`` at a time.
    """
    words = in_words(high, codes, size, np.uint16)
    some = np.arange(0, len(low.n), -(-len(low.n) // 64))
    if (common_in_parts(low, some, codes[0], words, 0) >= needed[low.n[some, None] + high.n]).mean() > MANY:
        words = in_words(high, codes, size, np.uint32)
    step = LOWS // 2 if low is high else LOWS
    for begin in range(0, len(low.n), step):
        at, since = np.arange(begin, min(begin + step, len(low.n))), begin if low is high else 0
        found, held, n = [], 0, None
        for i, got in zip(at, common_in_parts(low, at, codes[0], words, since), strict=True):
            if low.n[i] != n:
                n = low.n[i]
                need = needed[n + high.n[since:]].astype(np.uint8)
            y = np.flatnonzero(got >= need) + since
            found.append((i, y[y > i] if low is high else y))
            held += len(found[-1][1])
            if held >= PAIRS or i == at[-1]:
                yield np.repeat([x for x, _ in found], [len(y) for _, y in found]), np.concatenate([y for _, y in found])
                found, held = [], 0


def sharing_runs(low: Texts, high: Texts, sharing: Callable[[slice], tuple[np.ndarray, np.ndarray]], needed: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For slices of ``high`` the pairs that have enough characters and runs of two in common, or a few more."""
    counted = None
    for begin in range(0, len(high.n), SLICE):
        rows = slice(begin, min(begin + SLICE, len(high.n)))
        a, b = sharing(rows)
        # M characters in blocks between which at least one character of one text isn't in any: M less the blocks are runs of two
        both = low.n[a] + high.n[b]
        runs = 3 * needed[both] - both - 1
        asked = np.flatnonzero(runs * 6 > both)  # fewer are shared by nearly all
        if len(asked):
            counted = counted or counted_runs(low, high)
            lost = asked[shared_runs(*counted, a[asked], b[asked]) < runs[asked]]
            a, b = np.delete(a, lost), np.delete(b, lost)
        yield rows, a, b


def shared_often(low: Texts, high: Texts, sharing: Callable[[slice], tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether texts have so many pairs with enough characters in common that it is faster to hold each against the whole chunk, by those of a slice."""
    begin = max(0, (len(high.n) - SLICE) // 2)
    rows = slice(begin, min(begin + SLICE, len(high.n)))
    pairs = len(sharing(rows)[0]) / (rows.stop - begin) * len(high.n) / len(low.n)
    return pairs > OFTEN + len(high.n) / 128


def block_pairs(low: Texts, high: Texts, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``low`` and in ``high`` of the pairs that may have the ratio; of one chunk (the same ``Texts``) each pair once."""
    alphabet, codes = np.unique(np.concatenate([low.codes, high.codes]), return_inverse=True)
    low_codes, high_codes = np.split(codes.astype(np.intp), [len(low.codes)])
    needed = np.ceil(np.round(least * np.arange(low.n[-1] + high.n[-1] + 1) / 2, 9)).astype(np.int64)
    sharing, known = sharing_characters(low, high, least), None
    if max(low.n[-1], high.n[-1]) <= LONGEST and len(alphabet) <= ALPHABET and shared_often(low, high, sharing):
        whole = slice(0, len(high.n))
        met = ((whole, a, b) for a, b in sharing_parts(low, high, (low_codes, high_codes), len(alphabet), needed))
    else:
        met = sharing_runs(low, high, sharing, needed)
    for rows, a, b in met:
        order = np.argsort(a, kind="stable")
        if len(a) and rows != known:
            known, masks = rows, character_masks(high_codes, high, rows, len(alphabet))
        for part in range(0, len(order), PAIRS):
            x, y = a[order[part : part + PAIRS]], b[order[part : part + PAIRS]]
            need = needed[low.n[x] + high.n[y]]
            alike = common_subsequences(low_codes, low, x, masks, (y - rows.start) * len(alphabet), need) >= need
            if alike.any():
                yield x[alike], y[alike]


def letter_shares(text: pd.Series) -> np.ndarray:
    """For each text the shares of groups of characters in it."""
    n = text.str.len().to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32) % GROUPS
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * GROUPS + codes, minlength=len(n) * GROUPS)
    return counts.reshape(-1, GROUPS) / np.maximum(n, 1)[:, None]


def nearest(shares: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * shares @ centres.T).argmin(axis=1)


def kinds_by_letters(texts: DataFrame) -> Column:
    """The kind of a ``text``, one of up to eight, by its letters: about its language. Few texts are of one kind."""
    if texts.count() <= CHUNKS * SLICE:
        return F.lit(0).cast("long")
    shares = letter_shares(texts.orderBy(F.xxhash64("text")).limit(SAMPLE).select(F.substring("text", 1, LONGEST).alias("text")).toPandas()["text"])
    axes = np.linalg.eigh(np.cov(shares.T))[1][:, -3:]
    kind = ((shares - shares.mean(axis=0)) @ axes > 0) @ np.array([1, 2, 4])
    for _ in range(ROUNDS):
        centres = np.array([shares[kind == k].mean(axis=0) for k in np.unique(kind)])
        kind = nearest(shares, centres)

    @F.pandas_udf("long")
    def kind_of(text: pd.Series) -> pd.Series:
        return pd.Series(nearest(letter_shares(text), centres))

    return kind_of(F.substring("text", 1, LONGEST))


def chunks_of(lengths: pd.DataFrame, size: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """For ``lengths`` (``kind, side, n, of_length``) where the texts of a length ``begin`` and how much each ``takes``; and the lengths of each chunk of ``size``, that has texts of one kind and side. A text takes 1 for each 64 characters, so chunks are bounded also in characters."""
    rows = lengths.sort_values(["kind", "side", "n"], ignore_index=True)
    rows["takes"] = -(-rows["n"] // 64)
    each = rows.groupby(["kind", "side"])
    whole = rows["of_length"] * rows["takes"]
    begin = whole.groupby([rows["kind"], rows["side"]]).cumsum() - whole
    last = (begin + whole - rows["takes"]) // size
    before = (last.groupby(each.ngroup()).max() + 1).cumsum().shift(fill_value=0)
    shift = before.reindex(each.ngroup()).to_numpy()
    rows["begin"] = begin + shift * size
    many = (last - begin // size + 1).to_numpy()
    spread = rows.loc[np.repeat(rows.index, many), ["kind", "side", "n"]]
    spread["chunk"] = np.repeat((begin // size + shift).to_numpy() - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return rows, spread.groupby(["kind", "side", "chunk"], as_index=False).agg(shortest=("n", "min"), longest=("n", "max"))


def pairs_met(texts: DataFrame, least: float, chunk: int, two: bool = False) -> DataFrame:
    """``low_id, low_text, high_id, high_text`` of the pairs of texts that may have the ratio, each once.

    ``texts`` (``id, text, n, kind, side``, read several times) are held against
    each other or, if ``two``, those of side 0 against those of side 1 of their kind.
    """
    spark, as_id = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    lengths = texts.groupBy("kind", "side", "n").agg(F.count("*").alias("of_length")).toPandas().astype("int64")
    size = min(chunk, max(SLICE, -(-int(lengths["of_length"].sum()) // CHUNKS)))
    begins, spread = chunks_of(lengths, size)
    place = F.floor((F.col("begin") + F.pmod(F.xxhash64("text"), F.col("of_length")) * F.col("takes")) / size)
    cut = texts.join(F.broadcast(spark.createDataFrame(begins, "kind long, side long, n long, of_length long, takes long, begin long")), ["kind", "side", "n"]).select("id", "text", place.alias("chunk"))
    chunks = spark.createDataFrame(spread, "kind long, side long, chunk long, shortest long, longest long")
    low, high = (chunks.select(F.col("chunk").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "side", "shortest", "longest")]) for s in ("low", "high"))
    meet_at = ((F.col("low_side") == 0) & (F.col("high_side") == 1) & (F.col("low_kind") == F.col("high_kind"))) if two else F.col("low") <= F.col("high")
    reach = lambda s: F.ceil(F.round(F.col(f"{s}_shortest") * least / (2 - least), 9))
    blocks = low.join(F.broadcast(high), meet_at & (F.col("low_longest") >= reach("high")) & (F.col("high_longest") >= reach("low")))
    parts = blocks.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("chunk"))
    dealt = cut.join(F.broadcast(parts), "chunk").select("low", "high", (F.col("chunk") == F.col("high")).alias("late"), "id", "text")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, part in pdf.groupby(["low", "high"], sort=False):
                if held and (part["low"].iloc[0], part["high"].iloc[0]) != (held[0]["low"].iloc[0], held[0]["high"].iloc[0]):
                    yield from pairs_of(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield from pairs_of(pd.concat(held))

    def pairs_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        high = Texts(rows[rows["late"]])
        low = high if rows["late"].all() and rows["low"].iloc[0] == rows["high"].iloc[0] else Texts(rows[~rows["late"]])
        if not len(low.n) or not len(high.n):  # a chunk that no text's hash fell into
            return
        for left, right in block_pairs(low, high, least):
            one, other = low.rows.iloc[left], high.rows.iloc[right]
            yield pd.DataFrame({"low_id": one["id"].to_numpy(), "low_text": one["text"].to_numpy(), "high_id": other["id"].to_numpy(), "high_text": other["text"].to_numpy()})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(tasks, min(TASKS, blocks.count())), "low", "high").sortWithinPartitions("low", "high")
    return dealt.mapInPandas(meet, f"low_id {as_id}, low_text string, high_id {as_id}, high_text string")


def similar_texts(texts: DataFrame, key: str, text: str, least: float, chunk: int = CHUNK) -> DataFrame:
    """``a, b, a_text, b_text, ratio, back`` of the pairs of different texts with a ratio of at least ``least`` in one of the two directions, ``a`` < ``b``.

    ``key`` is the least key of each text's rows; ``ratio`` is that of the
    text of ``b`` against that of ``a``, ``back`` the other way round, which
    may differ.
    """
    named = texts.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(F.col(text).alias("text")).agg(F.min(key).alias("id")).where("id IS NOT NULL")
    known = materialize(named.select("id", "text", F.length("text").cast("long").alias("n")), "texts")
    met = pairs_met(known.withColumns({"kind": kinds_by_letters(known), "side": F.lit(0).cast("long")}), least, chunk)
    first = F.col("low_id") < F.col("high_id")
    of = lambda mine, column: F.when(mine, F.col(f"low_{column}")).otherwise(F.col(f"high_{column}"))
    met = materialize(met.select(of(first, "id").alias("a"), of(~first, "id").alias("b"), of(first, "text").alias("a_text"), of(~first, "text").alias("b_text")), "met")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = met.repartition(tasks).withColumns({"ratio": similarity("b_text", "a_text"), "back": similarity("a_text", "b_text")})
    return materialize(judged.where((F.col("ratio") >= least) | (F.col("back") >= least)), "similar")


def similar_rows(rows: DataFrame, ord_column: str, text: str, least: float, most: float = 1.0) -> DataFrame:
    """``later, earlier, ratio`` of the rows of different texts with a ratio from ``least`` up to below ``most`` (1 and above: no upper end); the later text is held against the earlier."""
    near = similar_texts(rows, ord_column, text, least)
    both = near.select("a_text", "b_text", "ratio").unionByName(near.select(F.col("b_text").alias("a_text"), F.col("a_text").alias("b_text"), F.col("back").alias("ratio")))
    both = both.where((F.col("ratio") >= least) & (F.lit(most >= 1) | (F.col("ratio") < most)))
    side = lambda s, name: rows.select(F.col(text).alias(f"{s}_text"), F.col(ord_column).alias(name))
    return both.join(side("a", "earlier"), "a_text").join(side("b", "later"), "b_text").where("earlier < later").select("later", "earlier", "ratio")


def first_acceptable(wanted: DataFrame, items: DataFrame, on: list[str], place: str, title: str, item_title: str, asked: tuple[str, ...] = (), rest: Column | None = None, rest_on: tuple[str, ...] = (), least: float = 0.93) -> DataFrame:
    """``wanted`` with ``place``, the least of the items that have its values of ``on`` and are accepted; null without one.

    An item is accepted if its title is equal, has a ratio of ``least`` or
    more, or ``rest`` holds, a condition of the titles, ``on`` and the columns
    ``asked`` of ``wanted``.  ``rest_on`` are columns of both that are equal
    where the titles are or ``rest`` holds; titles that are only alike may
    differ in them, so these meet in blocks, as in ``similar_texts``.  Rows of
    ``wanted`` that are alike ask once, and of items of one title only the first
    is looked at, so copies make no pairs.
    """
    truth = lambda c: F.coalesce(c, F.lit(False))
    mine = [*on, title, *asked, *rest_on]
    questions = materialize(wanted.select(*mine).distinct(), "questions")
    firsts = materialize(items.groupBy(*on, item_title, *rest_on).agg(F.min(place).alias(place)).where(F.col(place).isNotNull()), "firsts")
    sure = truth((F.col(title) == F.col(item_title)) & (F.col(title) != "")) | (truth(rest) if rest is not None else F.lit(False))
    accepted = questions.join(firsts, [*on, *rest_on]).where(sure).select(*mine, place)
    kind = F.pmod(F.xxhash64(*on), F.lit(KINDS))
    side = lambda rows, text, at: rows.select(kind.alias("kind"), F.col(text).alias("text")).where("text <> ''").distinct().withColumns({"n": F.length("text").cast("long"), "side": F.lit(at).cast("long"), "id": F.lit(0)})
    met = pairs_met(side(questions, title, 0).unionByName(side(firsts, item_title, 1)), least, CHUNK, two=True)
    met = materialize(met.select(F.col("low_text").alias("_a"), F.col("high_text").alias("_b")).where("_a <> _b"), "met")
    near = met.distinct().repartition(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))).where(similarity("_a", "_b") >= least)
    answers = firsts.select(*on, F.col(item_title).alias("_b"), place)
    accepted = accepted.unionByName(near.join(questions, F.col("_a") == F.col(title)).join(answers, [*on, "_b"]).select(*mine, place))
    first = accepted.groupBy(*[F.col(c).alias(f"_{i}") for i, c in enumerate(mine)]).agg(F.min(place).alias(place))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(mine)))
    return wanted.join(first, same, "left").select(*wanted.columns, place)
