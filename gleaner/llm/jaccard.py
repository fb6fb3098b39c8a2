"""Self-join of texts by the Jaccard similarity of their word shingles, with a MinHash LSH forest.

Each distinct text gets ``TREES * DEPTH`` minima of hashed shingles of five
words, 16 bits of each; a tree's path is its ``DEPTH`` minima in one 64-bit
number, so a tree is the sorted order of those numbers and a prefix is what
stands left of a shift.

Texts meet first where whole paths are equal, then prefixes are shortened
level by level.  A text stops when what it is expected to miss is small beside
what it has found: with k texts in its group and a pair at the threshold
found with probability p at this depth, k + 1 of k + 1 / p, at least
``RECALL``.  So members of large groups stop at long prefixes, and texts that
are alone, whose only link may be the one that is missed, go on to the depth
at which that pair is found with probability ``RECALL``.  At each level only
prefixes count that hold texts of different groups, one of them not stopped,
and only such pairs are compared: what longer prefixes have connected takes
no part in the larger sets of shorter ones.

Texts that meet are linked provisionally if their signatures agree well
enough; each connected group is then compared exactly, in tasks of bounded
size, by whole sets of shingles (of 64-bit hashes of shingles, to be exact:
two different ones are taken for one with a probability of 2 ** -64).

Groups, not pairs, are what is kept: each task returns its members' numbers of
links and one edge a member.  Equal texts are one member with a weight.

Defined results: a text of one to four words is one shingle; a text without
words (null, empty, white space) links with nothing; repeated rows are
documents of their own; of a group's rows, the one of least ``doc_id`` (nulls
last) stays, one of them if that occurs twice; a null ``doc_id`` is passed
over for ``class_id`` unless the whole group has none; an empty table gives no
rows; other columns are ignored unless they are carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import Words, append_column, lookup_join, mix, numbered_columns, windows_of
from gleaner.llm.linkage import components, deal, links_within, numbered, parts, spread
from gleaner.scratch import materialize

#: Columns that are added; of the carried ones those of these names are replaced.
ADDED = ["n_links", "class_id", "kept"]
WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 4, 0.9999999
#: Share of equal minima that links two texts provisionally: six deviations below the threshold.
AGREE = 0.55
#: Members of a chunk in the provisional and in the exact comparison, members of small groups in a task, and shingles that are compared at a time.
LOOSE_ROWS, EXACT_ROWS, BATCH_ROWS, COLUMNS = 1024, 512, 1024, 4096


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the offsets of each text's."""
    words = Words(texts)
    hashed = words.hashes()[words.codes]
    starts, _ = windows_of(words.offsets, width)
    short = (words.counts > 0) & (words.counts < width)
    n = np.maximum(words.counts - width + 1, 0) + short
    cut = np.r_[0, np.cumsum(n)]
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty(cut[-1], np.uint64)
    of_short = np.zeros(cut[-1], bool)
    of_short[cut[:-1][short]] = True
    total = np.zeros(len(starts), np.uint64)
    for j in range(width):
        total += hashed[starts + j] * odd[j]
    out[~of_short] = mix(total)
    for i in np.flatnonzero(short):
        w = hashed[words.offsets[i] : words.offsets[i + 1]]
        out[cut[i]] = mix((w * odd[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, cut


def found(threshold: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair at the threshold shares a prefix of that depth in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def depth_for(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The depth at which a text that is alone stops: the longest at which a pair at the threshold is found with probability ``recall``."""
    while depth > 1 and found(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def enough(threshold: float, depth: int, recall: float | None = None) -> float:
    """The size of group from which on its members stop at ``depth``."""
    recall = RECALL if recall is None else recall
    return 1 + max(0.0, (recall / found(threshold, depth) - 1) / (1 - recall))


def paths(texts: pa.Array, trees: int = TREES, depth: int = DEPTH) -> pa.Array:
    """Each text's path in each tree; null for a text without words."""
    hashed, cut = shingles(texts)
    some = np.flatnonzero(np.diff(cut))
    seeds = mix(np.arange(2 * trees * depth, dtype=np.uint64) + np.uint64(0x1D8E4E27C47D124F))
    out = np.zeros((len(some), trees, depth), np.uint16)
    if len(some):
        for k in range(trees * depth):
            least = np.minimum.reduceat((hashed ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), cut[some])
            out[:, k // depth, depth - 1 - k % depth] = mix(least) & np.uint64(0xFFFF)  # the first minimum is the high end of the number
    flat = pa.array(np.ascontiguousarray(out).view(np.int64).reshape(-1))
    ends = np.zeros(len(cut), np.int32)
    ends[some + 1] = trees
    mask = np.ones(len(cut) - 1, bool)
    mask[some] = False
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), flat, mask=pa.array(mask))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _loose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, part = numbered(pdf.sort_values("class"), ["tree", "prefix"])
    minima = np.stack(pdf["paths"].to_list()).view(np.uint16)
    least, name = int(np.ceil(AGREE * minima.shape[1])), pdf["class"].to_numpy()
    group = pd.factorize(pdf["root"])[0]
    a, b = links_within(part, lambda i, j: (minima[i] == minima[j]).sum(-1) >= least, group, pdf["open"].to_numpy())
    return pd.DataFrame({"a": name[a], "b": name[b]}).drop_duplicates()


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right`` (places in ``sets``)."""
    flat = np.concatenate(sets)
    kinds, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = n[place] > 1  # what one text has alone meets nothing
    order = np.argsort(place[keep], kind="stable")
    owner, place = owner[keep][order], (np.cumsum(n > 1) - 1)[place[keep][order]]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        span = slice(*np.searchsorted(place, [a, a + COLUMNS]))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[span], place[span] - a] = 1
        out += x[left] @ x[right].T
    return out


def _exact(threshold: float):
    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(b, np.uint64) for b in part["shingles"]]
        size, weight, side = np.array([len(s) for s in sets]), part["n_docs"].to_numpy(), part["_c"].to_numpy()
        i, j = part["_i"].iloc[0], part["_j"].iloc[0]
        left = np.arange(len(sets)) if i == j else np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        both = common(sets, left, right)
        near = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-6
        linked = np.zeros((len(sets), len(sets)), bool)
        linked[np.ix_(left, right)] = near
        linked |= linked.T
        np.fill_diagonal(linked, False)
        name = part["class"].to_numpy()
        return pd.DataFrame({"class": name, "links": linked @ weight, "root": name[spread(linked)]})

    return lambda pdf: pd.concat([compare(p) for p in parts(pdf.sort_values("class"), ["root"])])


def forest(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, root, n, stop`` of each text of ``classes(class, paths)`` that is linked provisionally: its group, the group's size, and the depth at which it stopped."""
    last = min(DEPTH, depth_for(threshold, recall=RECALL))
    prefix = lambda depth: F.shiftrightunsigned("path", 16 * (DEPTH - depth))
    spots = classes.select("class", F.posexplode("paths").alias("tree", "path"))
    # texts that are alone at the last depth are alone at all others
    company = spots.groupBy("tree", prefix(last).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    tries = materialize(spots.withColumn("prefix", prefix(last)).join(company, ["tree", "prefix"]).drop("prefix"), "tries")
    state = None
    for depth in range(DEPTH, last - 1, -1):
        here = tries.withColumn("prefix", prefix(depth)).drop("path")
        if state is None:
            here = here.withColumn("root", F.col("class")).withColumn("open", F.lit(True))
        else:
            known = state.select("node", "root", F.col("stop").isNull().alias("open"))
            here = lookup_join(here, known, F.col("class") == F.col("node"), "left").drop("node")
            here = here.withColumn("root", F.coalesce("root", "class")).withColumn("open", F.coalesce("open", F.lit(True)))
        sets = here.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("open").alias("some"))
        shared = materialize(sets.where("low <> high AND some").select("tree", "prefix", "n"), "shared")
        size = shared.agg(F.sum("n")).first()[0] or 0
        if state is not None and not size:
            continue
        met = here.join(shared, ["tree", "prefix"]).join(classes.select("class", "paths"), "class")
        edges = deal(met, ["tree", "prefix"], F.col("class"), F.col("n"), LOOSE_ROWS, max(1, size // BATCH_ROWS)).groupBy("_task").applyInPandas(_loose, "a binary, b binary")
        groups = components(edges if state is None else edges.union(state.select("node", "root")))
        groups = materialize(groups, "groups")
        sizes = materialize(groups.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("n")), "sizes")
        sized = lookup_join(groups, sizes, F.col("root") == F.col("_root")).drop("_root")
        if state is not None:
            sized = lookup_join(sized, state.select(F.col("node").alias("_node"), F.col("stop").alias("before")), F.col("node") == F.col("_node"), "left")
        before = F.col("before") if state is not None else F.lit(None).cast("int")
        state = materialize(sized.select("node", "root", "n", F.coalesce(before, F.when(F.col("n") >= enough(threshold, depth), depth)).alias("stop")), "state")
    return state.withColumn("stop", F.coalesce("stop", F.lit(last)))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (``doc_id`` unless named) of each row of ``docs`` with ``n_links`` (other documents at the threshold or above), ``class_id`` (the least ``doc_id`` reachable by links) and ``kept``."""
    carry = ["doc_id"] if carry is None else carry
    plain, place = numbered_columns(docs, [*carry, "doc_id", "text"])
    text = F.col(place["text"])
    keyed = plain.select(F.struct(*dict.fromkeys(place[c] for c in carry)).alias("_row"), F.col(place["doc_id"]).alias("_id"), text.alias("_text"), text_key(text).alias("class"))
    signed = append_column(keyed, "paths", T.ArrayType(T.LongType()), "_text", lambda part: paths(part.column("_text")), drop=True)
    rows = materialize(signed.withColumn("_uid", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_uid").alias("uid")))
    classes = rows.where("paths IS NOT NULL").groupBy("class").agg(first.alias("rep"), F.count("*").alias("n_docs"), F.first("paths").alias("paths"))
    classes = materialize(classes, "classes")

    groups = forest(classes.select("class", "paths"), threshold)
    members = lookup_join(classes.select("class", "n_docs"), groups, F.col("class") == F.col("node")).drop("class", "stop")
    members = materialize(members.withColumnRenamed("node", "_member"), "members")
    texts = rows.select("class", F.col(f"_row.{place['text']}").alias("_text")) if "text" in carry else keyed.select("class", "_text")
    texts = lookup_join(texts, members, F.col("class") == F.col("_member")).drop("_member").dropDuplicates(["class"])

    def sets(part: pa.RecordBatch) -> pa.Array:
        hashed, cut = shingles(part.column("_text"))
        return pa.array([np.unique(hashed[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())

    compared = append_column(texts, "shingles", T.BinaryType(), "_text", sets, drop=True)
    batches = max(1, members.count() // EXACT_ROWS)
    exact = deal(compared, ["root"], F.col("class"), F.col("n"), EXACT_ROWS, batches).groupBy("_task").applyInPandas(_exact(threshold), "class binary, links long, root binary")
    exact = materialize(exact, "links")
    linked = exact.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(exact.select(F.col("class").alias("a"), F.col("root").alias("b")))

    of_class = classes.select("class", "rep", "n_docs").join(linked, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    # only texts that have a link or a copy are judged
    of_class = materialize(of_class.withColumn("root", F.coalesce("root", "class")).where("links > 0 OR n_docs > 1"), "linked")
    best = materialize(of_class.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("best")), "best")
    verdict = lookup_join(of_class, best, F.col("root") == F.col("_root")).select(F.col("class").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), "best")
    verdict = materialize(verdict.where("n_links > 0"), "verdicts")
    judged = lookup_join(rows, verdict, F.col("class") == F.col("_class"), "left")
    alone = F.col("best").isNull()
    return judged.select(
        *[F.col(f"_row.{place[c]}").alias(c) for c in carry if c.lower() not in ADDED],
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("_id")).otherwise(F.col("best.id")).alias("class_id"),
        (alone | (F.col("_uid") == F.col("best.uid"))).alias("kept"),
    )


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` of each class, with its own columns, whatever their names."""
    plain, place = numbered_columns(docs, docs.columns)
    named = {place["doc_id"]: "doc_id", place["text"]: "text"}
    found = near_duplicates(plain.withColumnsRenamed(named), threshold, [named.get(c, c) for c in plain.columns])
    return found.where("kept").select(*[F.col(named.get(place[c], place[c])).alias(c) for c in docs.columns])
