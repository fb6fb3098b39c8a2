"""What near-duplicate operators share: connected components, and comparisons within groups dealt over tasks of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS
from gleaner.scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``: the root is the least node that it reaches.

    Large-star and small-star rounds: a node's neighbours move to the least of
    them until only stars are left, after about log(longest path) rounds.
    Minima are combined before they are shuffled; no neighbourhood is held.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = now
        few = (lambda t: F.broadcast(t)) if now[0] <= BROADCAST_ROWS // 2 else (lambda t: t)  # there are at most two nodes an edge
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(few(least), F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(few(least), F.col("u") == F.col("x"))
        old, e = e, materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("x", "m")).distinct(), "edges")
        discard(old)


def deal(grouped: DataFrame, keys: list[str], member: Column, size: Column, rows: int, batches: int) -> DataFrame:
    """Deal the members of each group ``keys`` over tasks ``_task`` and, in them, parts ``_i, _j``; ``_c`` is a member's side.

    A group of up to ``rows`` members is one part.  A larger one is cut into
    chunks by the hash of the member, and every pair of chunks is a part, so
    that each pair of members meets once: of different chunks in the part of
    both, of one chunk in the part ``_i = _j``.  Small groups share ``batches``
    tasks, others are tasks of their own.
    """
    chunks = F.ceil(size / rows).cast("int")
    own = F.pmod(F.xxhash64(member), chunks.cast("long")).cast("int")
    alone = size > max(1, rows // 16)
    return (
        grouped.withColumn("_n", chunks)
        .withColumn("_c", own)
        .withColumn("_o", F.explode(F.when(F.col("_n") > 1, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("_i", F.least("_c", "_o"))
        .withColumn("_j", F.greatest("_c", "_o"))
        .withColumn("_task", F.when(alone, F.xxhash64(*keys, "_i", "_j")).otherwise(F.pmod(F.xxhash64(*keys), F.lit(batches))))
        .drop("_n", "_o")
    )


def numbered(pdf: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """A task's members, those of a part together, and the number of each one's part."""
    by = [*keys, "_i", "_j"]
    pdf = pdf.sort_values(by, kind="stable", ignore_index=True)
    new = np.zeros(len(pdf), bool)
    for c in by:
        x = pdf[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return pdf, np.cumsum(new)


def parts(pdf: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    """The parts of a task."""
    pdf, part = numbered(pdf, keys)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pdf)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield pdf.iloc[a:b]


def links_within(part: np.ndarray, similar: Callable[[np.ndarray, np.ndarray], np.ndarray], group: np.ndarray, open_: np.ndarray, few: int = 8, step: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """Places ``a, b`` of members of one part that are linked, enough of them to connect what is linked in it.

    ``similar(i, j)`` tells whether members i and j link.  Members of one
    ``group`` are connected already; of two others one must be ``open_``.  In
    parts of up to ``few`` members all such pairs are compared, those of many
    parts at a time.
    """
    size = np.bincount(part)
    small = size[part] <= few
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, few):
        at = np.flatnonzero((part[d:] == part[:-d]) & small[d:] & (group[d:] != group[:-d]) & (open_[d:] | open_[:-d]))
        for k in range(0, len(at), step):
            i = at[k : k + step]
            i = i[similar(i, i + d)]
            a.append(i + d)
            b.append(i)
    ends = np.cumsum(size)
    for g in np.flatnonzero(size > few):
        first = ends[g] - size[g]
        here = slice(first, ends[g])
        _, least, label = np.unique(group[here], return_index=True, return_inverse=True)
        label = connect(int(size[g]), lambda i, others, first=first: similar(first + i, first + others), least[label], open_[here])
        moved = np.flatnonzero(label != np.arange(size[g]))
        a.append(first + moved)
        b.append(first + label[moved])
    return np.concatenate(a), np.concatenate(b)


def connect(n: int, similar: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray | None = None, open_: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` members the least member that it reaches; ``similar(i, others)`` marks the others that i links with.

    Members that are connected already, as those of one ``label`` are, aren't
    compared, so a group of copies takes about as many comparisons as it has
    members.
    """
    label = np.arange(n) if label is None else label.copy()
    open_ = np.ones(n, bool) if open_ is None else open_
    for i in range(n):
        others = np.flatnonzero((label[i + 1 :] != label[i]) & (open_[i + 1 :] | open_[i])) + i + 1
        if not len(others):
            continue
        if len(near := others[similar(i, others)]):
            joined = np.unique(np.r_[label[i], label[near]])
            label[np.isin(label, joined)] = joined[0]
    return label


def spread(linked: np.ndarray) -> np.ndarray:
    """For each member the least member that it reaches by a symmetric matrix of links."""
    label, n = np.arange(len(linked)), len(linked)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def spread_sparse(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the least member that it reaches by the links ``a, b``."""
    label = np.arange(n)
    while True:
        least, one, two = label.copy(), label[a], label[b]
        low = np.minimum(one, two)
        for at in (a, b, one, two):
            np.minimum.at(least, at, low)
        least = least[least]
        if (least == label).all():
            return label
        label = least
