"""Near duplicates among embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; the coordinate of largest magnitude in a block of ``BLOCK``
turned coordinates, with its sign, is the nearest vertex of that block's
cross-polytope.  One rotation serves all of its blocks; a table's bucket joins
the vertices of a few of them.  Each vector is also filed under buckets that
differ in one vertex, by the second-nearest one, where that is nearly as near
(multiprobe).  How many vertices, tables and probes there are follows from
the number of vectors and from the share of seeded pairs at the threshold that
meet (``settings``).

Buckets hold 128 signs of further rotations in place of vectors; members of a
bucket whose signs are near enough form provisional groups.  Only members of
groups bring their vectors: all pairs within each group are verified by their
cosine in double precision, in tasks of a bounded size.  Equal vectors are one
member with a weight.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components links with nothing, as do vectors of different length;
repeated rows are vectors of their own; a null ``vec_id`` is passed over for
``component_id`` unless the whole group has none; an empty table gives no
rows; further columns are ignored unless they are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import lookup_join, mix, numbered_columns
from gleaner.llm.linkage import components, deal, parts, spread_sparse
from gleaner.scratch import materialize

THRESHOLD = 0.95
#: Columns that are added; of the carried ones those of these names are replaced.
ADDED = ["n_links", "component_id", "kept"]
#: Share of pairs at the threshold that meet in a bucket, and seeded pairs that it is measured on.
RECALL, PAIRS = 0.9999, 4000
#: Coordinates of a block, and vectors that a bucket has by chance at most before another vertex is joined to it.
BLOCK, MATES = 32, 64
#: Signs of a vector's sketch, and how many may differ: five deviations beyond what a pair at the threshold has.
SIGNS, APART = 128, 31
LOOSE_ROWS, EXACT_ROWS, BATCH_ROWS = 1024, 1024, 16384
#: Members up to which the pairs of many buckets are compared at a time, and vectors that are hashed at a time.
FEW, STEP = 32, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each column, whose length is a power of two."""
    h = 1
    while h < len(x):
        y = x.reshape(-1, 2, h, x.shape[1])
        z = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=z[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=z[:, 1])
        x, h = z.reshape(x.shape), 2 * h
    return x


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """Rotation ``t`` of each column, up to a factor."""
    rng = np.random.default_rng([len(x), t])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), (len(x), 1)))
    return x


def padded(width: int) -> int:
    """The power of two that vectors of ``width`` are filled up to with zeros."""
    return 1 << max(1, width - 1).bit_length()


def vertices(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``blocks`` blocks of the rotations of the columns of ``x`` the nearest vertex, the second-nearest one and how much nearer the first is."""
    size, n = min(BLOCK, len(x)), x.shape[1]
    each = len(x) // size
    first, second, gap = np.empty((blocks, n), np.int64), np.empty((blocks, n), np.int64), np.empty((blocks, n), np.float32)
    for t in range(-(-blocks // each)):
        y = rotated(x, t).reshape(each, size, n)
        for b in range(each):
            if (k := t * each + b) >= blocks:
                break
            side, far = y[b], np.abs(y[b])
            at = np.arange(n)
            i = far.argmax(0)
            top = far[i, at]
            far[i, at] = -1
            j = far.argmax(0)
            first[k], second[k] = 2 * i + (side[i, at] < 0), 2 * j + (side[j, at] < 0)
            gap[k] = top - far[j, at]
    return first, second, gap


def buckets(unit: np.ndarray, joined: int, tables: int, probes: int) -> np.ndarray:
    """For each row of unit vectors its ``tables * (1 + probes)`` buckets; a bucket's number holds the length of the vectors, the table and ``joined`` vertices."""
    n, width = unit.shape
    x = np.zeros((padded(width), n), np.float32)
    x[:width] = unit.T
    kinds = 2 * min(BLOCK, len(x))
    first, second, gap = (a.reshape(tables, joined, n) for a in vertices(x, tables * joined))
    place = (kinds ** np.arange(joined)).reshape(1, joined, 1)
    base = (first * place).sum(1)
    out = np.empty((1 + probes, tables, n), np.int64)
    out[0] = base
    order, change = np.argsort(gap, 1), (second - first) * place
    for p in range(probes):
        out[1 + p] = base + np.take_along_axis(change, order[:, p : p + 1], 1)[:, 0]
    out += (np.int64(width) << 43) + (np.arange(tables, dtype=np.int64) << 36).reshape(1, tables, 1)
    return out.reshape(-1, n).T


def signs(unit: np.ndarray) -> np.ndarray:
    """For each row ``SIGNS`` signs of rotations that no bucket uses, as two 64-bit numbers."""
    n, width = unit.shape
    x = np.zeros((padded(width), n), np.float32)
    x[:width] = unit.T
    bits = np.concatenate([rotated(x, 10_000 + t)[:SIGNS] < 0 for t in range(max(1, SIGNS // len(x)))])[:SIGNS]
    return np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64)


@lru_cache(maxsize=64)
def settings(width: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """``joined, tables, probes`` for ``n`` vectors of a padded ``width``: vertices until a bucket has ``MATES`` vectors by chance, then the fewest filings that meet ``recall``."""
    kinds = 2 * min(BLOCK, width)
    joined = 1
    while joined < 6 and n > MATES * kinds**joined:
        joined += 1
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, PAIRS, width))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(1)[:, None] * a
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1)[:, None]
    best = None
    for probes in range(1, joined + 1):
        x, y = (buckets(v, joined, 8, probes).reshape(PAIRS, 1 + probes, 8) for v in (a, b))
        met = float((x[:, :, None] == y[:, None]).any((1, 2)).mean())
        tables = min(120, int(np.ceil(np.log(1 - recall) / np.log(max(1e-9, 1 - min(met, 0.9999))))))
        if best is None or tables * (1 + probes) < best[1] * (1 + best[2]):
            best = joined, max(1, tables), probes
    return best


def matrix(column: pa.ListArray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Unit vectors of the usable lists, those of one length together: their places and a row each."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    count = lambda x: (lambda run: run[begin + size] - run[begin])(np.r_[0, np.cumsum(x)])
    usable = (size > 0) & (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
    for width in np.unique(size[usable]).tolist():
        at = np.flatnonzero(usable & (size == width))
        x = flat[begin[at][:, None] + np.arange(width)]
        x = x / np.abs(x).max(1, keepdims=True)  # no overflow on the way to the length
        yield at, x / np.sqrt((x**2).sum(1, keepdims=True)) + 0.0


def digests(unit: np.ndarray) -> list[bytes]:
    raw = memoryview(np.ascontiguousarray(unit)).cast("B")
    step = 8 * unit.shape[1]
    return [hashlib.md5(raw[i : i + step]).digest() for i in range(0, len(raw), step)]


def hashed(vectors: DataFrame, chosen: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``_row, _id, digest, left, right, buckets``: all but the first two are null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                n = part.num_rows
                digest, spots, sketch = np.full(n, None, object), np.full(n, None, object), np.zeros((n, 2), np.int64)
                for at, unit in matrix(part.column("embedding")):
                    digest[at] = digests(unit)
                    spots[at] = list(buckets(unit, *chosen[padded(unit.shape[1])]))
                    sketch[at] = signs(unit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_id"), pa.array(digest, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(spots, pa.list_(pa.int64()))],
                    names=["_row", "_id", "digest", "left", "right", "buckets"],
                )

    schema = vectors.select("_row", "_id").schema.add("digest", "binary").add("left", "long").add("right", "long").add("buckets", T.ArrayType(T.LongType()))
    return vectors.mapInArrow(run, schema)


def units(vectors: DataFrame) -> DataFrame:
    """``digest, unit`` of each usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                for _, unit in matrix(batch.column("embedding").slice(start, STEP)):
                    yield pa.RecordBatch.from_arrays([pa.array(digests(unit), pa.binary()), pa.array([u.tobytes() for u in unit], pa.binary())], names=["digest", "unit"])

    return vectors.select("embedding").mapInArrow(run, "digest binary, unit binary")


def _loose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect the members of each bucket whose signs are near."""
    pdf = pdf.sort_values(["part", "member"], ignore_index=True)
    part, name = pdf["part"].to_numpy(), pdf["member"].to_numpy()
    left, right = (pdf[c].to_numpy().view(np.uint64) for c in ("left", "right"))
    near = lambda i, j: np.bitwise_count(left[i] ^ left[j]) + np.bitwise_count(right[i] ^ right[j]) <= APART
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    size = np.diff(np.r_[starts, len(part)])
    few = np.repeat(size <= FEW, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(FEW, int(size.max(initial=0)) + 1)):
        i = np.flatnonzero((part[d:] == part[:-d]) & few[d:])
        if not len(i):
            break
        i = i[near(i, i + d)]
        a.append(i + d)
        b.append(i)
    for g in np.flatnonzero(size > FEW):
        at = starts[g] + np.arange(size[g])
        i, j = np.nonzero(near(at[:, None], at[None, :]))
        a.append(at[i[i > j]])
        b.append(at[j[i > j]])
    _, same = np.unique(name, return_inverse=True)  # a member of several buckets of the task is one node
    label = spread_sparse(int(same.max(initial=-1)) + 1, same[np.concatenate(a)], same[np.concatenate(b)])
    names = np.unique(name)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})


def _units(column: pd.Series) -> np.ndarray:
    data = b"".join(column)  # of equal length
    return np.frombuffer(data, np.float64).reshape(len(column), -1) if data else np.zeros((0, 0))


def _exact(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each member within its part, and the least member that links reach there."""
    out = []
    for part in parts(pdf.sort_values("member"), ["root"]):
        side, i, j = part["_c"].to_numpy(), part["_i"].iloc[0], part["_j"].iloc[0]
        x, rows = _units(part["unit"]), part["n_rows"].to_numpy()
        left = np.arange(len(part)) if i == j else np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        near = x[left] @ x[right].T >= THRESHOLD
        count = np.zeros(len(part), np.int64)
        count[left] = near @ rows[right]
        if i == j:
            count -= np.diag(near) * rows
        else:
            count[right] = rows[left] @ near
        a, b = np.nonzero(near)
        name = part["member"].to_numpy()
        out.append(pd.DataFrame({"member": name, "links": count, "least": name[spread_sparse(len(part), left[a], right[b])]}))
    return pd.concat(out)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (the id unless named) of each row with ``n_links`` (other vectors at the cosine ``THRESHOLD`` or above), ``component_id`` (the least id reachable by links) and ``kept``."""
    carry = [id_column] if carry is None else carry
    plain, place = numbered_columns(vectors, [*carry, id_column, "embedding"])
    named = plain.withColumnRenamed(place["embedding"], "embedding")
    vectors = named.select("embedding")
    width = F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(2)).cast("long")
    sizes = vectors.groupBy(F.length(F.bin(width - 1)).alias("power")).count().collect()  # lengths up to a power of two: some thirty rows at most
    chosen = {2 ** r["power"]: settings(2 ** r["power"], sum(r["count"] for r in sizes)) for r in sizes}
    row = F.struct(*dict.fromkeys(place[c] if c != "embedding" else c for c in carry))
    rows = hashed(named.select(row.alias("_row"), F.col(place[id_column]).cast("long").alias("_id"), "embedding"), chosen)
    rows = materialize(rows.withColumn("_uid", F.monotonically_increasing_id()), "vectors")
    rep = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_uid").alias("uid"))
    usable = rows.where("digest IS NOT NULL")
    equal = usable.groupBy("digest").agg(F.min(rep).alias("rep"), F.min("_uid").alias("member"), F.count("*").alias("n_rows"))
    equal = materialize(equal.where("n_rows > 1").withColumnRenamed("digest", "_digest"), "equal")
    kinds = lookup_join(usable, equal, F.col("digest") == F.col("_digest"), "left").where("member IS NULL OR member = _uid")
    kinds = kinds.withColumn("rep", F.coalesce("rep", rep)).withColumn("n_rows", F.coalesce("n_rows", F.lit(1).cast("long"))).withColumn("member", F.col("_uid"))

    spots = kinds.select("member", "left", "right", F.explode("buckets").alias("bucket"))
    shared = materialize(spots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "_bucket"), "shared")
    batches = max(1, (shared.agg(F.sum("n")).first()[0] or 0) // BATCH_ROWS)
    met = lookup_join(spots, shared, F.col("bucket") == F.col("_bucket"))
    met = deal(met, ["bucket"], F.col("member"), F.col("n"), LOOSE_ROWS, batches).select("_task", F.xxhash64("bucket", "_i", "_j").alias("part"), "member", "left", "right")
    groups = materialize(components(met.groupBy("_task").applyInPandas(_loose, "a long, b long")), "groups")

    sizes = materialize(groups.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "_root"), "sizes")
    members = lookup_join(groups, sizes, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "root", "n")
    members = materialize(lookup_join(kinds.select("digest", "member", "rep", "n_rows"), materialize(members, "nodes"), F.col("member") == F.col("_node")).withColumnRenamed("digest", "_digest"), "members")
    batches = max(1, members.count() // BATCH_ROWS)
    brought = lookup_join(units(vectors), members.select("_digest", "member", "root", "n", "n_rows"), F.col("digest") == F.col("_digest")).dropDuplicates(["member"]).drop("digest", "_digest")
    exact = materialize(deal(brought, ["root"], F.col("member"), F.col("n"), EXACT_ROWS, batches).groupBy("_task").applyInPandas(_exact, "member long, links long, least long"), "links")
    links = exact.groupBy("member").agg(F.sum("links").alias("links"))
    joined = components(exact.select(F.col("member").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "member")

    # what is judged: members with links, and vectors that occur several times
    several = lookup_join(equal.select(F.col("_digest").alias("digest"), "rep", "member", "n_rows"), members.select(F.col("member").alias("_node")), F.col("member") == F.col("_node"), "left_anti")
    every = members.select(F.col("_digest").alias("digest"), "rep", "member", "n_rows").unionByName(several)
    of_kind = every.join(links, "member", "left").join(joined, "member", "left").withColumn("root", F.coalesce("root", "member"))
    of_kind = materialize(of_kind, "kinds")
    best = materialize(of_kind.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("best")), "best")
    verdict = lookup_join(of_kind, best, F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), "best")
    verdict = materialize(verdict.where("n_links > 0"), "verdicts")
    judged = lookup_join(rows, verdict, F.col("digest") == F.col("_digest"), "left")
    alone = F.col("best").isNull()
    return judged.select(
        *[F.col(f"_row.{place[c] if c != 'embedding' else c}").alias(c) for c in carry if c.lower() not in ADDED],
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("_id")).otherwise(F.col("best.id")).alias("component_id"),
        (alone | (F.col("_uid") == F.col("best.uid"))).alias("kept"),
    )
