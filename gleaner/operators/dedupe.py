"""Deduplication by keys, consolidation of equal events, and greedy leaders.

A greedy run keeps a row unless a row kept before it shares a key; what was
dropped never drops others.  A row that is the least of all its keys among the
undecided ones leads whatever the others become, so the run is repeated in
rounds over DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.scratch import materialize, scratch_path

#: Undecided rows that one task replays.
BATCH_ROWS = 20_000


def first_by(rows: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each group of keys."""
    columns = rows.columns
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").select(*columns)


def best_by(rows: DataFrame, key: str, preference: Column, columns: list[str]) -> DataFrame:
    """The first row of each key as an aggregate: combined before the shuffle, so that no hot key meets in one task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), preference).alias("_best")).select(key, *[F.col(f"_best.{c}").alias(c) for c in columns if c != key])


def consolidate(rows: DataFrame, event: str, order: Column, category: str, category_rank: Column, lists: list[str], carry: list[str]) -> DataFrame:
    """One row per non-empty event id: the preferred row's ``carry``, the category of highest (rank, name), the union of ``lists``, the number of rows. Rows without an id stay as they are."""
    named = F.coalesce(F.col(event), F.lit("")) != ""
    merged = rows.where(named).groupBy(event).agg(
        F.min_by(F.struct(*carry), order).alias("_row"),
        F.max(F.struct(category_rank.alias("r"), F.col(category).alias("c"))).alias("_cat"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists],
        F.count("*").alias("n_merged"),
    )
    out = [event, *[F.col(f"_row.{c}").alias(c) for c in carry], F.col("_cat.c").alias(category), *lists, "n_merged"]
    alone = rows.where(~named).select(event, *carry, category, *[F.array_sort(F.array_distinct(c)).alias(c) for c in lists], F.lit(1).cast("long").alias("n_merged"))
    return merged.select(*out).unionByName(alone)


def greedy_leaders(rows: DataFrame, keys: str, ord_column: str, same: Callable[[tuple, tuple], bool] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``ord, leader_ord, matched_key`` of each row in the order ``ord``: a row that shares a key with an earlier leader (and for which ``same`` holds, given) follows the first such leader by its keys' order; else it leads.

    A row without keys leads.  A round takes the least undecided row of each
    key, makes those leaders that are the least of all their keys, and decides
    the rows that share a key with them; so a hot key is a partial aggregate
    and no group is held.  A round that decides little (a chain in order), the
    last rows, and rows under a comparison are taken by blocks: the first
    ``BATCH_ROWS`` undecided rows are replayed in a task, and their leaders
    meet the rest in a join.
    """
    carry = list(carry or []) if same else []
    each = rows.select(F.col(ord_column).cast("long").alias("_o"), F.posexplode(keys).alias("_p", "_k"), *carry)
    return _decide(rows, each, ord_column, same, carry)


def _decide(rows: DataFrame, each: DataFrame, ord_column: str, same: Callable[[tuple, tuple], bool] | None, carry: list[str]) -> DataFrame:
    """The greedy run over the keys ``each(_o, _p, _k)`` of rows."""
    spark = rows.sparkSession
    # a key of one row decides nothing
    shared = each.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    links = materialize(each.join(shared, "_k").select("_o", "_p", "_k", *carry), "keys")
    taken = links.select("_o", "_k", *carry).limit(0)
    folder, schema, n = scratch_path(spark, "leaders"), taken.schema, len(carry)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: dict[str, list[tuple]] = {}
        out = []
        for at, own in groupby(pdf[["_o", "_k", *carry]].sort_values("_o").itertuples(index=False, name=None), key=lambda r: r[0]):
            own = list(own)
            values = own[0][2:]
            if any(same is None or same(first, values) for r in own for first in leaders.get(r[1], ())):
                continue
            for k in dict.fromkeys(r[1] for r in own):
                leaders.setdefault(k, []).append(values)
                out.append((at, k, *values))
        return pd.DataFrame(out, columns=["_o", "_k", *carry])

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[pd.Series([same(r[4 + n :], r[4 : 4 + n]) for r in pdf.itertuples(index=False, name=None)], index=pdf.index, dtype=bool)]

    def followers(undecided: DataFrame, leaders: DataFrame) -> DataFrame:
        side = leaders.select("_k", F.col("_o").alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in carry])
        met = undecided.join(side, "_k").where("_l < _o").select("_o", "_p", "_l", "_k", *carry, *[f"_l_{c}" for c in carry])
        return met.mapInPandas(agree, met.schema) if same else met

    undecided, left, slow, step = links, links.count(), False, 0
    while left:
        by_block = same is not None or slow or left <= BATCH_ROWS
        if by_block:
            first = undecided.select("_o").distinct().orderBy("_o").limit(BATCH_ROWS)
            new = undecided.join(F.broadcast(first), "_o").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(replay, schema)
        else:
            least = undecided.groupBy("_k").agg(F.min("_o").alias("_m"))
            leads = undecided.join(least, "_k").groupBy("_o").agg(F.bool_and(F.col("_o") == F.col("_m")).alias("_leads")).where("_leads")
            new = least.join(leads, F.col("_m") == F.col("_o"), "left_semi").select(F.col("_m").alias("_o"), "_k")
        new.write.parquet(f"{folder}/step={step}")
        new = spark.read.schema(schema).parquet(f"{folder}/step={step}")
        decided = new.select("_o").unionByName(followers(undecided, new).select("_o")).distinct()
        undecided = materialize(undecided.join(decided, "_o", "left_anti"), "undecided")
        before, left, step = left, undecided.count(), step + 1
        slow = not by_block and before - left < BATCH_ROWS
        taken = spark.read.schema(schema).parquet(f"{folder}/step=*")
    hits = followers(links, taken).groupBy("_o").agg(F.min(F.struct("_p", "_l", "_k")).alias("_hit"))
    own = F.col(ord_column).cast("long")
    return rows.select(own.alias(ord_column)).join(hits, F.col(ord_column) == F.col("_o"), "left").select(ord_column, F.coalesce("_hit._l", ord_column).alias("leader_ord"), F.col("_hit._k").alias("matched_key"))


def conflicting_ids(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """Keys that occur with more than one id."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(identity).alias("n_ids")).where("n_ids > 1")


def provenance(rows: DataFrame, key: str, ord_column: str, lane: str, fields: list[str]) -> DataFrame:
    """Every distinct provenance entry of each key as a row, ``pos`` by first appearance from 1."""
    first = rows.groupBy(key, lane, *fields).agg(F.min(ord_column).alias("_o"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("_o", *fields))).select(key, "pos", lane, *fields)


def merge_provenance(rows: DataFrame, key: str, ord_column: str, lane: str, fields: list[str], most: int | None = None) -> DataFrame:
    """Per key the lanes in order of first appearance, and the distinct provenance entries in that order: all, or up to ``most``."""
    each = provenance(rows, key, ord_column, lane, fields)
    in_order = lambda c: F.array_sort(F.collect_list(c))
    lanes = each.groupBy(key, lane).agg(F.min("pos").alias("pos")).groupBy(key).agg(F.transform(in_order(F.struct("pos", lane)), lambda s: s[lane]).alias("lanes"))
    ranked = each if most is None else each.where(F.col("pos") <= most)
    entries = ranked.groupBy(key).agg(F.transform(in_order(F.struct("pos", lane, *fields)), lambda s: F.concat_ws("|", *[s[f] for f in [lane, *fields]])).alias("provenance"))
    return lanes.join(entries, key)
