"""Planning of retrieval as dimension tables: products under caps, budgets, temporal routes."""

from __future__ import annotations

import re
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import dates
from gleaner.functions.urls import domain
from gleaner.operators.sizes import dimension


#: Rows that a product of dimensions may have.
PRODUCT_ROWS = 10_000_000


def _product(tables: list[DataFrame]) -> DataFrame:
    """All combinations of the rows of small tables; their number is known before any is made."""
    if (n := prod(t.count() for t in tables)) > PRODUCT_ROWS:
        raise ValueError(f"a product of at most {PRODUCT_ROWS} rows is wanted here, this one has {n}")
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), tables)


def plan_queries(dimensions: list[DataFrame], pattern: Column, order: list[str], cap: int) -> DataFrame:
    """The product of small dimensions as ``query``, each distinct one once in the given order, under a cap: a plan of at most ``cap`` rows."""
    product = _product([dimension(d) for d in dimensions])
    first = product.withColumn("query", pattern).groupBy("query").agg(F.min(F.struct(*order)).alias("_at"), F.min_by(F.struct(*product.columns), F.struct(*order)).alias("_row"))
    return first.orderBy("_at").limit(cap).select("query", "_row.*")


def alternate(specs: DataFrame, family: str, position: str, family_position: str) -> DataFrame:
    """Families in turn: the first spec of each, then the second, as ``turn``."""
    turn = F.row_number().over(Window.partitionBy(family).orderBy(position))
    return specs.withColumn("turn", turn).orderBy("turn", family_position)


def canonical_template(specs: DataFrame, family: str, language: str, position: str, preferred: str = "en") -> DataFrame:
    """Each family's first spec in the preferred language, else its first."""
    columns = [c for c in specs.columns if c != family]
    best = F.min_by(F.struct(*columns), F.struct((F.col(language) != preferred).cast("int"), F.col(position)))
    return specs.groupBy(family).agg(best.alias("_b")).select(family, "_b.*")


def time_limit(lookback_days: Column) -> Column:
    return F.when(lookback_days <= 7, "w").when(lookback_days <= 31, "m").otherwise("y")


def temporal_plan(periods: DataFrame, start: str, stop: str, specs: DataFrame, family: str) -> DataFrame:
    """Routes: calendar quarters of each period by one spec per family, with zeroed counters."""
    buckets = dates.quarter_buckets(periods, start, stop)
    routes = buckets.join(F.broadcast(dimension(specs)), F.lit(True))
    return routes.withColumn("route_id", F.concat_ws(":", "label", family)).withColumns({c: F.lit(0) for c in ("n_raw", "n_verified", "n_rejected")})


def core_budget(cap: int, reserved: dict[str, int]) -> int:
    """What a cap leaves for core queries after the reserved lanes."""
    return max(0, cap - sum(reserved.values()))


def within_budget(specs: DataFrame, lane: str, position: str, cap: int, reserved: dict[str, int], core: str = "core") -> DataFrame:
    """Core specs up to the core budget and each reserved lane's up to its reserve."""
    limits = {core: core_budget(cap, reserved), **reserved}
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(lane)]
    return specs.withColumn("_rn", F.row_number().over(Window.partitionBy(lane).orderBy(position))).where(F.col("_rn") <= limit).drop("_rn")


def fallback_feed(url: Column, host: Column, proxy: str) -> Column:
    """The proxy's search of the host, for a feed that isn't the proxy's own already."""
    return F.when(F.startswith(url, F.lit(proxy)), None).otherwise(F.concat(F.lit(f"{proxy}?q=site:"), host))


def query_families(selections: DataFrame, key: str, kinds: str, families: DataFrame, implied: dict[str, str]) -> DataFrame:
    """``key, families`` of each selection of ``kinds`` (an array): the families that the dimension ``families(kind, family, position)`` has for them, in its order, then what those imply, each once."""
    chosen = selections.select(key, F.explode(kinds).alias("kind")).join(families, "kind").groupBy(key, "family").agg(F.min("position").alias("position"))
    listed = chosen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "family"))), lambda s: s["family"]).alias("families"))
    more = F.array_compact(F.array(*[F.when(F.array_contains("families", has), F.lit(adds)) for has, adds in implied.items()]))
    out = selections.select(key).join(listed, key, "left").withColumn("families", F.coalesce("families", F.expr("cast(array() as array<string>)")))
    return out.withColumn("families", F.array_distinct(F.concat("families", more)))


def feed_sources(parts: list[tuple[str, DataFrame]], wanted: set[str], address: str = "url") -> DataFrame:
    """The wanted dimensions of sources as one, ``part`` and ``ord`` by their order here; an address that several have is taken from the first."""
    ranked = [d.withColumn("part", F.lit(name)).withColumn("_part", F.lit(i)) for i, (name, d) in enumerate(parts) if name in wanted]
    every = reduce(DataFrame.unionByName, ranked)
    columns = [c for c in every.columns if c not in (address, "_part")]
    return every.groupBy(address).agg(F.min(F.struct("_part", "position", *[c for c in columns if c != "position"])).alias("_s")).select(address, *[F.col(f"_s.{c}").alias(c) for c in columns])


def fast_subset(sources: DataFrame, name: str, url: str, position: str, keywords: list[str], shared_hosts: list[str], most: int = 12) -> DataFrame:
    """Sources whose name or address has a keyword, one for each host (for each name on hosts that many share), the first by position; if there are none, the first ``most`` of all."""
    marks = "|".join(re.escape(k.lower()) for k in keywords) or "(?!)"
    host = domain(url)
    key = F.when(host.isin(*shared_hosts) | (host == ""), F.lower(name)).otherwise(host)
    some = sources.where(F.lower(F.concat_ws(" ", name, url)).rlike(marks))
    first = some.groupBy(key.alias("_key")).agg(F.min(F.struct(position, *[c for c in sources.columns if c != position])).alias("_s")).select(*[F.col(f"_s.{c}").alias(c) for c in sources.columns])
    return first if some.limit(1).count() else sources.orderBy(position).limit(most)
