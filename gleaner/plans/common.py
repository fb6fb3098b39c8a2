from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number() -> Column:
    """The number k in the properties of an event."""
    return F.get_json_object("props", "$.k").cast("int")


def composed(rows: DataFrame, group: str, key: str, block: Column, separator: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Texts of blocks in the order of a whole number that is unique in its group, and the number of blocks before each: ``group, bucket, text`` and ``group, bucket, before``.

    A text has the blocks of at most ``size`` keys, however large the group is.
    """
    each = rows.select(group, F.floor(F.col(key) / size).alias("bucket"), key, block.alias("b"))
    texts = each.groupBy(group, "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "b"))), lambda s: s["b"]), separator).alias("text"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy(group, "bucket").agg(F.count("b").alias("n"))
    return texts, counts.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("before"))
