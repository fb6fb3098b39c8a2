"""Streams over landed files: tumbling counts and first-wins deduplication, with and without keyed state.

All run with the available-now trigger, which reads what has landed in
bounded micro-batches and stops, write Parquet exactly once and keep their
progress in a checkpoint folder, so a run that is cut off goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators import dedupe
from gleaner.scratch import scratch_path

#: How long a pair of title and url is remembered, and groups that the rows of one title are dealt over.
REMEMBERED_MS, GROUPS = 40 * 24 * 3600 * 1000, 16
PAIR = "ord long, title_key string, url_key string"


def read_landed(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single file's folder by its name."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # a table may be a folder of files or one file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return not (len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rpartition("/")[2]))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that has landed and return what it wrote."""
    spark, folder = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def first_events(spark: SparkSession, path: str) -> DataFrame:
    """One row of each user, type and hour.

    Each micro-batch writes its distinct keys under its number, and the
    distinct of all is taken when read: no state is held, and no lateness
    bound decides what counts.
    """
    folder, keys = scratch_path(spark, "stream"), ["user_id", "event_type", "hour"]
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    stream = read_landed(spark, path).withColumn("hour", hour).select(*keys)

    def write(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*keys).distinct()


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events and their value by day and type.

    Each micro-batch writes its partial sums under its number, so one that is
    repeated overwrites its own; the sums are added up when read. No
    state is held, and late events count whenever they come.
    """
    folder = scratch_path(spark, "stream")
    stream = read_landed(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    sums = spark.read.parquet(f"{folder}/out")
    return sums.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


class FirstOfPair(StatefulProcessor):
    """For each title a map of its urls to the least ordinal seen with both; what is new or earlier than before is passed on.

    An entry lives for ``ttl_ms`` after it was last written.  A pair that comes
    again later is passed on once more, which changes no result: the least
    ordinal of each pair is taken when the stream's output is read.
    """

    def __init__(self, ttl_ms: int = REMEMBERED_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "url string", "ord long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for url, at in pdf.groupby("url_key")["ord"].min().items():
                known = self.first.getValue((url,)) if self.first.containsKey((url,)) else None
                if known is None or at < known[0]:
                    self.first.updateValue((url,), (int(at),))
                    out.append((int(at), key[0], url))
        if out:
            yield pd.DataFrame(out, columns=["ord", "title_key", "url_key"])

    def close(self) -> None:
        pass


def first_wins(stream: DataFrame, ttl_ms: int = REMEMBERED_MS) -> DataFrame:
    """``ord, title_key, url_key`` of the rows of a stream ``ord, title_key, url_key`` that stay: a row goes if one that stays before it, by ``ord``, has its title or its url.

    State is kept by title and a hash of the url, so the rows of one title are
    dealt over ``GROUPS`` groups; it reduces the stream to its distinct pairs,
    over which the greedy run is made.  So the result is that of a batch,
    however files come.  Null and empty keys are no keys.
    """
    spark, folder = stream.sparkSession, scratch_path(stream.sparkSession, "first-wins")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    title, url = (F.coalesce(c, F.lit("")) for c in ("title_key", "url_key"))
    # a row without either key is a pair of its own
    own = F.when((title == "") & (url == ""), F.concat(F.lit("row "), F.col("ord").cast("string"))).otherwise(url)
    known = stream.select(F.col("ord").cast("long").alias("ord"), title.alias("title_key"), own.alias("url_key"))
    grouped = known.withColumn("salt", F.pmod(F.xxhash64("url_key"), F.lit(GROUPS))).groupBy("title_key", "salt")
    firsts = grouped.transformWithStateInPandas(statefulProcessor=FirstOfPair(ttl_ms), outputStructType=PAIR, outputMode="Update", timeMode="ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = firsts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    # state that expires by the clock asks for batches without data for ever: the first such batch is the end
    while not query.awaitTermination(0.2):
        last = query.lastProgress
        if last and last["sources"] and all(source["startOffset"] == source["endOffset"] for source in last["sources"]):
            query.stop()
    pairs = spark.read.schema(PAIR).parquet(f"{folder}/out").groupBy("title_key", "url_key").agg(F.min("ord").alias("ord"))
    keys = F.array_compact(F.array(*[F.concat(F.lit(f"{n}:"), F.nullif(F.col(f"{n}_key"), F.lit(""))) for n in ("title", "url")]))
    leaders = dedupe.greedy_leaders(pairs.withColumn("keys", keys), "keys", "ord").where("ord = leader_ord").select("ord")
    shown = F.when(F.col("url_key") == F.concat(F.lit("row "), F.col("ord").cast("string")), "").otherwise(F.col("url_key"))
    return pairs.join(leaders, "ord").select("ord", "title_key", shown.alias("url_key"))
