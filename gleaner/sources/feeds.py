"""Landed feeds as a Spark data source, the scan over all of them, and their first-wins stream.

``landed_feeds`` reads a manifest, JSON lines of ``FEED`` that say which feeds
there are and where what a fetcher landed for each lies, and makes partitions
of some feeds each.  A feed's file is RSS or Atom; one that is missing, empty or not
well-formed is bad.  A bad feed is read from its fallback address, but only
where its route has no period: what is asked for a period must not be answered
by something else.  A scan gives the entries and one row of status for each
feed; feeds that aren't wanted aren't opened.

Places are read by Arrow's file systems (a path, ``file://``, ``s3://``,
``gs://``, ``hdfs://``), by executors and, for the manifest, by the driver; a
manifest is configuration, one line a feed.  As a stream, a batch is what new
files of the manifest's folder list, in order of their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gleaner.functions import dates, text, urls
from gleaner.operators import dedupe, gates
from gleaner.scratch import materialize, scratch_path

FEED = "ord long, source string, path string, fallback string, period string, known_bad boolean"
ENTRY = ["title", "link", "summary", "published", "updated", "source_href"]
SCHEMA = "ord long, source string, kind string, pos int, status string, message string, used string, " + ", ".join(f"{c} string" for c in ENTRY)
#: Lines that a manifest may have; it is read by the driver.
MOST_FEEDS = 1_000_000
#: Tasks that read a manifest's feeds, at most.
TASKS = 256


class BadFeed(Exception):
    """A feed that can't be read: ``status`` is what is wrong with it."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


@dataclass
class Feed:
    ord: int
    source: str
    path: str
    fallback: str | None = None
    period: str | None = None
    known_bad: bool = False
    kinds: tuple[str, ...] = ("feed", "entry")


@dataclass
class Feeds(InputPartition):
    """Feeds that one task reads, one after another."""

    feeds: list[Feed]


def dealt(feeds: list[Feed]) -> list[Feeds]:
    """The feeds in at most ``TASKS`` tasks, of which each starts a worker."""
    n = min(TASKS, len(feeds))
    return [Feeds(feeds[k::n]) for k in range(n)]


def _opened(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def _files(place: str) -> tuple[fs.FileSystem, list[str]]:
    """The file, or the files of a folder by name; those that begin with _ or . are none."""
    system, path = _opened(place)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "_.")
    return system, [path] if info.type == fs.FileType.File else []


def _bytes(place: str) -> bytes:
    """What lies at a place; of a folder, its last file."""
    system, files = _files(place)
    if not files:
        raise BadFeed("missing", f"nothing at {place}")
    with system.open_input_stream(files[-1]) as f:
        data = f.read()
    if not data.strip():
        raise BadFeed("empty", f"nothing in {place}")
    return data


def parse_feed(data: bytes) -> list[dict[str, str | None]]:
    """The entries of an RSS or Atom file, by ``ENTRY``."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise BadFeed("unreadable", str(e)) from None
    local = lambda e: e.tag.rpartition("}")[2].lower()
    out = []
    for item in root.iter():
        if local(item) not in ("item", "entry"):
            continue
        found: dict[str, ElementTree.Element] = {}
        for child in item:
            found.setdefault(local(child), child)
        words = lambda *names: next(("".join(found[n].itertext()).strip() for n in names if n in found), None)  # noqa: B023, E731
        href = lambda n, a: found[n].get(a) if n in found else None  # noqa: B023, E731
        out.append({"title": words("title"), "link": words("link") or href("link", "href"), "summary": words("summary", "description", "content"), "published": words("pubdate", "published"), "updated": words("updated"), "source_href": href("source", "url")})
    return out


def read_feed(feed: Feed) -> tuple[str, str | None, str | None, list[dict]]:
    """``status, message, used, entries``: of the feed, else of its fallback where there is no period."""
    if feed.known_bad:
        return "known_bad", None, None, []
    try:
        return "read", None, feed.path, parse_feed(_bytes(feed.path))
    except BadFeed as first:
        if feed.period or not feed.fallback:
            return first.status, str(first), None, []
        try:
            return "fallback", str(first), feed.fallback, parse_feed(_bytes(feed.fallback))
        except BadFeed as second:
            return first.status, f"{first}; fallback: {second}", None, []


def _rows(feed: Feed) -> pa.RecordBatch:
    status, message, used, entries = read_feed(feed)
    kept = entries if "entry" in feed.kinds else []
    head = 1 if "feed" in feed.kinds else 0
    n = len(kept) + head
    columns = {
        "ord": pa.array([feed.ord] * n, pa.int64()), "source": [feed.source] * n, "kind": ["feed"] * head + ["entry"] * len(kept), "pos": pa.array(range(1 - head, len(kept) + 1), pa.int32()),
        "status": [status] * n, "message": [message] * n, "used": [used] * n, **{c: [None] * head + [e[c] for e in kept] for c in ENTRY},
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns.values()], names=list(columns))


def manifest_feeds(files: list[str], system: fs.FileSystem) -> list[Feed]:
    feeds = []
    for path in files:
        with system.open_input_stream(path) as f:
            for line in f.read().decode().splitlines():
                if line.strip():
                    one = json.loads(line)
                    feeds.append(Feed(one["ord"], one["source"], one["path"], one.get("fallback"), one.get("period"), bool(one.get("known_bad"))))
    if len(feeds) > MOST_FEEDS:
        raise ValueError(f"a manifest of at most {MOST_FEEDS} feeds is wanted, this one has {len(feeds)}")
    return feeds


class FeedReader(DataSourceReader):
    """Which feeds and kinds of rows are wanted are options.

    Conditions aren't taken from Spark: it keeps what one query has pushed down
    with the relation, so that a DataFrame filtered twice, in one query or in
    two, would lose rows.
    """

    def __init__(self, options: dict[str, str]):
        self.manifest = options["manifest"]
        self.sources, self.kinds = (set(json.loads(options[n])) if n in options else None for n in ("sources", "kinds"))

    def partitions(self) -> list[Feeds]:
        system, files = _files(self.manifest)
        feeds = [f for f in manifest_feeds(files, system) if self.sources is None or f.source in self.sources]
        for f in feeds:
            f.kinds = tuple(k for k in f.kinds if self.kinds is None or k in self.kinds)
        return dealt(feeds)

    def read(self, partition: Feeds) -> Iterator[pa.RecordBatch]:
        yield from map(_rows, partition.feeds if partition else [])


class FeedStreamReader(DataSourceStreamReader):
    """Offsets count the manifest's files; feeds are read by executors."""

    def __init__(self, options: dict[str, str]):
        self.manifest = options["manifest"]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.manifest)[1])}

    def partitions(self, start: dict, end: dict) -> list[Feeds]:
        system, files = _files(self.manifest)
        return dealt(manifest_feeds(files[start["files"] : end["files"]], system))

    def read(self, partition: Feeds) -> Iterator[pa.RecordBatch]:
        yield from map(_rows, partition.feeds)


class LandedFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def read_feeds(spark: SparkSession, manifest: str, sources: Iterable[str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    """The rows of the feeds of a manifest; of ``sources`` only (no other feed is opened), and of ``kinds`` (feed, entry) only, if given."""
    spark.dataSource.register(LandedFeeds)
    wanted = {n: json.dumps(sorted(v)) for n, v in (("sources", sources), ("kinds", kinds)) if v is not None}
    return spark.read.format("landed_feeds").options(manifest=manifest, **wanted).load()


def stream_feeds(spark: SparkSession, manifest: str) -> DataFrame:
    spark.dataSource.register(LandedFeeds)
    return spark.readStream.format("landed_feeds").option("manifest", manifest).load()


@dataclass
class Scan:
    entries: DataFrame
    statuses: DataFrame


def scan(feeds: DataFrame, cutoff: Column, on_topic: Callable[[Column], Column], excluded: Callable[[Column], Column], url_rules: dict, most: int = 12, stride: int = 1_000_000) -> Scan:
    """The scan of the rows of ``read_feeds``, each of which is read once: entries with the first reason against them, and a status for each feed.

    Entries are taken in the order of feeds and of their places; one whose
    title or url an entry taken before has is a duplicate, whichever feed that
    is of.  Of what a feed has left, its first ``most`` are given.  A feed's
    places are below ``stride``.
    """
    feeds = materialize(feeds, "feeds")
    date = F.coalesce(dates.publication_date("published"), dates.publication_date("updated"))
    body, reason = F.concat_ws(" ", "title", "summary"), urls.reject_reason("link", **url_rules)
    rules = [
        ("empty_title", F.coalesce(F.trim("title"), F.lit("")) == ""), ("not_recent", ~dates.is_recent(date, cutoff, True)), ("off_topic", excluded(body) | ~on_topic(body)),
        ("blocked", F.coalesce(reason.startswith("blocked"), F.lit(False))), ("invalid", reason.isNotNull()),
    ]
    at = (F.col("ord") * stride + F.col("pos")).alias("at")
    entries = feeds.where(F.col("kind") == "entry").select(at, "ord", "source", "pos", "title", "link", F.substring(text.clean_text("summary"), 1, 500).alias("summary"), date.alias("published_date"), gates.first_reason(rules).alias("reject"))
    keys = F.array_compact(F.array(*[F.concat(F.lit(n), F.nullif(k, F.lit(""))) for n, k in (("title:", text.normalize_title("title")), ("url:", urls.dedupe_url("link")))]))
    held = entries.withColumn("keys", F.when(F.col("reject").isNull(), keys))
    taken = dedupe.greedy_leaders(held.where("reject IS NULL"), "keys", "at").select(F.col("at").alias("_at"), F.col("leader_ord").alias("first"))
    judged = held.join(taken, F.col("at") == F.col("_at"), "left").drop("_at", "keys")
    judged = judged.withColumn("reject", F.coalesce("reject", F.when(F.col("first") != F.col("at"), "duplicate")))
    kept = F.col("reject").isNull()
    place = F.count_if(kept).over(Window.partitionBy("ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumn("reject", F.when(kept & (place > most), "over").otherwise(F.col("reject")))
    count = lambda name: F.count_if(F.col("reject") == name).alias(f"n_{name}")
    names = ["off_topic", "invalid", "blocked", "duplicate"]
    counts = judged.groupBy(F.col("ord").alias("_ord")).agg(F.count_if(F.col("reject").isNull()).alias("n_entries"), *[count(n) for n in names])
    heads = feeds.where(F.col("kind") == "feed").select("ord", "source", "status", "message", "used")
    met = heads.join(counts, F.col("ord") == F.col("_ord"), "left").fillna(0, ["n_entries", *[f"n_{n}" for n in names]])
    none = (
        F.when((F.col("n_off_topic") > 0) & (F.col("n_invalid") == 0) & (F.col("n_blocked") == 0), "off_topic")
        .when((F.col("n_blocked") > 0) & (F.col("n_invalid") == 0), "blocked").otherwise("no_entries")
    )
    status = F.when(~F.col("status").isin("read", "fallback"), F.col("status")).when(F.col("n_entries") == 0, none).when(F.col("status") == "fallback", "fallback_ok").otherwise("ok")
    return Scan(judged.drop("at", "first"), met.select("ord", "source", status.alias("status"), (F.col("status") == "fallback").alias("by_fallback"), "n_entries", *[f"n_{n}" for n in names], "message"))


def land(spark: SparkSession, texts: DataFrame, feeds: DataFrame, tag: str = "feeds") -> str:
    """Write ``texts(folder, value)`` as one file for each folder, and the manifest ``feeds`` with paths from there; the manifest's place."""
    folder = scratch_path(spark, tag)
    texts.repartition("folder").write.partitionBy("folder").option("lineSep", "\n\n").text(f"{folder}/files")
    place = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{folder}/files/folder="), F.col(c)))
    feeds.withColumns({"path": place("path"), "fallback": place("fallback")}).write.json(f"{folder}/manifest")
    return f"{folder}/manifest"
