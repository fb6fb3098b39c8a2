"""Landed inputs: feeds, search hits, pages and metadata as DataFrames.

Retrieval itself is outside: fetchers land JSON, text, HTML or Parquet in a
folder, and these readers give it columns, normalise it and say why an entry is
left out.  Nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates, hashing, text, urls
from gleaner.operators import gates

FEED = "title string, link string, summary string, published string, updated string, source struct<href: string, title: string>"
HIT = "title string, body string, href string, date string, published string, source string"
HIT_FIELDS = ("title", "body", "href", "date", "published", "source", "query", "route")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema, so no pass infers one; unreadable lines are rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``url, html`` of whole HTML files; the url is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries of landed RSS or Atom files, one row an item."""
    raw = spark.read.text(path, wholetext=True).withColumn("feed", F.input_file_name())
    items = raw.select("feed", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))).alias("pos", "item"))

    def tag(*names: str) -> Column:
        found = [F.nullif(F.regexp_extract("item", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1), F.lit("")) for n in names]
        return F.trim(F.regexp_replace(F.coalesce(*found), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("item", r'<link\b[^>]*href="([^"]*)"', 1), F.lit("")))
    source = F.struct(F.nullif(F.regexp_extract("item", r'<source\b[^>]*url="([^"]*)"', 1), F.lit("")).alias("href"), tag("source").alias("title"))
    return items.select("feed", "pos", tag("title").alias("title"), link.alias("link"), tag("description", "summary").alias("summary"), tag("pubDate", "published").alias("published"), tag("updated").alias("updated"), source.alias("source"))


def normalize_feed(entries: DataFrame, cutoff: str, topic: list[str], excluded: list[str], url_rules: dict, keep_undated: bool = True) -> DataFrame:
    """Entries with ``reject``, the first reason against each in a fixed order, null for those that stay.

    Of entries with equal titles or links the first stays; that needs an order,
    so it is left to ``dedupe.greedy_leaders`` over ``keys``.
    """
    date = F.coalesce(dates.publication_date("published"), dates.publication_date("updated"))
    body = F.concat_ws(" ", "title", "summary")
    rules = [
        ("empty_title", F.coalesce(F.trim("title"), F.lit("")) == ""),
        ("not_recent", ~dates.is_recent(date, F.lit(cutoff).cast("date"), keep_undated)),
        ("excluded_topic", text.contains_any(body, excluded)),
        ("off_topic", ~text.contains_any(body, topic)),
        ("url", urls.reject_reason("link", **url_rules).isNotNull()),
    ]
    keys = F.array_compact(F.array(F.concat(F.lit("title:"), text.normalize_title("title")), F.concat(F.lit("url:"), urls.canonical_key(F.col("link")))))
    summary = F.substring(text.clean_text("summary"), 1, 500)
    return entries.withColumns({"published_date": date, "summary": summary, "reject": gates.first_reason(rules), "keys": keys})


def normalize_hits(hits: DataFrame, first: str, last: str, slack_days: int, url_rules: dict) -> DataFrame:
    """Search hits with their date, ``ingest_id`` (the hash of what was given) and ``reject``: a bad url, or a date out of the period by more than the slack."""
    date = F.coalesce(dates.loose_date("date"), dates.loose_date("published"), dates.path_date("href"))
    late = (date < F.date_sub(F.lit(first).cast("date"), slack_days)) | (date > F.date_add(F.lit(last).cast("date"), slack_days))
    reason = F.coalesce(urls.reject_reason("href", **url_rules), F.when(gates.truth(late), "date"))
    given = hashing.ingest_id({c: F.col(c) for c in hits.columns if c in HIT_FIELDS})
    return hits.withColumns({"published_date": date, "domain": urls.domain("href"), "ingest_id": given, "reject": reason})


def parse_blocks(texts: DataFrame, column: str, carry: list[str], marker: str, labels: dict[str, str]) -> DataFrame:
    """Rows of a text that is cut by a marker line into blocks of labelled lines: a column for each label, null without its line."""
    parts = texts.select(*carry, F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), marker)).alias("pos", "_part")).where("pos > 0")
    line = lambda label: F.nullif(F.trim(F.regexp_extract("_part", rf"(?m)^[ \t]*{label}[ \t]*[:：][ \t]*(.*)$", 1)), F.lit(""))
    return parts.select(*carry, "pos", *[line(label).alias(name) for name, label in labels.items()])


def page_metadata(pages: DataFrame, html: str, names: list[str]) -> DataFrame:
    """``meta``: the page's named meta contents, ``json_ld``: its first JSON-LD that parses, ``canonical``: its canonical link."""

    def content(name: str) -> Column:
        either = rf"""(?is)<meta\b(?=[^>]*(?:name|property)\s*=\s*["']{name}["'])[^>]*content\s*=\s*["']([^"']*)["']"""
        return F.nullif(F.regexp_extract(html, either, 1), F.lit(""))

    found = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[content(n) for n in names])), lambda k, v: v.isNotNull())
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    json_ld = F.get(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()), 0)
    canonical = F.nullif(F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*rel\s*=\s*["']canonical["'])[^>]*href\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    return pages.withColumns({"meta": found, "json_ld": json_ld, "canonical": canonical})


def metadata_date(meta: Column, names: list[str]) -> Column:
    """``struct(value, confidence)``: the first full date among the named fields is of high confidence, else null is low."""
    found = F.coalesce(*[dates.publication_date(meta[n]) for n in names])
    return F.struct(found.alias("value"), F.when(found.isNotNull(), "high").otherwise("low").alias("confidence"))


def enrich(rows: DataFrame, key: str, tables: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """A cascade of left joins with landed tables (name, one row per key): of each column the first value that is known, and the table of the first that has the key."""
    out = rows
    for name, t in tables:
        side = t.select(F.col(key).alias(f"_{name}_key"), *[F.col(c).alias(f"_{name}_{c}") for c in columns])
        out = out.join(side, F.col(key) == F.col(f"_{name}_key"), "left")
    origin = F.coalesce(*[F.when(F.col(f"_{n}_key").isNotNull(), F.lit(n)) for n, _ in tables])
    merged = [F.coalesce(*[F.col(f"_{n}_{c}") for n, _ in tables]).alias(c) for c in columns]
    return out.select(*rows.columns, origin.alias("origin"), *merged)


def anchors(pages: DataFrame, html: str, carry: list[str]) -> DataFrame:
    """``href, label`` of the links of each page."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\b[^>]*href\s*=\s*["'][^"']+["'][^>]*>.*?</a>)"""), F.lit(1))
    link = pages.select(*carry, F.explode(found).alias("_a"))
    return link.select(*carry, F.regexp_extract("_a", r"""(?is)href\s*=\s*["']([^"']+)["']""", 1).alias("href"), text.clean_text("_a").alias("label"))


def best_link(links: DataFrame, key: str, title: str, href: str, label: str, stopwords: list[str], least: int = 2) -> DataFrame:
    """Per key the link whose label shares most words with the title, at least ``least``; then the shortest."""
    shared = F.size(F.array_intersect(text.meaningful_tokens(title, stopwords), text.meaningful_tokens(label, stopwords)))
    scored = links.withColumn("_shared", shared).where(F.col("_shared") >= least)
    return scored.groupBy(key).agg(F.min_by(F.struct(href, label), F.struct(-F.col("_shared"), F.length(href), F.col(href))).alias("_b")).select(key, "_b.*")


def write_records(rows: DataFrame, path: str, partition: str | None = None, form: str = "parquet") -> None:
    """Write rows as Parquet, JSON lines or text, by a partition column if named; existing data of the folder is replaced."""
    writer = rows.write.mode("overwrite").format(form)
    (writer.partitionBy(partition) if partition else writer).save(path)
