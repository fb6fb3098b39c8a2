"""Queries of selection, diagnostics, reports and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import diagnostics, report, select
from gleaner.plans.common import composed, number, table

#: Turns whose blocks make one text.
COMPOSED = 100
PRIORITIES = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"]


def k4_per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 longest documents of each source: a top-k report."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return select.per_group(d, "source", [F.desc("size"), F.asc("doc_id")], 25)


def k6_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 orders, one of each priority in turn: a top-k report."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return select.round_robin(o, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], {p: i for i, p in enumerate(PRIORITIES)}, 200)


def k9_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers above a balance, filled up from the next best: at most 40 of them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    chosen = c.where((F.col("c_acctbal") > 9000) & (F.col("c_mktsegment") == "MACHINERY"))
    return select.backfill(chosen, c.where("c_acctbal > 5000"), "c_custkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 60, 40)


def k12_budget_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return select.budget_lanes(e, "event_type", [F.desc("value"), F.asc("event_id")], {"error": 15, "purchase": 10}, 25)


def k13_route_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the longest of each source first, sources in the order of their first document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return select.interleave(d, "source", [F.desc("size"), F.asc("doc_id")], "doc_id").select("doc_id", "source", F.col("pick").cast("long").alias("pick"))


def k7_diverse_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 parts of each brand, spread over types and sizes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 5).alias("band"), "p_retailprice")
    return select.diverse(p, "p_brand", "p_retailprice", ["p_type", "band"], 12, 100.0, "p_partkey")


def k10_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 dearest orders of each priority, quarters without one taking the place of second ones of near price, at most 60 % of them of the last years."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.quarter("o_orderdate").alias("quarter"), "o_totalprice", (F.year("o_orderdate") >= 1997).alias("recent"))
    return select.rebalance(o, "o_orderpriority", "quarter", "o_totalprice", 12, 20000.0, "o_orderkey", "recent")


def k14_source_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 documents of each language, with a bonus for a source that is new."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").cast("double").alias("size"))
    return select.source_diverse(d, "lang", "size", "source", 10, 4000.0, "doc_id")


def a4_map_explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.create_map(F.lit("even"), number() % 2 == 0, F.lit("high"), number() > 50, F.lit("tail"), number() >= 90).alias("flags"))
    return diagnostics.enabled_key_counts(e, "flags", ["event_type"])


def a6_route_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("route"), F.date_trunc("week", "ts").cast("date").alias("bucket"), "event_type")
    return diagnostics.status_pivot(e, ["route", "bucket"], "event_type", ["view", "click", "purchase", "signup", "error"])


def a9_empty_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of months without an order above a price, on the whole calendar."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 497000")
    months = diagnostics.months_with_gaps(o, F.col("o_orderdate").cast("date"), "1995-01-01", "2001-08-01")
    ordinal = F.year("month") * 12 + F.month("month")
    return diagnostics.streaks(months, [], "month", ordinal, F.col("n") == 0)


def a11_gate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that neighbouring turns of a conversation gain or lose."""
    gates = lambda c: F.create_map(F.lit("long"), F.length(c) > 100, F.lit("lines"), F.contains(c, F.lit("\n")), F.lit("digits"), c.rlike(r"\d"))
    c = table(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("a")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    changes = a.join(b, ["conv_id", "turn"]).select(F.explode(diagnostics.gate_changes(gates(F.col("a")), gates(F.col("b")))).alias("change"))
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def a13_variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.length("text") < 300).alias("empty"), F.col("text").contains("License").alias("copied"))
    d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return diagnostics.variant_metrics(d, "source", F.col("quality") == 1, F.col("quality").isNotNull(), F.col("empty"), F.col("copied"))


def j9_id_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations against expected ones: every number up to the last, the third left out, one more at the end."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    shown = c.where("turn <> 2").unionByName(c.where("turn = 1 AND conv_id % 5 = 0"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    expected = last.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0))).alias("turn"))
    return report.id_integrity(shown, expected, ["conv_id"], "turn")


def o6_quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's passage whole, white space collapsed."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = report.find_quotes(table(spark, sf_dir, "documents"), "text", ["doc_id"], quotes, "quote", "item_id")
    return found.select("doc_id", F.col("quote_key").alias("item_id"))


def _report_blocks(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    block = F.concat(F.lit("<!-- candidate_id: "), (F.col("turn") * 10).cast("string"), F.lit(" -->\n"), F.coalesce(body, F.lit("")))
    texts, before = composed(table(spark, sf_dir, "conversations"), "conv_id", "turn", block, "\n", COMPOSED)
    found = report.blocks(texts.withColumn("text", F.concat(F.lit("Heading\n"), "text")), "text", ["conv_id", "bucket"])
    return found.join(before, ["conv_id", "bucket"]).select("conv_id", (F.col("pos") + F.col("before")).alias("pos"), "candidate_id", F.length("block").alias("size"))


def o13_report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of reports composed of a conversation's turns, white space collapsed."""
    return _report_blocks(spark, sf_dir, F.trim(F.regexp_replace("text", r"\s+", " ")))


def o13_whole_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of reports composed of a conversation's whole turns."""
    return _report_blocks(spark, sf_dir, F.col("text"))


def o6_claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on orders whose lines are claims, supported by their ship date."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.month("l_shipdate") <= 9).alias("supported"))  # noqa: E741
    v = report.verdict(l, "l_orderkey", "supported")
    return v.groupBy("verdict").agg(F.count("*").alias("n_orders"), F.sum("n_claims").alias("n_claims"))


def t5_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, type and hour, by a stream over the table's files that ends when they are read."""
    from gleaner.streaming.dedupe import first_events

    return first_events(spark, f"{sf_dir}/events.parquet")


def t1_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, by a stream over the table's files."""
    from gleaner.streaming.dedupe import daily_counts

    return daily_counts(spark, f"{sf_dir}/events.parquet")


QUERIES = {f.__name__: f for f in (k4_per_source_cap, k6_round_robin, k7_diverse_pick, k9_backfill, k10_rebalance, k12_budget_lanes, k13_route_interleave, k14_source_diverse, a4_map_explode_counts, a6_route_status_pivot, a9_empty_streak, a11_gate_changes, a13_variant_metrics, j9_id_integrity, o6_quote_grounding, o6_claim_verdicts, o13_report_blocks, o13_whole_blocks, t1_stream_windows, t5_stream_dedupe)}

_K = "(props->>'k')::INTEGER"
ORACLE_SQL = {
    "k4_per_source_cap": "SELECT doc_id, source, length(text)::INTEGER AS size FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) <= 25",
    "k6_round_robin": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn, list_position({PRIORITIES}, o_orderpriority) AS pos FROM orders)
SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY rn, pos)::INTEGER AS pick FROM r QUALIFY pick <= 200""",
    "k9_backfill": """
WITH c AS (SELECT * FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'MACHINERY'),
p AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT c_custkey FROM c))
SELECT c_custkey, c_acctbal, c_mktsegment, false AS filled FROM c UNION ALL
SELECT c_custkey, c_acctbal, c_mktsegment, true FROM p WHERE rn <= greatest(0, least(40, 60 - (SELECT count(*) FROM c)))""",
    "k12_budget_lanes": """
WITH e AS (SELECT event_id, event_type, value, CASE event_type WHEN 'error' THEN 15 WHEN 'purchase' THEN 10 END AS budget FROM events)
SELECT event_id, event_type, value, event_type AS budget_lane FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM e WHERE budget IS NOT NULL) WHERE rn <= budget
UNION ALL SELECT * FROM (SELECT event_id, event_type, value, 'general' FROM e WHERE budget IS NULL ORDER BY value DESC, event_id LIMIT 25)""",
    "k13_route_interleave": """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY rn, f, source) AS pick FROM r""",
    "a4_map_explode_counts": " UNION ALL ".join(f"SELECT event_type, '{n}' AS key, count(*) AS n FROM events WHERE {c} GROUP BY 1" for n, c in (("even", f"{_K} % 2 = 0"), ("high", f"{_K} > 50"), ("tail", f"{_K} >= 90"))),
    "a6_route_status_pivot": "SELECT user_id % 12 AS route, date_trunc('week', ts)::DATE AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "click", "purchase", "signup", "error")) + " FROM events GROUP BY 1, 2",
    "a9_empty_streak": """
WITH m AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH))::DATE AS month), c AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_totalprice > 497000 GROUP BY 1),
e AS (SELECT m.month, year(m.month) * 12 + month(m.month) AS o FROM m LEFT JOIN c ON c.month = m.month WHERE n IS NULL), i AS (SELECT *, o - row_number() OVER (ORDER BY month) AS g FROM e)
SELECT min(month) AS start, count(*) AS length FROM i GROUP BY g""",
    "a11_gate_changes": r"""
WITH c AS (SELECT conv_id, turn, list_filter([CASE WHEN length(text) > 100 THEN 'long' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END, CASE WHEN regexp_matches(text, '\d') THEN 'digits' END], lambda x: x IS NOT NULL) AS g FROM conversations),
p AS (SELECT a.g AS a, b.g AS b FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT unnest(list_concat(list_transform(list_filter(b, lambda g: NOT list_contains(a, g)), lambda g: 'gained:' || g), list_transform(list_filter(a, lambda g: NOT list_contains(b, g)), lambda g: 'lost:' || g))) AS change FROM p)
SELECT change, count(*) AS n FROM x GROUP BY 1""",
    "a13_variant_metrics": """
SELECT source, count(*) AS n, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 4) AS precision, round(count(*) FILTER (quality <> 1) / nullif(count(quality), 0), 4) AS contamination,
  round(count(*) FILTER (length(text) < 300) / count(*), 4) AS empty_rate, round(count(*) FILTER (contains(text, 'License')) / count(*), 4) AS duplicate_rate, count(*) < 10 OR count(quality) < 5 AS low_sample
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "j9_id_integrity": """
WITH shown AS (SELECT conv_id, turn FROM conversations WHERE turn <> 2 UNION ALL SELECT conv_id, turn FROM conversations WHERE turn = 1 AND conv_id % 5 = 0), n AS (SELECT conv_id, turn, count(*) AS n FROM shown GROUP BY ALL),
l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), want AS (SELECT conv_id, unnest(range(0, last + 1 - CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END)) AS turn FROM l)
SELECT coalesce(n.conv_id, w.conv_id) AS conv_id, coalesce(n.turn, w.turn) AS turn, CASE WHEN n.n IS NULL THEN 'missing' WHEN w.conv_id IS NULL THEN 'unknown' ELSE 'duplicate' END AS issue
FROM n FULL JOIN want w ON n.conv_id = w.conv_id AND n.turn = w.turn WHERE n.n IS NULL OR w.conv_id IS NULL OR n.n > 1""",
    "o6_quote_grounding": r"""
WITH q AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, item_id FROM d JOIN q ON q <> '' AND contains(t, q)""",
    "o6_claim_verdicts": """
WITH v AS (SELECT l_orderkey, bool_and(month(l_shipdate) <= 9) AS a, bool_or(month(l_shipdate) <= 9) AS o, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CASE WHEN a THEN 'supported' WHEN NOT o THEN 'unsupported' ELSE 'mixed' END AS verdict, count(*) AS n_orders, sum(n)::BIGINT AS n_claims FROM v GROUP BY 1""",
    "o13_report_blocks": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS pos, turn * 10 AS candidate_id, length(trim(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g')))::INTEGER AS size FROM conversations",
    "o13_whole_blocks": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS pos, turn * 10 AS candidate_id, length(regexp_replace(coalesce(text, ''), '^[\\s]+|[\\s]+$', '', 'g'))::INTEGER AS size FROM conversations",
    "t1_stream_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "t5_stream_dedupe": "SELECT user_id, event_type, date_trunc('hour', ts) AS hour FROM events GROUP BY ALL",
}
