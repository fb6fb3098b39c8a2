"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import embeddings, filter_audit, jaccard, lm, mixing, packing, periodic, pii, quality, secrets, token_store, toxicity, warc
from gleaner.llm.tokenizer_files import BYTE_TOKENIZER, WORD_TOKENIZER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4,096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    return lm.score(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents at their sources' repetition rates."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs), drop=True)
    counts = [F.size(pii.of_kinds((k,))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    sha = F.sha2(pii.joined(pii.of_kinds(pii.BASE)).cast("binary"), 256)
    return found.select("doc_id", *counts, sha.alias("base_sha256"), pii.joined(F.col("_spans")).alias("spans"))


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: links and groups, one row per document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, written to archives and read back."""
    captures = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "refers_to")


def op8_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; the host of a document is its source."""
    q = quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = [F.col(f"_quality.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return q.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op9_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a document is a repository, its source the owner."""
    found = secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "source", ["doc_id"])
    base = F.filter("_spans", lambda s: s["rank"] < len(secrets.BASE))
    counts = [secrets.count_of(k).alias(f"n_{k.name}") for k in secrets.BASE]
    sha = F.sha2(secrets.joined(base).cast("binary"), 256)
    return found.select("doc_id", *counts, sha.alias("base_sha256"), secrets.joined(F.col("_spans")).alias("spans"), *secrets.COUNTS)


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings: links and components, one row per vector."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, with repetitions planted in a tenth of them."""
    found = periodic.collapse_runs(table(spark, sf_dir, "documents"), carry=["doc_id"], rewrite=periodic.planted_repeats)
    best = found.withColumn("_best", periodic.strongest())
    numbers = [F.col(f"_best.{n}").alias(n) for n in ("start", "length", "period")]
    exponent = F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli")
    digests = [F.sha2(x.cast("binary"), 256).alias(n) for x, n in ((periodic.listed(), "runs_sha256"), (F.col("_collapsed"), "collapsed_sha256"))]
    return best.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), *numbers, exponent, *digests)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents in each order, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in Arrow files, read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_windows,
        op2_deleted_interpolation,
        op3_mix_sources,
        op4_toxicity_fm,
        op5_personal_data,
        op6_jaccard_links,
        op7_warc_captures,
        op8_quality_hosts,
        op9_secret_owners,
        op10_embedding_links,
        op11_periodic_runs,
        op12_filter_audit,
        op13_arrow_sequences,
    )
} | {"pipeline": corpus_pipeline.run}

def _secret_spans(rank: int, kind: secrets.Kind) -> str:
    """SQL of one kind's spans: ``rid, rank, kind, start, stop, value``."""
    pattern = kind.pattern.replace("'", "''")
    return f"""
  SELECT rid, {rank} AS rank, '{kind.name}' AS kind, start, start + length(whole) AS stop, value FROM (
    SELECT rid, whole[i] AS whole, value[i] AS value, (list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT rid, string_split_regex(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {kind.group}) AS value FROM d WHERE regexp_matches(t, '{pattern}')))
  ) WHERE length(value) >= {kind.least}"""


# md5 hashes are the same in both engines; the least k with cdf(k) > u is the number of cdf values that are at most u
ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT sum(size)::DOUBLE FROM sizes) * pow(size::DOUBLE, 0.5)
    / (SELECT sum(pow(size::DOUBLE, 0.5)) FROM sizes) / size AS rate FROM sizes
), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 20)
), steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source), drawn AS (
  SELECT d.*, len(list_filter(s.cs, lambda c: c <= ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy_no FROM drawn
""",
    "op6_jaccard_links": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1), c AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL
), links AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1), f AS (SELECT r.a, min(v.doc_id) AS class_id FROM reach r JOIN w v ON v.rid = r.b GROUP BY 1)
SELECT doc_id, coalesce(n_links, 0)::BIGINT AS n_links, class_id, doc_id = class_id AS kept FROM w JOIN f ON f.a = rid LEFT JOIN k ON k.a = rid
""",
    "op9_secret_owners": f"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(_secret_spans(r, k) for r, k in enumerate(secrets.KINDS))}
), own AS (SELECT value, count(DISTINCT coalesce('x' || source, '')) AS n_owners, (count(DISTINCT coalesce('x' || doc_id, '') || coalesce('/x' || source, '')))::BIGINT AS n_repositories FROM spans JOIN d USING (rid) GROUP BY 1), each AS (SELECT DISTINCT rid, value FROM spans), judged AS (
  SELECT rid, count(*) FILTER (n_owners = 1 AND n_repositories < {secrets.SHARED_REPOSITORIES} AND len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_CHARACTERS}) AS n_live, count(*) FILTER (n_owners >= {secrets.SHARED_OWNERS} OR n_repositories >= {secrets.SHARED_REPOSITORIES}) AS n_shared, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM each JOIN own USING (value) GROUP BY 1
), agg AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in secrets.BASE)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY 1
)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN agg USING (rid) LEFT JOIN judged USING (rid)
""",
    "op7_warc_captures": """
WITH digests AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages
), named AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * (i // 4))::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest
  FROM digests
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original IS NULL OR page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM firsts
""",
    "op10_embedding_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op8_quality_hosts": r"""
WITH words AS (
  SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT rid, unnest(ls) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2
), rep AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS p FROM twice, range(3) AS r(j)) GROUP BY rid
), counted AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words AS a, 100 * n_dup_lines > 30 * n_lines AS b, word_chars < 2 * n_words AS c, word_chars > 15 * n_words AS d FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR a OR b OR c OR d) AS bad FROM ruled GROUP BY source
), moments AS (SELECT avg(bad / n) AS m, greatest(var_pop(bad / n) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n), 0) AS v FROM hosts), prior AS (
  SELECT m, CASE WHEN v * 10001 <= m * (1 - m) THEN 10000.0::DOUBLE ELSE greatest(1.0::DOUBLE, m * (1 - m) / v - 1) END AS s FROM moments
), verdicts AS (SELECT source, (bad + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rate * (1 + CASE WHEN NOT (a OR b OR c OR d) THEN 0.1::DOUBLE ELSE
    CASE WHEN a THEN 9.0::DOUBLE * (10 * n_symbols / n_words) ELSE 1 END * CASE WHEN b THEN 3.0::DOUBLE * (100 * n_dup_lines / (30 * n_lines)) ELSE 1 END
    * CASE WHEN c THEN 9.0::DOUBLE * (2 * n_words / word_chars) ELSE 1 END * CASE WHEN d THEN 9.0::DOUBLE * (word_chars / (15 * n_words)) ELSE 1 END END) > 1 AS kept
FROM ruled r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
""",
    "op12_filter_audit": r"""
WITH RECURSIVE orders(filter_order) AS (
  SELECT ''
  UNION ALL
  SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE length(filter_order) < 5 AND NOT contains(filter_order, f)
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > f.least THEN 'E' ELSE '' END AS failed
  FROM d JOIN firsts f USING (t) LEFT JOIN marks m ON m.doc_id = d.doc_id
), sets AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, failed
), cells AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, failed, n, good, toxic, contains(failed, substr(filter_order, step, 1)) AS hit,
    len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda c: c <> '' AND contains(failed, c))) > 0 AS gone
  FROM sets, orders, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(filter_order) = 5
), sums AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM cells GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM sums
""",
}
