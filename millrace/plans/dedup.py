"""Near-duplicate and work-reuse queries, and the whole near-duplicate job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.ngrams import dedup_tokens, ngram_set, sha1_heads
from millrace.operators import neardup, profile, select
from millrace.operators.minhash import (
    HASH_MASK,
    PRIME,
    THRESHOLD,
    band_plan,
    permutations,
    signature_words,
)
from millrace.operators.reuse import evaluate_once, program_text
from millrace.plans.mix import build_mix
from millrace.plans.mixing import MIX_SQL, MIX_TARGETS, mix_sources
from millrace.plans.registry import joined, query, rounded, table

SAMPLE_SEED = 77
# Fewer permutations than the default of the job, so that plain SQL can follow.
SHORT_PERM = 64


def deduplicate(
    df: DataFrame, key: str, text: str, num_samples: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """The kept rows and a one-row report; optionally on a random sample of the rows."""
    rows = select.random_rows(df, key, num_samples, SAMPLE_SEED)
    kept = neardup.without_near_duplicates(rows, key, text, **options)
    return kept, profile.before_after(rows, kept)


def _permutation_rows(num_perm: int) -> str:
    mult, add = permutations(num_perm)
    return ", ".join(f"({i}, {int(a)}, {int(b)})" for i, (a, b) in enumerate(zip(mult, add)))


TOKENS_SQL = "toks AS (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-z_0-9]') AS t FROM documents)"
GRAMS_SQL = f"""{TOKENS_SQL}, sets AS (SELECT doc_id, len(t) AS n_tokens,
  list_distinct(list_transform(range(1, greatest(len(t) - 3, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] || ' ' || t[i + 4])) AS g FROM toks)"""
HASH_SQL = """hashes AS (SELECT doc_id, CAST('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS BIGINT) AS h
  FROM (SELECT doc_id, sha1(g) AS x FROM (SELECT doc_id, unnest(g) AS g FROM sets)))"""


def signature_sql(num_perm: int) -> str:
    # The product modulo 2^64, then modulo the prime 2^61 - 1 by folding the top bits.
    return f"""{GRAMS_SQL}, {HASH_SQL}, perms(i, a, b) AS (VALUES {_permutation_rows(num_perm)}),
wrapped AS (SELECT doc_id, i, ((CAST(h AS HUGEINT) * a) + b) & 18446744073709551615 AS w FROM hashes, perms),
folded AS (SELECT doc_id, i, CAST(w & {PRIME} AS BIGINT) + CAST(w >> 61 AS BIGINT) AS f FROM wrapped),
found AS (SELECT doc_id, i, min((CASE WHEN f >= {PRIME} THEN f - {PRIME} ELSE f END) & {HASH_MASK}) AS s FROM folded GROUP BY doc_id, i),
sig AS (SELECT d.doc_id, p.i, coalesce(s, {HASH_MASK}) AS s FROM documents d CROSS JOIN perms p
  LEFT JOIN found f ON f.doc_id = d.doc_id AND f.i = p.i)"""


def cluster_sql(num_perm: int, threshold: float) -> str:
    bands, rows = band_plan(threshold, num_perm)
    return f"""{signature_sql(num_perm)},
members AS (SELECT doc_id, CAST(i // {rows} AS BIGINT) AS band, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS key FROM sig
  WHERE i < {bands * rows} GROUP BY doc_id, i // {rows}),
bucket AS (SELECT band, key, count(*) AS members, min(doc_id) AS low FROM members GROUP BY band, key HAVING count(*) > 1),
star AS (SELECT DISTINCT m.doc_id AS src, b.low AS dst FROM members m JOIN bucket b ON b.band = m.band AND b.key = m.key),
link AS (SELECT src, dst FROM star UNION SELECT dst, src FROM star),
reach AS (SELECT src AS id, dst AS other FROM link UNION SELECT r.id, l.dst FROM reach r JOIN link l ON l.src = r.other),
clusters AS (SELECT id, least(id, min(other)) AS cluster FROM reach GROUP BY id)"""


@query(f"WITH {GRAMS_SQL} SELECT doc_id, n_tokens, len(g) AS n_grams, list_min(g) AS first_gram FROM sets")
def ngram_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", dedup_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), ngram_set("t", 5).alias("g")).select(
        "doc_id", "n_tokens", F.size("g").cast("bigint").alias("n_grams"), F.array_min("g").alias("first_gram")
    )


@query(f"""
WITH {GRAMS_SQL}, {HASH_SQL} SELECT d.doc_id, count(h) AS n_hashes, min(h) AS low, max(h) AS high FROM documents d LEFT JOIN hashes USING (doc_id) GROUP BY d.doc_id""")
def ngram_hashes(spark, sf_dir):
    """Texts of fewer tokens than an n-gram has have no hashes."""
    d = table(spark, sf_dir, "documents").select("doc_id", dedup_tokens("text").alias("t"))
    h = d.select("doc_id", sha1_heads(ngram_set("t", 5)).alias("h"))
    return h.select(
        "doc_id",
        F.size("h").cast("bigint").alias("n_hashes"),
        F.array_min("h").alias("low"),
        F.array_max("h").alias("high"),
    )


@query(f"WITH {signature_sql(SHORT_PERM)} SELECT doc_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS signature FROM sig GROUP BY doc_id")
def minhash_signatures(spark, sf_dir):
    sigs = neardup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text", SHORT_PERM)
    return sigs.select(
        F.col("id").alias("doc_id"), joined(signature_words(F.col("signature"), SHORT_PERM)).alias("signature")
    )


@query(f"WITH RECURSIVE {cluster_sql(SHORT_PERM, THRESHOLD)} SELECT band, low, members FROM bucket")
def band_buckets(spark, sf_dir):
    sigs = neardup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text", SHORT_PERM)
    singles = sigs.select("signature", F.col("id").alias("rep"))
    found = neardup.buckets(neardup.band_members(singles, *band_plan(THRESHOLD, SHORT_PERM)))
    return found.select(F.col("band").cast("bigint").alias("band"), "low", "members")


@query(f"WITH RECURSIVE {cluster_sql(SHORT_PERM, THRESHOLD)} SELECT id, cluster FROM clusters")
def near_duplicate_clusters(spark, sf_dir):
    return neardup.near_duplicate_clusters(table(spark, sf_dir, "documents"), "doc_id", "text", num_perm=SHORT_PERM)


@query(f"""
WITH RECURSIVE {cluster_sql(SHORT_PERM, THRESHOLD)} SELECT doc_id, source, lang FROM documents
WHERE doc_id NOT IN (SELECT id FROM clusters WHERE id <> cluster)""")
def near_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    clusters = neardup.near_duplicate_clusters(d, "doc_id", "text", num_perm=SHORT_PERM)
    return neardup.without_near_duplicates(d.select("doc_id", "source", "lang"), "doc_id", "text", clusters)


@query(f"""
WITH RECURSIVE {cluster_sql(SHORT_PERM, THRESHOLD)}, t AS (SELECT (SELECT count(*) FROM documents) AS rows_before,
  (SELECT count(*) FROM clusters WHERE id <> cluster) AS gone)
SELECT rows_before, rows_before - gone AS rows_after, gone AS rows_dropped, round(gone * 100.0 / rows_before, 6) AS dropped_pct FROM t""")
def near_dedup_report(spark, sf_dir):
    _, report = deduplicate(table(spark, sf_dir, "documents"), "doc_id", "text", num_perm=SHORT_PERM)
    return rounded(report, "dropped_pct")


# Two sources of the mix share row ids and texts; doc_key tells their rows apart.
MIX_CLUSTERS_SQL = (
    f"{MIX_SQL}, mixed_docs AS (SELECT source || '/' || key AS doc_id, text FROM mix), "
    + cluster_sql(SHORT_PERM, THRESHOLD).replace("FROM documents", "FROM mixed_docs")
)


@query(f"""
WITH RECURSIVE {MIX_CLUSTERS_SQL} SELECT m.source, m.key, m.est_tokens FROM mix m
WHERE m.source || '/' || m.key NOT IN (SELECT id FROM clusters WHERE id <> cluster)""")
def dedup_mix(spark, sf_dir):
    mix = build_mix(mix_sources(spark, sf_dir), MIX_TARGETS)
    kept, _ = deduplicate(mix, "doc_key", "text", num_perm=SHORT_PERM)
    return kept.select("source", "key", "est_tokens")


@query("""
SELECT doc_id, CASE WHEN length(text || chr(10) || lang) % 3 = 0 THEN 'OK' ELSE 'Exception' END AS status FROM documents""")
def exact_dedup_reuse(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", program_text("text", "lang").alias("program"))
    verdict = F.when(F.length("program") % 3 == 0, "OK").otherwise("Exception")
    out = evaluate_once(d, "program", lambda p: p.withColumn("status", verdict))
    return out.select("doc_id", "status")
