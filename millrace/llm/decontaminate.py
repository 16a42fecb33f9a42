"""Benchmark decontamination with n-gram windows, in DataFrame operations only.

Benchmark items are cut into windows of :data:`WINDOW` consecutive normalised
words (an item of fewer words, but not none, is one window).  Windows are
hashed; the distinct ones are broadcast as a hash set, at most about
:data:`BROADCAST_ROWS` at a time (a larger set is scanned in slices).  The scan
turns every text into its words once, walks the word positions inside one
generated stage, hashes the window that starts there and probes the set.  Only hits leave
the stage; they are verified word by word against the item's window.

The words of a document that any occurrence of a window covers are counted from
the sorted starts of its occurrences.  Spans, items and the decision per
document follow from the verified hits.

A null text has no words and no hits.  Rows that repeat a key and text are one
document and get the same result; rows that repeat a key with another text are
told apart by a digest of the text.  Items of null key are left out, null texts
have no windows.  Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import free, table
from millrace.session import broadcast_if_small, materialize

WINDOW = 10
BROADCAST_ROWS = 500_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Normalised words: A-Z lowered, then runs of letters, digits and anything beyond ASCII."""
    lowered = F.translate(F.col(text) if isinstance(text, str) else text, UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _hash_at(words_col: str, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(F.col(words_col), start + i) for i in range(length)])


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, length, hash, words) for every window of every item."""
    cut = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words(text).alias("_w"))
    sized = cut.select("item", "_w", F.least(F.size("_w"), F.lit(window)).alias("length")).filter("length > 0")
    starts = sized.select("*", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("length"))).alias("_at"))
    found = starts.select("item", "length", F.slice("_w", F.col("_at") + 1, F.col("length")).alias("words"))
    # hashed as the scan hashes: the length, then each word
    by_length = F.lit(None).cast("bigint")
    for n in range(window, 0, -1):
        by_length = F.when(F.col("length") == n, _hash_at("words", F.lit(0), n)).otherwise(by_length)
    return found.withColumn("hash", by_length)


def window_set(windows: DataFrame) -> DataFrame:
    """Distinct windows, numbered by hash and words."""
    return windows.select("length", "hash", "words").distinct()


def hits(docs: DataFrame, windows: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified occurrences (doc, digest, start, length, words); ``docs`` has (doc, digest, _w).

    ``windows`` is :func:`window_set`, materialized.  It is broadcast in slices
    of about ``rows`` windows of at most ten words, some hundred MB each; every
    slice is one scan of the documents.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most WINDOW numbers
    slices = -(-windows.count() // rows)
    at_start = [F.struct(F.lit(n).alias("length"), _hash_at("_w", F.col("start"), n).alias("hash")) for n in lengths]
    walked = docs.select("doc", "digest", "_w", F.posexplode("_w").alias("start", "_word"))
    if len(lengths) == 1:
        probes = walked.select("doc", "digest", "_w", "start", at_start[0].alias("_p")).select("*", "_p.*")
    else:
        probes = walked.select("doc", "digest", "_w", "start", F.inline(F.array(*at_start)) if lengths else F.lit(0).alias("length"))
    found = None
    for part in range(slices):
        known = windows.filter(F.pmod("hash", F.lit(slices)) == part).select("hash", F.col("words").alias("window"))
        met = probes.join(F.broadcast(known), "hash")
        # a window of fewer words reaches over the end of the text: its slice is shorter and differs
        verified = met.filter(F.slice("_w", F.col("start") + 1, F.col("length")) == F.col("window"))
        kept = verified.select("doc", "digest", "start", "length", F.col("window").alias("words"))
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        empty = F.array().cast("array<string>").alias("words")
        found = walked.filter(F.lit(False)).select("doc", "digest", "start", F.lit(0).alias("length"), empty)
    return found


def covered(found: DataFrame) -> DataFrame:
    """(doc, digest, n_hit): words inside any occurrence, from the sorted occurrences of each document."""
    spans = found.groupBy("doc", "digest", "start").agg(F.max("length").alias("length"))
    order = Window.partitionBy("doc", "digest").orderBy("start")
    ended = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(ended, F.lit(0)))
    return spans.withColumn("_n", F.greatest(fresh, F.lit(0))).groupBy("doc", "digest").agg(F.sum("_n").alias("n_hit"))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("digest"), words(text).alias("_w"))


def contamination(
    df: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences).

    Documents: (doc, digest, n_words) of every row.  Occurrences: verified
    hits, written once; empty for a clean corpus.
    """
    windows = materialize(window_set(item_windows(items, item_key, item_text, window)))
    keyed = _keyed(df, key, text)
    counted = keyed.select("doc", "digest", F.coalesce(F.size("_w"), F.lit(0)).cast("bigint").alias("n_words"))
    return counted, materialize(hits(keyed.filter("_w IS NOT NULL"), windows, rows))


def items_hit(found: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, digest, item): items with an occurring window."""
    windows = item_windows(items, item_key, item_text, window).select("item", "words").distinct()
    return found.select("doc", "digest", "words").distinct().join(windows, "words").select("doc", "digest", "item").distinct()


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``df`` without any occurrence of a benchmark window, all columns kept."""
    _, found = contamination(df, items, key, text, **options)
    doc, digest = free(df, "_doc"), free(df, "_digest")
    # narrow, and a document counts once however often it is hit
    bad = materialize(found.select(F.col("doc").alias(doc), F.col("digest").alias(digest)).distinct())
    same = F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(digest))
    return df.join(broadcast_if_small(bad), same, "left_anti")


def without_spans(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, text): the words outside all occurrences, space-joined, for texts that have any; others as they are."""
    _, found = contamination(df, items, key, text, **options)
    cut = found.groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "length")).alias("_spans"))
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("_text")).withColumn("digest", F.xxhash64("_text"))
    joined = rows.alias("r").join(
        cut.alias("c"), F.col("r.doc").eqNullSafe(F.col("c.doc")) & (F.col("r.digest") == F.col("c.digest")), "left"
    ).select("r.doc", "_text", "_spans")
    outside = F.filter(
        F.transform(words("_text"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: ~F.exists("_spans", lambda s: (x["i"] >= s["start"]) & (x["i"] < s["start"] + s["length"])),
    )
    kept = F.array_join(F.transform(outside, lambda x: x["w"]), " ")
    return joined.select(F.col("doc").alias(key), F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(kept).alias(text))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, and the decision."""
    items = table(spark, sf_dir, "benchmark")
    counted, found = contamination(table(spark, sf_dir, "documents"), items)
    none = F.lit(None)
    both = covered(found).withColumn("item", none.cast("string")).unionByName(
        items_hit(found, items).withColumn("n_hit", none.cast("bigint"))
    )
    per_doc = both.groupBy(F.col("doc").alias("_doc"), F.col("digest").alias("_digest")).agg(
        F.sum("n_hit").alias("n_hit"),
        F.count("item").alias("n_items"),
        F.array_join(F.sort_array(F.collect_list("item")), ",").alias("item_list"),
    )
    joined = counted.join(per_doc, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("item_list", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate({0}, '" + UPPER + "', '" + UPPER.lower() + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS length, w[i : i + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
-- ten words are looked up at once, shorter windows by their own length
lengths AS (SELECT DISTINCT length FROM item_windows),
starts AS (
  SELECT doc_id, length, i, w[i : i + length - 1] AS win
  FROM (SELECT doc_id, length, w, unnest(range(1, CAST(len(w) - length + 2 AS BIGINT))) AS i FROM doc_words, lengths WHERE len(w) >= length)),
hits AS (SELECT s.doc_id, s.i, s.length, t.item FROM starts s JOIN item_windows t ON s.length = t.length AND s.win = t.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + length)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
