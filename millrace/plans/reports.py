"""Profile, filter and selection queries over the document tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.text import estimate_tokens, estimate_pair_tokens, first_present, word_count
from millrace.operators import passk, profile, prompts, select
from millrace.operators.extract import (
    code_meta,
    code_text,
    preview,
    prose_meta,
    report_language,
    web_meta,
)
from millrace.plans.registry import (
    TOKEN_DOCS,
    mixed_documents,
    query,
    rounded,
    sql_order,
    sql_tokens,
    sql_unit,
    sql_words,
    table,
    token_documents,
)
from millrace.session import ensure_checkpoint_dir
from millrace.sources import readers, writers

PERCENTILES_SQL = """
  round(quantile_cont(est_tokens, 0.25), 6) AS p25, round(quantile_cont(est_tokens, 0.5), 6) AS p50,
  round(quantile_cont(est_tokens, 0.75), 6) AS p75, round(quantile_cont(est_tokens, 0.99), 6) AS p99"""
SPREAD = ("p25", "p50", "p75", "p99")
KEEP_PROBS = {"src0": 0.5, "src1": 0.25, "src2": 0.9}


@query(f"""
WITH {TOKEN_DOCS}
SELECT source, count(*) AS records, CAST(sum(est_tokens) AS BIGINT) AS tokens,
  round(sum(est_tokens) * 100.0 / sum(sum(est_tokens)) OVER (), 6) AS share_pct, {PERCENTILES_SQL}
FROM docs GROUP BY source""")
def source_profile(spark, sf_dir):
    return rounded(profile.source_profile(token_documents(spark, sf_dir)), "share_pct", *SPREAD)


@query(f"""
WITH {TOKEN_DOCS}, pairs AS (
  SELECT source, lang, count(*) AS records, CAST(sum(est_tokens) AS BIGINT) AS tokens, {PERCENTILES_SQL}
  FROM docs GROUP BY source, lang)
SELECT source, lang, records, tokens, p25, p50, p75, p99,
  round(tokens * 100.0 / sum(tokens) OVER (PARTITION BY source), 6) AS share_pct,
  row_number() OVER (PARTITION BY source ORDER BY tokens DESC, lang) AS rank
FROM pairs""")
def source_lang_profile(spark, sf_dir):
    return rounded(profile.language_profile(token_documents(spark, sf_dir)), "share_pct", *SPREAD)


@query(f"""
WITH {TOKEN_DOCS}
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source,
  CASE WHEN grouping(lang) = 1 THEN 'SUBTOTAL' ELSE lang END AS lang,
  CAST(grouping(source, lang) AS BIGINT) AS level, count(*) AS records, CAST(sum(est_tokens) AS BIGINT) AS tokens
FROM docs WHERE lang <> '' GROUP BY ROLLUP (source, lang)""")
def lang_rollup(spark, sf_dir):
    return profile.language_subtotals(token_documents(spark, sf_dir))


# Only English rows of the even sources keep their tag here, so that something is unlabelled.
@query(f"""
WITH {TOKEN_DOCS}, tagged AS (SELECT source, est_tokens, CASE WHEN lang = 'en' THEN lang ELSE '' END AS lang FROM docs),
sums AS (SELECT source, CAST(sum(est_tokens) AS BIGINT) AS tokens,
  CAST(coalesce(sum(est_tokens) FILTER (lang = ''), 0) AS BIGINT) AS unlabelled FROM tagged GROUP BY source)
SELECT source, tokens, unlabelled, round(unlabelled * 100.0 / tokens, 6) AS unlabelled_pct FROM sums""")
def unlabelled_tokens(spark, sf_dir):
    d = token_documents(spark, sf_dir).withColumn("lang", F.when(F.col("lang") == "en", "en").otherwise(""))
    return rounded(profile.unlabelled_tokens(d), "unlabelled_pct")


@query("SELECT lang AS value, count(*) AS records FROM documents GROUP BY lang")
def value_counts_lang(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "documents"), "lang")


@query("""
SELECT source AS value, count(*) AS records, (SELECT count(DISTINCT source) FROM documents) AS distinct_values
FROM documents GROUP BY source ORDER BY records DESC, value LIMIT 5""")
def top_sources(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents"), "source", 5)


@query("""
SELECT source, lang AS language, doc_id, replace(text, chr(10), ' ')[1:200] AS preview, sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sample_no FROM documents)
WHERE sample_no <= 3""")
def first_n_per_source(spark, sf_dir):
    d = mixed_documents(spark, sf_dir)
    picked = profile.first_per_group(d, 3, "source", ["doc_id"], "doc_id")
    return picked.select(
        "source",
        report_language("meta").alias("language"),
        "doc_id",
        preview("text").alias("preview"),
        F.col("sample_no").cast("bigint").alias("sample_no"),
    )


@query(f"""
WITH {TOKEN_DOCS}
SELECT count(DISTINCT source) AS shards, count(*) AS records, CAST(sum(est_tokens) AS BIGINT) AS tokens FROM docs""")
def dataset_totals(spark, sf_dir):
    return profile.dataset_totals(token_documents(spark, sf_dir), F.col("source"))


@query("""
SELECT source, k AS meta_key, count(*) AS records
FROM (SELECT source, unnest(['lang', 'id']) AS k FROM documents) GROUP BY ALL""")
def meta_key_inventory(spark, sf_dir):
    return profile.meta_keys(mixed_documents(spark, sf_dir))


@query("SELECT count(*) AS records, count(DISTINCT url) AS distinct_urls FROM pages")
def web_url_counts(spark, sf_dir):
    return profile.url_counts(table(spark, sf_dir, "pages"), "url")


@query("SELECT source AS source_dataset, count(*) AS records FROM documents GROUP BY source")
def rows_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_dataset"))
    return d.groupBy("source_dataset").agg(F.count("*").alias("records"))


@query(f"""
SELECT doc_id, {sql_words('text')} AS n_words, {sql_tokens('text')} AS est_tokens FROM documents""")
def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", word_count("text").cast("bigint").alias("n_words"), estimate_tokens("text").alias("est_tokens")
    )


@query(f"""
SELECT doc_id, CAST(trunc(({sql_words("text")} + {sql_words("coalesce(source, '')")} + 5) * 1.5) AS BIGINT) AS est_tokens
FROM documents""")
def pair_token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", estimate_pair_tokens("text", "source").alias("est_tokens"))


@query("""
SELECT page_id, html AS body, url AS address, 'unknown' AS license FROM pages""")
def first_present_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        first_present(p, ["content", "text", "html"]).alias("body"),
        first_present(p, ["link", "url"]).alias("address"),
        first_present(p, ["license"], "unknown").alias("license"),
    )


@query("""
SELECT doc_id, CAST(doc_id AS VARCHAR) AS prose_id, source AS prose_source, lang AS code_lang, '' AS code_repo, '' AS code_license,
  length(text) AS text_chars
FROM documents""")
def source_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    prose, code = prose_meta(d), code_meta(d)
    return d.select(
        "doc_id",
        prose["id"].alias("prose_id"),
        prose["source"].alias("prose_source"),
        code["lang"].alias("code_lang"),
        code["repo"].alias("code_repo"),
        code["license"].alias("code_license"),
        F.length(code_text(d)).cast("bigint").alias("text_chars"),
    )


@query("SELECT page_id, coalesce(url, '') AS url FROM pages")
def web_metadata(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", web_meta(p)["url"].alias("url"))


@query(f"""
WITH {TOKEN_DOCS} SELECT doc_id, est_tokens FROM docs WHERE est_tokens BETWEEN 32 AND 8192""")
def length_filter(spark, sf_dir):
    return token_documents(spark, sf_dir).filter(select.within_length()).select("doc_id", "est_tokens")


@query(f"""
WITH {TOKEN_DOCS} SELECT doc_id, est_tokens FROM docs WHERE est_tokens >= 32""")
def minimum_length_filter(spark, sf_dir):
    return token_documents(spark, sf_dir).filter(select.within_length(high=None)).select("doc_id", "est_tokens")


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND text <> '' AND lower(lang) IN ('en', 'de')")
def lang_filter(spark, sf_dir):
    d = select.non_empty_rows(table(spark, sf_dir, "documents"), "text")
    allowed = select.parse_language_list("EN, de , llvm,")
    return d.filter(select.language_allowed("lang", allowed)).select("doc_id", "lang")


@query(f"""
SELECT doc_id, source FROM documents
WHERE {sql_unit('doc_id', 17)} <= CASE source WHEN 'src0' THEN 0.5 WHEN 'src1' THEN 0.25 WHEN 'src2' THEN 0.9 ELSE 1.0 END""")
def hash_subsample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.filter(select.sampled("doc_id", 17, select.keep_probability("source", KEEP_PROBS)))


@query(f"""
WITH {TOKEN_DOCS}, marked AS (
  SELECT source, est_tokens, CASE
    WHEN {sql_unit('doc_id', 17)} > CASE source WHEN 'src0' THEN 0.5 WHEN 'src1' THEN 0.25 WHEN 'src2' THEN 0.9 ELSE 1.0 END THEN 'subsample'
    WHEN text IS NULL OR text = '' THEN 'empty'
    WHEN est_tokens NOT BETWEEN 32 AND 8192 THEN 'filter' END AS reason FROM docs)
SELECT source, count(*) AS rows_seen, count(*) FILTER (reason = 'subsample') AS skipped_subsample,
  count(*) FILTER (reason = 'empty') AS skipped_empty, count(*) FILTER (reason = 'filter') AS skipped_filter,
  count(*) FILTER (reason IS NULL) AS records_written,
  CAST(coalesce(sum(est_tokens) FILTER (reason IS NULL), 0) AS BIGINT) AS tokens_written
FROM marked GROUP BY source""")
def skip_reasons(spark, sf_dir):
    d = mixed_documents(spark, sf_dir)
    prob = select.keep_probability("source", KEEP_PROBS)
    return select.skip_report(d, "source", select.skip_reason("doc_id", "text", "est_tokens", prob, 17), "est_tokens")


@query("SELECT event_id, user_id, event_id % 5 AS seed FROM events WHERE event_id % 5 < 3")
def first_seeds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 5).alias("seed"))
    return select.first_seeds(e, 3)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 25")
def row_slice(spark, sf_dir):
    return select.ordered_slice(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 25, 50)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    return select.head(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 100)


@query(f"SELECT doc_id, source FROM documents ORDER BY {sql_order('doc_id', 77)}, doc_id LIMIT 100")
def random_rows(spark, sf_dir):
    return select.random_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100, 77)


@query("SELECT conv_id, turn, role FROM conversations WHERE turn < 2")
def first_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return select.first_candidates(c, 2, "turn")


@query(f"""
WITH {TOKEN_DOCS}, n AS (SELECT count(*) AS rows_before, count(*) FILTER (est_tokens BETWEEN 32 AND 8192) AS rows_after FROM docs)
SELECT rows_before, rows_after, rows_before - rows_after AS rows_dropped,
  round((rows_before - rows_after) * 100.0 / rows_before, 6) AS dropped_pct FROM n""")
def length_filter_report(spark, sf_dir):
    d = token_documents(spark, sf_dir)
    return rounded(profile.before_after(d, d.filter(select.within_length())), "dropped_pct")

@query(f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), {TOKEN_DOCS}
SELECT (SELECT CAST(sum(ceil(n / 20)) AS BIGINT) FROM s) AS shards, count(*) AS records, CAST(sum(est_tokens) AS BIGINT) AS tokens FROM docs""")
def shard_totals(spark, sf_dir):
    """Totals of a folder of shards: its files, their records and tokens."""
    path = f"{ensure_checkpoint_dir(spark)}/totals-{uuid.uuid4().hex}"
    writers.write_shards(mixed_documents(spark, sf_dir), path, records=20, order="order_key")
    return profile.dataset_totals(readers.read_shards(spark, path), readers.shard_name())


@query(f"""
SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {sql_order("(l_orderkey * 10 + l_linenumber)", 77)} LIMIT (SELECT count(*) // 2 FROM lineitem)""")
def half_of_all_rows(spark, sf_dir):
    """As many random rows as half the table has: a filter, whatever their number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return select.random_rows(lines, "key", lines.count() // 2, 77).drop("key")


@query("SELECT doc_id, source FROM documents ORDER BY source, lang, doc_id LIMIT 70 OFFSET 33")
def slice_by_several_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return select.ordered_slice(d, ["source", "lang", "doc_id"], 33, 70).select("doc_id", "source")


@query("""
SELECT doc_id, 'completion' AS mode, 'mixed prompt modes: [''completion'', ''infilling'']' AS refused FROM documents WHERE doc_id % 3 = 0""")
def one_prompt_mode(spark, sf_dir):
    """Rows of one mode pass; the whole table, which mixes two, is refused."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "completion").otherwise("infilling").alias("mode"))
    try:
        prompts.require_one_mode(d, "mode")
        refused = ""
    except ValueError as e:
        refused = str(e)
    return prompts.require_one_mode(d.filter(F.col("doc_id") % 3 == 0), "mode").withColumn("refused", F.lit(refused))


@query("""
SELECT event_type, user_id, count(*) AS n, (SELECT count(*) > count(DISTINCT (event_type, user_id)) FROM events) AS refused FROM events GROUP BY ALL""")
def unique_seeds(spark, sf_dir):
    """Keys that occur once pass; repeated ones are refused."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    passk.require_unique_seeds(e, ["event_type", "user_id", "event_id"])
    try:
        passk.require_unique_seeds(e, ["event_type", "user_id"])
        refused = False
    except ValueError:
        refused = True
    return e.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("SELECT lang, count(*) AS records, 'the step produced 0 documents' AS refused FROM documents GROUP BY lang")
def required_rows(spark, sf_dir):
    """A step with rows passes, one without is refused."""
    d = table(spark, sf_dir, "documents").select("lang")
    try:
        profile.require_rows(d.filter("lang = 'none'"), "documents")
        refused = ""
    except ValueError as e:
        refused = str(e)
    return profile.require_rows(d, "documents").groupBy("lang").agg(F.count("*").alias("records")).withColumn("refused", F.lit(refused))
