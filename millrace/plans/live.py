"""Streaming queries over the document table.

Each equals its batch twin where the table comes in one trigger; over several
triggers the budget gates take rows by arrival, as an endless source does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.keys import order_hash
from millrace.functions.text import estimate_tokens
from millrace.operators.select import keep_probability
from millrace.plans.mixing import GATE_TARGET
from millrace.plans.registry import ORACLES, TOKEN_DOCS, query, sql_order, table
from millrace.plans.reports import KEEP_PROBS
from millrace.session import ensure_checkpoint_dir, materialize
from millrace.sources.readers import read_shards
from millrace.streaming import ingest


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def stream_documents(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, because a stream takes a single file only through one; it matches a folder as well.
    raw = ingest.stream_shards(spark, f"{sf_dir}/documents.parque[t]", schema, "parquet")
    return raw.select(
        "doc_id",
        order_hash("doc_id", 42).alias("order_key"),
        "text",
        "source",
        "lang",
        estimate_tokens("text").alias("est_tokens"),
    )


def _finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@query(ORACLES["budget_gate_cross"])
def stream_budget(spark, sf_dir):
    out = _folder(spark, "budget")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ingest.STATE_PROVIDER)
    try:
        kept = ingest.stream_budget(stream_documents(spark, sf_dir).drop("text", "lang"), GATE_TARGET, order="order_key")
        _finish(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state"))
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(out).select("doc_id", "source", "est_tokens")


@query(ORACLES["budget_gate_cross"])
def stream_budget_by_batch(spark, sf_dir):
    out = _folder(spark, "batches")
    docs = stream_documents(spark, sf_dir).drop("text", "lang")
    gate = ingest.with_batch_budget(f"{out}-totals", out, GATE_TARGET)
    _finish(docs.writeStream.foreachBatch(gate).option("checkpointLocation", f"{out}-state"))
    return spark.read.parquet(out).select("doc_id", "source", "est_tokens")


TRIGGERS = 3


@query(f"""
WITH {TOKEN_DOCS}, gated AS (
  SELECT doc_id, source, est_tokens, CAST(doc_id % {TRIGGERS} AS BIGINT) AS arrival,
    coalesce(sum(est_tokens) OVER (PARTITION BY source ORDER BY doc_id % {TRIGGERS}, {sql_order('doc_id', 42)}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs)
SELECT doc_id, source, est_tokens, arrival FROM gated WHERE before < {GATE_TARGET}""")
def stream_budget_over_triggers(spark, sf_dir):
    """The gate keeps its totals from trigger to trigger; what arrives earlier comes first."""
    out = _folder(spark, "triggers")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", order_hash("doc_id", 42).alias("order_key"), "source", estimate_tokens("text").alias("est_tokens"),
        (F.col("doc_id") % TRIGGERS).cast("bigint").alias("arrival"),
    )
    gate = ingest.with_batch_budget(f"{out}-totals", out, GATE_TARGET)
    narrow = materialize(docs)
    for arrival in range(TRIGGERS):
        narrow.filter(F.col("arrival") == arrival).write.mode("append").parquet(f"{out}-in")
        stream = ingest.stream_shards(spark, f"{out}-in", narrow.schema, "parquet", files_per_trigger=1_000_000)
        _finish(stream.writeStream.foreachBatch(gate).option("checkpointLocation", f"{out}-state"))
    return spark.read.parquet(out).select("doc_id", "source", "est_tokens", "arrival")


@query(f"""
SELECT source, rows_seen, records_written, tokens_written, skipped_subsample + skipped_empty + skipped_filter AS rows_skipped
FROM ({ORACLES["skip_reasons"]})""")
def stream_profile(spark, sf_dir):
    out = _folder(spark, "profile")
    counts = ingest.stream_progress(
        stream_documents(spark, sf_dir), keep_probability("source", KEEP_PROBS), 17, key="doc_id"
    )

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(out)

    _finish(counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}-state"))
    return spark.read.parquet(out)


@query(f"""
SELECT source, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source""")
def stream_shards(spark, sf_dir):
    out = _folder(spark, "shards")
    docs = stream_documents(spark, sf_dir).select(
        "text", "source", F.create_map(F.lit("lang"), "lang").alias("meta"), "est_tokens"
    )
    ingest.write_shard_stream(docs, out, f"{out}-state").start().awaitTermination()
    written = read_shards(spark, out)
    return written.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))
