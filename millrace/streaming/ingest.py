"""Streaming twins: incremental reading, budget tracking, progress and shards."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from millrace.operators.budget import Targets, with_target, within_budget
from millrace.operators.select import skip_reason
from millrace.session import join_null_safe, materialize
from millrace.sources.readers import DOCUMENT_SCHEMA

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# No leading underscore: such names are changed on the way into pandas.
GATE_COLUMN = "gate_target"


def stream_shards(
    spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA, fmt: str = "json", files_per_trigger: int = 100
) -> DataFrame:
    """New files of a folder as a stream; nothing is read ahead of its trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


class _TokenBudget(StatefulProcessor):
    """Running token total of one source; passes rows on until the target is met."""

    def __init__(self, order: str, tokens: str) -> None:
        self._order = order
        self._tokens = tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._total = handle.getValueState("tokens", "total bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self._total.get() if self._total.exists() else None
        total = int(state[0]) if state else 0
        # Arrival order inside a trigger is undefined: the trigger's rows are sorted.
        batch = pd.concat(list(rows)).sort_values(self._order)
        before = total + batch[self._tokens].cumsum() - batch[self._tokens]
        kept = batch[before < batch[GATE_COLUMN]]
        total += int(kept[self._tokens].sum())
        if len(kept):
            yield kept.drop(columns=GATE_COLUMN)
        self._total.update((total,))

    def close(self) -> None:
        pass


def stream_budget(
    docs: DataFrame, targets: Targets, group: str = "source", order: str = "key", tokens: str = "est_tokens"
) -> DataFrame:
    """Stateful budget gate over a stream: the running total per source survives restarts.

    Takes the rows of each trigger in ``order`` until the crossing one, as an
    endless source does.  Only narrow columns should come in: the rows of a source within a
    trigger meet in one task, which ``files_per_trigger`` bounds.  For a stored
    corpus use the batch gate, and for large triggers
    :func:`with_batch_budget`; both spread a source over many tasks.
    """
    setting = "spark.sql.streaming.stateStore.providerClass"
    if docs.sparkSession.conf.get(setting, None) != STATE_PROVIDER:
        raise ValueError(f"set {setting} to {STATE_PROVIDER}")
    funded = with_target(docs, targets, group, GATE_COLUMN)
    return funded.groupBy(group).transformWithStateInPandas(
        statefulProcessor=_TokenBudget(order, tokens),
        outputStructType=docs.schema,
        outputMode="Append",
        timeMode="None",
    )


def with_batch_budget(
    totals_path: str, out_path: str, targets: Targets, group: str = "source", order: str = "order_key", tokens: str = "est_tokens"
):
    """A ``foreachBatch`` function that gates each micro-batch exactly, whatever its size.

    The state is a table of the tokens written by earlier batches, one folder per
    batch, so that a repeated batch replaces its own entry.  What is left of each
    budget is joined as a table (of any number of groups, null among them), and
    the distributed batch gate cuts the trigger there: a group's rows are spread
    over stretches of the order, the sums of earlier stretches place each, and
    only the stretch where the budget runs out is walked row by row.  So all cores
    share a trigger that one source fills, and a group exceeds its budget by less
    than one record over all triggers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[group].dataType.simpleString()
        totals = f"`{group}` {kind}, `_spent` bigint, batch bigint"
        narrow = batch.select(group).distinct()
        left = with_target(narrow, targets, group, "_left")
        if batch_id > 0:
            found = spark.read.schema(totals).parquet(totals_path).filter(F.col("batch") < batch_id)
            spent = found.groupBy(group).agg(F.sum("_spent").alias("_spent"))
            left = join_null_safe(left, spent, [group], "left")
            left = left.select(group, (F.col("_left") - F.coalesce("_spent", F.lit(0))).alias("_left"))
        left = materialize(left)
        kept = within_budget(batch, left, group, order, tokens)
        kept.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        sums = spark.read.schema(batch.schema).parquet(f"{out_path}/batch={batch_id}").groupBy(group)
        sums.agg(F.sum(tokens).cast("bigint").alias("_spent")).write.mode("overwrite").parquet(f"{totals_path}/batch={batch_id}")

    return write


def stream_progress(docs: DataFrame, prob: Column | float, seed: int, key: str = "key", group: str = "source") -> DataFrame:
    """Live counts per source: rows seen, records and tokens written, rows skipped."""
    reason = skip_reason(key, "text", "est_tokens", prob, seed)
    marked = docs.select(group, "est_tokens", reason.alias("reason"))
    written = F.col("reason").isNull()
    return marked.groupBy(group).agg(
        F.count("*").alias("rows_seen"),
        F.count_if(written).alias("records_written"),
        F.coalesce(F.sum(F.when(written, F.col("est_tokens"))), F.lit(0)).alias("tokens_written"),
        F.count_if(~written).alias("rows_skipped"),
    )


def write_shard_stream(docs: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> DataStreamWriter:
    """Append shards per source with exactly-once file output; call ``start()`` on the result."""
    out = docs.withColumn("_folder", F.col("source"))
    return (
        out.writeStream.format(fmt)
        .partitionBy("_folder")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
