"""Readers for the layouts corpora, problems and results come in."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip
from millrace.session import broadcast_if_small, join_unique_side, materialize

log = logging.getLogger(__name__)

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("est_tokens", T.LongType()),
    ]
)
UNIFIED_SCHEMA = T.StructType(
    [
        T.StructField("source_code", T.StringType()),
        T.StructField("llvm_ir", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("ir_type", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("est_tokens", T.LongType()),
    ]
)
# Fixed value: file name prefixes that name the IR type of a pair group.
IR_TYPES = ("Perf_Optimized", "Size_Optimized")


def read_shards(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA) -> DataFrame:
    """All JSONL shards below ``path``; blank lines are skipped, a broken line is an error."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.json*").json(path)


def shard_name() -> Column:
    return F.col("_metadata.file_path")


def read_pair_groups(spark: SparkSession, root: str) -> DataFrame:
    """Parquet files laid out as ``<language>/<IR type>-*.parquet`` with both as columns.

    Files whose names do not follow the layout are left out.
    """
    pattern = f"([^/]+)/({'|'.join(IR_TYPES)})[^/]*$"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = raw.select(
        "*",
        F.regexp_extract(path, pattern, 1).alias("language"),
        F.regexp_extract(path, pattern, 2).alias("ir_type"),
    )
    return named.filter("ir_type <> ''")


def group_row_counts(groups: DataFrame) -> DataFrame:
    """Rows per (language, IR type); reads no data column."""
    return groups.groupBy("language", "ir_type").agg(F.count(F.lit(1)).alias("n_rows"))


def _counting(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose parquet scans answer counts from file footers."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.sources.useV1SourceList", "")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return beside


def footer_count(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """One row, the number of rows of parquet files; the scan reads footers and no page."""
    return _counting(spark).read.parquet(*files).agg(F.count(F.lit(1)).alias("n_rows"))


def files_by_group(spark: SparkSession, root: str) -> dict[tuple[str, str], list[str]]:
    """Files of each (language, IR type) in path order, from the listing alone."""
    listed = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root).inputFiles()
    found: dict[tuple[str, str], list[str]] = {}
    for file in sorted(listed):
        named = re.search(f"([^/]+)/({'|'.join(IR_TYPES)})[^/]*$", unquote(file))
        if named:
            found.setdefault((named[1], named[2]), []).append(file)
    return found


def group_row_counts_from_footers(spark: SparkSession, root: str) -> DataFrame:
    """Rows per (language, IR type) of the layout of :func:`read_pair_groups`: one job per group, over footers only."""
    counted = [(*name, footer_count(spark, files).first()[0]) for name, files in files_by_group(spark, root).items()]
    return spark.createDataFrame(counted, "language string, ir_type string, n_rows bigint")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A folder of ``<split>.parquet`` files or of ``split=`` partitions, with a ``split`` column."""
    raw = spark.read.parquet(path)
    if "split" in raw.columns:
        return raw
    return raw.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.parquet$", 1).alias("split"))


def read_named(
    spark: SparkSession, root: str, name: str, subset: str | None = None, split: str | None = None, data_dir: str | None = None
) -> DataFrame:
    """A named dataset: ``root/name[/subset][/data_dir]``, optionally one of its splits."""
    path = "/".join(p for p in (root, name, subset, data_dir) if p)
    frame = read_splits(spark, path) if split else spark.read.parquet(path)
    return frame.filter(F.col("split") == split) if split else frame


def read_benchmark(spark: SparkSession, root: str, name: str, revision: str | None = None) -> DataFrame | None:
    """A benchmark table by name and revision; a warning and None when it is not there."""
    path = "/".join(p for p in (root, name, revision) if p)
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        log.warning("benchmark %s not loaded: %s", path, e.getCondition())
        return None


def read_supervised(spark: SparkSession, path: str, language: str, split: str) -> DataFrame:
    """One language and split of a partitioned table; both filters prune partitions."""
    return spark.read.parquet(path).filter((F.col("language") == language) & (F.col("split") == split))


def _string_parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value, quote, opens, rel, alone) for what stands between double quotes, in byte ranges.

    ``quote`` is 1 if the quote behind the part is not escaped, ``rel`` counts
    such quotes before it inside its range, and ``alone`` parts lie between two.
    """
    raw = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    slashes = F.length(F.regexp_extract("value", r"(\\*)$", 1))
    marked = raw.withColumns(
        {"quote": (slashes % 2 == 0).cast("bigint"), "opens": (F.length("value") - F.length(F.replace("value", F.lit("["), F.lit("")))).cast("bigint")}
    )
    in_range = Window.partitionBy("file", "block").orderBy("id")
    before = F.sum("quote").over(in_range.rowsBetween(Window.unboundedPreceding, -1))
    alone = (F.col("quote") == 1) & (F.lag("quote").over(in_range) == 1)
    return marked.withColumns({"rel": F.coalesce(before, F.lit(0)), "alone": F.coalesce(alone, F.lit(False))})


def read_generations(spark: SparkSession, path: str, n_tasks: int | None = None, file: str | None = None) -> DataFrame:
    """Candidates from JSON lists of lists of strings: (task_id, completion_id, completion) by position.

    A file may be one JSON value of any size.  Byte ranges are cut at every
    double quote, and each range is reduced to what it does to its followers:
    how many real quotes it has, and how many lists it opens if it starts inside
    a string or outside.  A window over the table of ranges adds these up, so
    every part knows whether it is a string and which list it is in.  The largest
    task is one range (``spark.sql.files.maxPartitionBytes``), the largest row
    one string.  Anything but strings in the inner lists is an error, as is a file
    that ends inside a string.  ``file`` names a column for the file's path.
    """
    parts = materialize(_string_parts(spark, path))
    outside = F.col("rel") % 2 == 0
    effects = parts.groupBy("file", "block").agg(
        F.sum("quote").alias("quotes"),
        F.sum(F.when(outside, F.col("opens")).otherwise(0)).alias("even"),
        F.sum(F.when(outside, F.lit(0)).otherwise(F.col("opens"))).alias("odd"),
    )
    # one row per range
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = effects.withColumn("first", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    own = F.when(F.col("first") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    placed = materialize(placed.withColumn("lists", F.coalesce(F.sum(own).over(earlier), F.lit(0))).select("file", "block", "first", "quotes", "lists"))
    # the part behind the last quote counts as one with a quote
    broken = placed.groupBy("file").agg(F.sum("quotes").alias("quotes")).filter(F.col("quotes") % 2 == 0)
    if not broken.isEmpty():
        raise ValueError(f"{broken.first()['file']} ends inside a string")
    unit = F.col("first") + F.col("rel")
    known = parts.join(broadcast_if_small(placed.drop("quotes")), ["file", "block"]).withColumn("unit", unit)
    strange = F.raise_error(F.concat(F.lit("not a list of lists of strings: "), F.substring("value", 1, 100)))
    checked = F.when(F.col("value").rlike(r"^[\[\],\s]*$"), F.col("opens")).otherwise(strange.cast("bigint"))
    here = F.when(F.col("unit") % 2 == 0, checked).otherwise(F.lit(0))
    in_range = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    listed = known.withColumn("task_id", F.col("lists") + F.coalesce(F.sum(here).over(in_range), F.lit(0)) - 2)
    strings = listed.filter(F.col("unit") % 2 == 1).select("file", "task_id", "unit", "block", "id", "value", "alone")
    if n_tasks is not None:
        strings = strings.filter(F.col("task_id") < n_tasks)
    strings = materialize(strings)
    # a string with escaped quotes, or across a border of ranges, has several parts
    together = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    joined = strings.filter("NOT alone").groupBy("file", "unit").agg(F.min("task_id").alias("task_id"), together.alias("p"))
    joined = joined.select("file", "task_id", "unit", F.array_join(F.transform("p", lambda x: x["value"]), '"').alias("value"))
    whole = strings.filter("alone").select("file", "task_id", "unit", "value").unionByName(joined)
    firsts = materialize(strings.groupBy("file", "task_id").agg(F.min("unit").alias("head"), F.count("*").alias("n")))
    numbered = join_unique_side(whole, firsts, ["file", "task_id"], "n")
    text = F.from_json(F.concat(F.lit('["'), "value", F.lit('"]')), "array<string>", {"mode": "FAILFAST"})
    place = ((F.col("unit") - F.col("head")) / 2).cast("int")
    named = [F.col("file").alias(file)] if file else []
    return numbered.select(*named, F.col("task_id").cast("int").alias("task_id"), place.alias("completion_id"), F.get(text, F.lit(0)).alias("completion"))


def read_candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """Candidates written one task per line: ``{"task_id": ..., "candidates": [...]}``."""
    schema = "task_id string, candidates array<string>"
    tasks = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return tasks.select("task_id", F.posexplode("candidates").alias("completion_id", "completion"))


def read_id_text(spark: SparkSession, path: str) -> DataFrame:
    """``id<TAB>text`` lines; a line without a tab has empty text, further fields are ignored."""
    parts = F.split(strip("value"), "\t")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text")
    )


def matching_gold(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Gold rows for which there is a prediction."""
    return gold.join(predictions, key, "left_semi")
