"""Writers for corpora, blocks, manifests and results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import range_bounds, range_bucket, with_running_totals
from millrace.sources.readers import UNIFIED_SCHEMA

SHARD_RECORDS = 50_000
# Records that one task writes into one folder of small shards.
RUN_RECORDS = 20_000
GROUP_RECORDS = 10_000
PREDICTION_DELIMITER = "\n\n=====DELIMITER====\n\n"


def write_shards(df: DataFrame, path: str, records: int = SHARD_RECORDS, mode: str = "errorifexists", order: str | None = None) -> None:
    """JSONL shards in one folder per source.

    Without ``order`` a task writes what it has, in files of at most ``records``
    lines.  With a unique ``order`` every file but the last of its source has
    exactly ``records`` lines: rows are numbered by bucketed running totals, and
    one task writes a run of consecutive shards of a source into a folder of
    their own, named by the first of them, so that folders are as few as runs.
    Where keys are null or repeat, shards differ in length and are a folder each.
    """
    columns = ("text", "source", "meta", "est_tokens")
    if order is None:
        out = df.select(*columns).withColumn("_folder", F.col("source"))
        out.write.mode(mode).partitionBy("_folder").option("maxRecordsPerFile", records).json(path)
        return
    narrow = df.select("source", order)
    bucket = range_bucket(order, range_bounds(narrow, order))
    numbered = with_running_totals(narrow, {"_number": F.lit(1)}, [order], bucket, ["source"])
    uneven = narrow.groupBy(order).agg(F.count("*").alias("_rows")).filter(F.col(order).isNull() | (F.col("_rows") > 1))
    run = shards_per_run(records) if uneven.isEmpty() else 1
    first = F.floor(F.col("_number") / (records * run)) * run
    placed = numbered.select(F.col(order).alias("_key"), F.col("_number"), first.alias("_shard"))
    out = df.select(*columns, F.col(order).alias("_key")).join(placed, "_key").withColumn("_folder", F.col("source"))
    dealt = out.repartition("_folder", "_shard").sortWithinPartitions("_folder", "_shard", "_number").drop("_key", "_number")
    writer = dealt.write.mode(mode).partitionBy("_folder", "_shard")
    # a run holds whole shards in order, so the writer's cut after every ``records`` lines is theirs
    (writer.option("maxRecordsPerFile", records) if run > 1 else writer).json(path)


def shards_per_run(records: int) -> int:
    """Shards that one task writes into one folder."""
    return max(1, RUN_RECORDS // records)


def shard_number(file: Column) -> Column:
    """Number of a shard in its source, from the name of a file written in an order."""
    first = F.regexp_extract(file, r"_shard=([0-9]+)/", 1).cast("bigint")
    return first + F.regexp_extract(file, r"c([0-9]+)\.json[^/]*$", 1).cast("bigint")


def write_unified(df: DataFrame, path: str, records: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet in the fixed six-column schema; absent columns are null, absent token counts 0."""
    picked = []
    for f in UNIFIED_SCHEMA:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        picked.append((F.coalesce(c, F.lit(0)) if f.name == "est_tokens" else c).alias(f.name))
    writer = df.select(*picked).write.mode(mode)
    if records:
        writer = writer.option("maxRecordsPerFile", records)
    writer.parquet(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with one folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row manifest as one JSON file."""
    manifest.coalesce(1).write.mode(mode).json(path)


def _write_lines(rows: DataFrame, key: str, order: list[str], opening: Column | None, item: Column, heads: int, path: str, mode: str) -> None:
    """One line per record: its rows stand together and in order, and each writes its own part of the line.

    So a record of any number of items needs no row of its size.  ``opening`` goes
    before the first row's item; without it the first ``heads`` rows are the
    opening.  Parts are set apart by a blank, which JSON allows between items.
    """
    inside = Window.partitionBy(key).orderBy(*order)
    number = F.row_number().over(inside)
    last = F.lead(F.lit(True)).over(inside).isNull()
    nothing = F.lit("")
    first = nothing if opening is None else F.when(number == 1, opening).otherwise(nothing)
    comma = F.when(number > heads + 1, F.lit(",")).otherwise(nothing)
    part = F.concat(first, comma, item, F.when(last, F.lit("]}\n")).otherwise(nothing))
    rows.select(part.alias("value")).write.mode(mode).option("lineSep", " ").text(path)


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def write_candidates(completions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Candidates back in order, one task per line; a task may have any number of them."""
    listed = _json(F.array("completion"))
    item = F.substring(listed, F.lit(2), F.length(listed) - 2)
    head = _json(F.struct("task_id"))
    opening = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"candidates":['))
    _write_lines(completions, "task_id", ["completion_id"], opening, item, 0, path, mode)


def write_metrics(metrics: DataFrame, config: Mapping[str, object], path: str, mode: str = "errorifexists") -> None:
    """Metric values beside the settings of the run."""
    entries = [F.lit(x) for k, v in config.items() for x in (str(k), str(v))]
    metrics.withColumn("config", F.create_map(*entries)).coalesce(1).write.mode(mode).json(path)


def write_statuses(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV lines of language, file and status."""
    runs.select("language", "file", "status").write.mode(mode).csv(path)


def problem_results(problems: DataFrame, runs: DataFrame, key: str = "task_id") -> DataFrame:
    """Problems without their completions, with the ordered results of their candidates."""
    fields = [c for c in ("program", "stdout", "stderr", "exit_code", "status") if c in runs.columns]
    ordered = F.array_sort(F.collect_list(F.struct("completion_id", F.struct(*fields).alias("result"))))
    results = runs.groupBy(key).agg(ordered.alias("r"))
    listed = results.select(key, F.transform("r", lambda x: x["result"]).alias("results"))
    return problems.drop("completions").join(listed, key)


def write_problem_results(problems: DataFrame, runs: DataFrame, path: str, mode: str = "errorifexists", key: str = "task_id") -> None:
    """One line per problem that has runs, without its completions, with the ordered results of its candidates.

    Unlike :func:`problem_results` no row holds all results of a problem.
    ``problems`` has one row per key.
    """
    fields = [c for c in ("program", "stdout", "stderr", "exit_code", "status") if c in runs.columns]
    kept = problems.drop("completions").join(runs.select(key), key, "left_semi")
    head = F.to_json(F.struct(*kept.columns))
    opening = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"results":['))
    heads = kept.select(key, F.lit(None).cast("bigint").alias("completion_id"), F.lit(0).alias("_kind"), opening.alias("_part"))
    results = runs.join(kept.select(key), key, "left_semi").select(
        key, F.col("completion_id").cast("bigint"), F.lit(1).alias("_kind"), F.to_json(F.struct(*fields)).alias("_part")
    )
    _write_lines(heads.unionByName(results), key, ["_kind", "completion_id"], None, F.col("_part"), 1, path, mode)


def write_predictions(
    df: DataFrame, text: str, path: str, delimiter: str = PREDICTION_DELIMITER, mode: str = "errorifexists", order: str | None = None
) -> None:
    """Predicted texts, each followed by the delimiter; with ``order`` the files in name order hold them in that order."""
    if order is not None:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    df.select(F.col(text).alias("value")).write.mode(mode).option("lineSep", delimiter).text(path)


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Results of all workers in one table; tasks write in parallel."""
    df.write.mode(mode).parquet(path)


def name_files(spark: SparkSession, folder: str, columns: Sequence[str], name: Callable[[list[str], int], str]) -> None:
    """Move the files of ``column=value`` folders to the paths that ``name(values, number)`` gives, below ``folder``.

    Names only, through the file system that holds them; the data stay.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pattern = "/".join(f"{c}=*" for c in columns) + "/part-*"
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}"))
    for number, status in enumerate(sorted(found, key=lambda s: s.getPath().toString())):
        path = status.getPath()
        values = [part.partition("=")[2] for part in path.toString().split("/")[-1 - len(columns) : -1]]
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name(values, number)}")
        fs.mkdirs(target.getParent())
        if not fs.rename(path, target):
            raise OSError(f"{path} could not be named {target}")
