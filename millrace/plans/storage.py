"""Write-and-read-back queries: shards, unified parquet, splits, candidates, results, id files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.keys import order_hash
from millrace.functions.text import estimate_tokens
from millrace.operators import budget, pack, passk
from millrace.operators.extract import unify
from millrace.plans.mixing import UNIFY_SQL, turn_pairs, unify_input
from millrace.plans.registry import ORACLES, TOKEN_DOCS, mixed_documents, query, rounded, sql_order, table
from millrace.plans.scoring import RUNS_SQL, classified
from millrace.session import ensure_checkpoint_dir
from millrace.sources import readers, writers


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT source, lang, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def shard_roundtrip(spark, sf_dir):
    path = _folder(spark, "shards")
    writers.write_shards(mixed_documents(spark, sf_dir), path, records=500)
    back = readers.read_shards(spark, path)
    return back.groupBy("source", F.col("meta")["lang"].alias("lang")).agg(
        F.count("*").alias("records"), F.sum(F.length("text")).alias("chars")
    )


@query(f"WITH {UNIFY_SQL} SELECT source_dataset, count(*) AS records FROM unified GROUP BY source_dataset")
def unified_roundtrip(spark, sf_dir):
    path = _folder(spark, "unified")
    writers.write_unified(unify(unify_input(spark, sf_dir)), path, writers.GROUP_RECORDS)
    # Only one column is read back.
    return spark.read.parquet(path).groupBy("source_dataset").agg(F.count("*").alias("records"))


@query("""
SELECT lang AS language, count(*) AS records, count(*) FILTER (doc_id % 2 = 0) AS with_code, CAST(0 AS BIGINT) AS with_ir,
  CAST(sum(CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END) AS BIGINT) AS est_tokens, CAST(6 AS BIGINT) AS n_columns FROM documents GROUP BY lang""")
def unified_fill(spark, sf_dir):
    """Absent columns come back as null, absent and null token counts as 0."""
    path = _folder(spark, "filled")
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("source_code"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("est_tokens"), F.lit("x").alias("unknown"),
    )
    writers.write_unified(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy("language").agg(
        F.count("*").alias("records"), F.count("source_code").alias("with_code"), F.count("llvm_ir").alias("with_ir"),
        F.sum(F.when(F.col("est_tokens").isNotNull(), F.col("est_tokens"))).alias("est_tokens"),
    ).withColumn("n_columns", F.lit(len(back.columns)).cast("bigint"))


@query(ORACLES["split_random"])
def split_roundtrip(spark, sf_dir):
    path = _folder(spark, "splits")
    writers.write_splits(pack.split_random(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05), path)
    return readers.read_splits(spark, path).select("doc_id", "split")


@query("""
SELECT CAST(conv_id AS VARCHAR) AS task_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS completion_id, text AS completion
FROM conversations WHERE role = 'assistant'""")
def candidate_roundtrip(spark, sf_dir):
    path = _folder(spark, "candidates")
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    numbered = passk.number_samples(answers, ["conv_id"], "turn")
    writers.write_candidates(
        numbered.select(
            F.col("conv_id").alias("task_id"), F.col("sample_id").alias("completion_id"), F.col("text").alias("completion")
        ),
        path,
    )
    back = readers.read_candidate_lines(spark, path)
    return back.select("task_id", F.col("completion_id").cast("bigint").alias("completion_id"), "completion")


@query(f"""
WITH {RUNS_SQL} SELECT task_id, count(*) AS n_results, string_agg(status, ',' ORDER BY event_id) AS statuses FROM classified GROUP BY task_id""")
def problem_results(spark, sf_dir):
    runs = classified(spark, sf_dir).withColumn("completion_id", F.col("event_id"))
    tasks = runs.select("task_id").distinct()
    path = _folder(spark, "results")
    writers.write_problem_results(tasks, runs, path)
    back = spark.read.schema("task_id bigint, results array<struct<status: string>>").json(path)
    return back.select(
        "task_id",
        F.size("results").cast("bigint").alias("n_results"),
        F.array_join(F.transform("results", lambda r: r["status"]), ",").alias("statuses"),
    )


@query("""
SELECT CAST(item_id AS VARCHAR) AS id, regexp_replace(split_part(replace(text, chr(10), ' '), chr(9), 1), '\\s+$', '') AS text FROM benchmark""")
def id_text_roundtrip(spark, sf_dir):
    path = _folder(spark, "ids")
    rows = table(spark, sf_dir, "benchmark").select(
        F.concat_ws("\t", F.col("item_id").cast("string"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value")
    )
    rows.write.text(path)
    return readers.read_id_text(spark, path)


PAIRED = """paired AS (SELECT a.conv_id, a.turn, a.text AS asked, b.text AS answered, 'L' || CAST(a.conv_id % 3 AS VARCHAR) AS language,
  CASE WHEN a.turn % 4 = 0 THEN 'Perf_Optimized' ELSE 'Size_Optimized' END AS ir_type
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"""


def stored_pair_groups(spark, sf_dir) -> str:
    """User turns with their answers as ``<language>/<IR type>-n.parquet``."""
    path = _folder(spark, "groups")
    pairs = turn_pairs(spark, sf_dir).select(
        F.col("asked").alias("Source_Code"),
        F.col("answered").alias("IR_Original"),
        F.concat(F.lit("L"), (F.col("conv_id") % 3).cast("string")).alias("language"),
        F.when(F.col("turn") % 4 == 0, "Perf_Optimized").otherwise("Size_Optimized").alias("kind"),
    )
    pairs.write.partitionBy("language", "kind").parquet(path)
    writers.name_files(spark, path, ["language", "kind"], lambda values, n: f"{values[0]}/{values[1]}-{n:05d}.parquet")
    return path


@query(f"WITH {PAIRED} SELECT language, ir_type, asked, answered FROM paired")
def pair_groups(spark, sf_dir):
    back = readers.read_pair_groups(spark, stored_pair_groups(spark, sf_dir))
    return back.select("language", "ir_type", F.col("Source_Code").alias("asked"), F.col("IR_Original").alias("answered"))


@query(f"WITH {PAIRED} SELECT language, ir_type, count(*) AS n_rows FROM paired GROUP BY ALL")
def pair_group_counts(spark, sf_dir):
    return readers.group_row_counts_from_footers(spark, stored_pair_groups(spark, sf_dir))


PROBES = 16


@query(f"""
WITH {TOKEN_DOCS}, parts AS (SELECT lang, source, est_tokens, CAST(('0x' || substr({sql_order('doc_id', 42)}, 1, 1)) AS INTEGER) AS part FROM docs),
firsts AS (SELECT lang, min(part) AS part FROM parts GROUP BY lang),
probe AS (SELECT lang, count(est_tokens) AS probed_rows, avg(est_tokens) AS avg_tokens, coalesce(stddev_samp(est_tokens) / sqrt(count(*)), 0) AS error
  FROM parts JOIN firsts USING (lang, part) WHERE est_tokens > 0 GROUP BY lang),
sizes AS (SELECT lang, count(*) AS n_rows FROM parts GROUP BY lang)
SELECT lang, n_rows, coalesce(probed_rows, 0) AS probed_rows, round(coalesce(avg_tokens, 0), 6) AS avg_tokens, round(coalesce(error, 0), 6) AS error,
  CAST(floor(n_rows * coalesce(avg_tokens, 0)) AS BIGINT) AS available FROM sizes LEFT JOIN probe USING (lang)""")
def file_availability(spark, sf_dir):
    """What each language can supply, from one of its 16 files."""
    path = _folder(spark, "probe")
    part = F.conv(F.substring(order_hash("doc_id", 42), 1, 1), 16, 10).cast("int")
    docs = table(spark, sf_dir, "documents").select("lang", "text", part.alias("part"))
    # as many files a group as there are parts, whatever wrote them
    docs.repartition("lang", "part").write.partitionBy("lang", "part").parquet(path)
    writers.name_files(spark, path, ["lang", "part"], lambda values, _: f"{values[0]}/{int(values[1]):02d}.parquet")
    files: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()):
        files.setdefault((file.split("/")[-2],), []).append(file)
    tokens = estimate_tokens("text")
    found = budget.availability_of_files(spark, files, ["lang"], tokens, tokens > 0)
    return rounded(found, "avg_tokens", "error")


@query(f"""
WITH numbered AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY {sql_order('doc_id', 42)}) - 1 AS i FROM documents)
SELECT source, i // 20 AS shard, count(*) AS records FROM numbered GROUP BY ALL""")
def exact_shards(spark, sf_dir):
    path = _folder(spark, "exact")
    writers.write_shards(mixed_documents(spark, sf_dir), path, records=20, order="order_key")
    back = readers.read_shards(spark, path).withColumn("file", readers.shard_name())
    per_file = back.groupBy("source", "file").agg(F.count("*").alias("records"))
    return per_file.select("source", writers.shard_number(F.col("file")).alias("shard"), "records")


@query("""
WITH tasks AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id) - 1 AS task_id FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT CAST(c.conv_id % 4 AS BIGINT) AS part, t.task_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS completion_id, c.text AS completion
FROM conversations c JOIN tasks t USING (conv_id)""")
def generation_values(spark, sf_dir):
    """Four files, each one JSON value, a list per conversation."""
    path = _folder(spark, "generations")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    lists = turns.select("conv_id", (F.col("conv_id") % 4).alias("part"), F.to_json(F.transform("t", lambda x: x["text"])).alias("json"))
    inside = Window.partitionBy("part").orderBy("conv_id")
    opening = F.when(F.row_number().over(inside) == 1, F.lit("[")).otherwise(F.lit(","))
    closing = F.when(F.lead(F.lit(True)).over(inside).isNull(), F.lit("]")).otherwise(F.lit(""))
    # one value a file is the format's demand; its lines are written in order, part by part
    lines = lists.select("part", F.concat(opening, "json", closing).alias("value"))
    lines.write.partitionBy("part").text(path)
    back = readers.read_generations(spark, path, file="file")
    return back.select(
        F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part"),
        F.col("task_id").cast("bigint").alias("task_id"),
        F.col("completion_id").cast("bigint").alias("completion_id"),
        "completion",
    )


@query("SELECT lang AS split, doc_id, source FROM documents")
def split_files(spark, sf_dir):
    """Files named by their split, read back with the name as a column."""
    path = _folder(spark, "stems")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("name"))
    docs.repartition("name").write.partitionBy("name").parquet(path)
    writers.name_files(spark, path, ["name"], lambda values, _: f"{values[0]}.parquet")
    return readers.read_splits(spark, path).select("split", "doc_id", "source")


@query("SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 2 = 1")
def named_datasets(spark, sf_dir):
    """A named dataset by subset and split, and a benchmark by revision."""
    root = _folder(spark, "named")
    items = table(spark, sf_dir, "benchmark")
    even = items.withColumn("split", F.when(F.col("item_id") % 2 == 0, "test").otherwise("train"))
    writers.write_splits(even, f"{root}/bench/core")
    items.filter("item_id % 2 = 1").write.parquet(f"{root}/bench/v2")
    test = readers.read_named(spark, root, "bench", "core", "test").select("item_id", "text")
    revised = readers.read_benchmark(spark, root, "bench", "v2")
    if revised is None or readers.read_benchmark(spark, root, "bench", "v3") is not None:
        raise ValueError("a revision was taken for another")
    return test.unionByName(revised.select("item_id", "text"))


@query("SELECT doc_id, text FROM documents WHERE lang = 'de' AND doc_id % 10 <> 0")
def supervised_rows(spark, sf_dir):
    path = _folder(spark, "supervised")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    marked = docs.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    marked.write.partitionBy("language", "split").parquet(path)
    return readers.read_supervised(spark, path, "de", "train").select("doc_id", "text")


@query("SELECT count(*) AS records, count(DISTINCT source) AS sources, '7' AS seed, 'sampled' AS mode FROM documents")
def metrics_file(spark, sf_dir):
    path = _folder(spark, "metrics")
    found = table(spark, sf_dir, "documents").agg(F.count("*").alias("records"), F.countDistinct("source").alias("sources"))
    writers.write_metrics(found, {"seed": 7, "mode": "sampled"}, path)
    schema = "records bigint, sources bigint, config map<string, string>"
    return spark.read.schema(schema).json(path).select("records", "sources", F.col("config")["seed"].alias("seed"), F.col("config")["mode"].alias("mode"))


@query("SELECT item_id, length(text) AS chars FROM benchmark UNION ALL SELECT page_id, length(html) FROM pages")
def result_table(spark, sf_dir):
    """Two workers append to one table."""
    path = _folder(spark, "appended")
    for name, key, text in (("benchmark", "item_id", "text"), ("pages", "page_id", "html")):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("item_id"), F.length(text).cast("bigint").alias("chars"))
        writers.write_results(rows, path)
    return spark.read.parquet(path)


@query("""
SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, text FROM benchmark""")
def ordered_prediction_lines(spark, sf_dir):
    path = _folder(spark, "ordered")
    writers.write_predictions(table(spark, sf_dir, "benchmark"), "text", path, order="item_id")
    lines = spark.read.option("lineSep", writers.PREDICTION_DELIMITER).text(path).select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("id"))
    # the files are named in order of their ranges
    placed = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file_name", "id")) - 1
    return lines.select(placed.cast("bigint").alias("place"), F.col("value").alias("text"))


@query("SELECT text FROM benchmark")
def prediction_lines(spark, sf_dir):
    path = _folder(spark, "predictions")
    writers.write_predictions(table(spark, sf_dir, "benchmark"), "text", path)
    return spark.read.option("lineSep", writers.PREDICTION_DELIMITER).text(path).withColumnRenamed("value", "text")


@query(f"WITH {RUNS_SQL} SELECT language, CAST(event_id AS VARCHAR) AS file, status FROM classified")
def status_csv(spark, sf_dir):
    path = _folder(spark, "statuses")
    writers.write_statuses(classified(spark, sf_dir).withColumn("file", F.col("event_id").cast("string")), path)
    return spark.read.schema("language string, file string, status string").csv(path)
