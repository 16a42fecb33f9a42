"""Session helpers shared by the operators: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "millrace") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a local master
    without that setting (tests) gets a temporary folder; a cluster without
    it is an error, because a machine-local folder dies with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and unlike an RDD checkpoint is
    columnar: later passes read only the columns they use.  The folder's
    retention is the cluster's, as for any checkpoint.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """Use all cores on an input too small to be split by the scan.

    A table of a few files or row groups reads in a few tasks.  Below
    ``max_bytes`` (the planner's estimate) it is dealt out over the cores
    before costly per-row work; anything larger already reads in many tasks
    and stays where it is, unshuffled.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > max_bytes:
        return df  # before its files are listed, of which there may be a million
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Meant for small derived tables that were materialized, so that the count
    reads file footers.  Past the bound the frame comes back without a hint and
    the join is a shuffled one.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint that the join with ``df`` moves both sides by key and broadcasts neither.

    The planner takes the rows that leave a generator or an Arrow function to
    be as many as went in, and a table to be as large as its compressed files.
    Where one row becomes many it would broadcast what only looks small, and a
    broadcast that was planned is not taken back when the real size is known.
    """
    return df.hint("merge")


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the result has the left side's keys once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in on])


def join_unique_side(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    rows_col: str,
    hot_rows: int = 1_000_000,
    left_rows: int | None = None,
) -> DataFrame:
    """Inner join of ``left`` with a ``right`` side that has one row per key.

    ``right[rows_col]`` counts the left rows of that key.  Keys above
    ``hot_rows`` go through a broadcast: there are at most
    ``count(left) / hot_rows`` of them, so the broadcast side is bounded, and
    the hot left rows stay where they are instead of meeting in one task.
    All other keys take the shuffled join, with at most ``hot_rows`` rows each.
    A caller that knows ``left_rows`` to be within ``hot_rows`` gets the plain
    join: no key can be hot then.
    """
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right.drop(rows_col), on, "inner")
    hot = right.filter(F.col(rows_col) > hot_rows).drop(rows_col)
    cold = right.filter(F.col(rows_col) <= hot_rows).drop(rows_col)
    return left.join(cold, on, "inner").unionByName(left.join(F.broadcast(hot), on, "inner"))
