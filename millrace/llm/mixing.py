"""Mixing sources to target weights in blocks dealt by highest quotients.

Sources get shares of a token budget by weight; a share stops at a multiple of
what its source holds, and what is left over goes to the others by weight (the
water level is found from prefix sums over the sources ordered by the level at
which each is full).  The budget is cut into blocks of equal tokens.  Blocks go
to sources one by one to the highest quotient ``target / (2 * got + 1)``
(Sainte-Lague), so every prefix of the sequence has integer quotas close to the
targets; consecutive stretches of it are the shards.

Inside a source the documents stand in a seeded order, as one line of tokens
cut into blocks.  The source's blocks are taken in that order from a seeded
block on, round the end and over again, shard after shard.  What a document
gives to a shard is the overlap of two stretches of numbers: no document is
exploded, and only narrow rows (key, source, order, size) are ever shuffled.

A row of a null or empty text has size 0 and gives nothing.  A null source is a
source of its own, last in order.  Rows that repeat a key are rows of their
own.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from millrace.llm.common import free, table
from millrace.operators.prefix import hash_bucket, with_running_totals
from millrace.session import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
LIMIT = 2
SHARDS = 8
SEED = 17
#: Blocks that the smallest source is cut into, and the largest block.
SMALLEST_BLOCKS = 256
BLOCK = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def everything() -> WindowSpec:
    """One window over a table of sources."""
    return Window.partitionBy(F.lit(0))


def seeded(value: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))))


def sized(df: DataFrame, key: str, text: str, source: str, seed: int = SEED) -> DataFrame:
    """(key, source, source_key, order_key, size, tie): the only pass over the texts; tie is a digest."""
    return df.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("source_key"),
        seeded(F.col(key), seed).alias("order_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(text)).alias("tie"),
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, limit: float = LIMIT
) -> DataFrame:
    """One row per source: its size, weight, and target in tokens.  A table of as many rows as sources."""
    totals = sizes.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(everything().orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select(
        "*",
        cycle[F.pmod(F.col("rank") - 1, F.lit(len(weights)))].alias("weight"),
        (F.col("source_size") * F.lit(limit)).alias("most"),
        (F.sum("source_size").over(everything()) * F.lit(budget)).alias("budget"),
    ).withColumn("full_at", F.col("most") / F.col("weight"))
    order = everything().orderBy("full_at", "rank")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", (F.col("budget") - before) / rest)
    # levels fall from the first source that does not fill up, so that one has the largest
    water = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(everything())
    share = F.coalesce(F.least(F.col("most").cast("double"), water * F.col("weight")), F.col("most").cast("double"))
    return levelled.withColumn("target", share).drop("level", "full_at", "most")


def block_quotas(
    targets: DataFrame, shards: int = SHARDS, limit: int = LIMIT, block: int = BLOCK, smallest_blocks: int = SMALLEST_BLOCKS
) -> DataFrame:
    """One row per source: block size, number of blocks, and the blocks it has got after each shard.

    The number a source gets is known up to a few blocks from its share; only
    the quotients of those few are ranked, about seven rows per source and shard.
    """
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything())
    cut = targets.withColumn(
        "block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce(smallest, F.lit(1)) / smallest_blocks))).cast("bigint")
    ).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
    planned = cut.select(
        "*",
        F.floor(F.col("budget") / F.col("block") + 0.5).cast("bigint").alias("seats"),
        F.count("*").over(everything()).alias("sources"),
    )
    by_shard = planned.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn(
        "due", F.floor(F.col("seats") * F.col("shard") / F.lit(shards) + 0.5).cast("bigint")
    )
    share = F.col("target") / F.col("budget")
    spread = F.ceil(share * F.col("sources") + 2).cast("bigint")
    top = (F.col("blocks") * F.lit(limit)).cast("bigint")
    near = F.least(top, F.floor(share * F.col("due") + 0.5).cast("bigint"))
    started = by_shard.filter("target > 0").select(
        "source_key", "rank", "target", "shard", "due",
        F.greatest(F.lit(0), near - spread).cast("bigint").alias("base"), spread.alias("spread"), top.alias("top"),
    )
    in_shard = Window.partitionBy("shard")
    opened = started.withColumn("open", F.col("due") - F.sum("base").over(in_shard)).withColumn(
        "last", F.least(F.col("top"), F.col("base") + 2 * F.col("spread") + 1) - 1
    )
    offered = opened.filter("last >= base").select(
        "source_key", "rank", "shard", "open", "target", F.explode(F.sequence("base", "last")).alias("got")
    )
    best = in_shard.orderBy((F.col("target") / (2 * F.col("got") + 1)).desc(), "rank", "got")
    won = offered.withColumn("place", F.row_number().over(best)).filter("place <= open").groupBy("source_key", "shard").agg(F.count("*").alias("won"))
    counted = started.join(won, ["source_key", "shard"], "left").select(
        "source_key", "shard", (F.col("base") + F.coalesce("won", F.lit(0))).alias("got")
    )
    ends = counted.groupBy("source_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "got"))), lambda s: s["got"]).alias("ends")
    )
    none = F.array(*[F.lit(0).cast("bigint")] * shards)
    return cut.join(ends, "source_key", "left").withColumn("ends", F.coalesce("ends", none))


def _overlap(low: Column, high: Column) -> Column:
    start, end = F.col("start"), F.col("start") + F.col("size")
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    limit: int = LIMIT,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(key, source, size, source_size, target, shard_tokens, tie) per row of ``df``.

    ``shard_tokens`` has what the row gives to each shard, repeats counted;
    never more than ``limit`` times its size in all.
    """
    sizes = materialize(sized(df, key, text, source, seed))
    quotas = block_quotas(source_targets(sizes, weights, budget, limit), shards, limit).select(
        "source_key", "source_size", "target", "block", "blocks", "ends",
        (F.conv(F.substring(seeded(F.col("source"), seed), 1, 8), 16, 10).cast("bigint") % F.greatest(F.col("blocks"), F.lit(1))).alias("first"),
    )
    placed = with_running_totals(
        sizes, {"start": "size"}, ["order_key", "size", "tie"], hash_bucket("order_key", 3), ["source_key"]
    )
    joined = placed.join(quotas, "source_key")

    def given(seats: Column) -> Column:
        """Tokens of the row in the first so many blocks of its source."""
        blocks = F.greatest(F.col("blocks"), F.lit(1))
        rounds, extra = F.floor(seats / blocks).cast("bigint"), seats % blocks
        low, high = F.col("first") * F.col("block"), (F.col("first") + extra) * F.col("block")
        return rounds * F.col("size") + _overlap(low, high) + _overlap(F.lit(0), high - blocks * F.col("block"))

    upto = F.transform("ends", lambda e: given(e))
    per_shard = F.zip_with(
        F.col("upto"), F.concat(F.array(F.lit(0).cast("bigint")), F.slice("upto", 1, shards - 1)), lambda a, b: a - b
    )
    return joined.withColumn("upto", upto).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", per_shard.alias("shard_tokens"), "tie"
    )


def total(tokens: Column | str) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, b: a + b)


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with size, source_size, target, taken and shard_tokens.

    Columns of these names are replaced.  Rows that repeat key and text share
    evenly in what the mix takes of them, rounded down.
    """
    shards = options.get("shards", SHARDS)
    found = mix(df, key, text, **options)
    numbers = ("size", "source_size", "target", "shard_tokens")
    own = df.select(*[c for c in df.columns if c not in (*numbers, "taken")])
    key_of, tie_of = free(own, "_key"), free(own, "_tie")
    shared = F.array(*[F.floor(F.sum(F.get("shard_tokens", F.lit(i))) / F.count("*")).cast("bigint") for i in range(shards)])
    best = found.groupBy(F.col(key).alias(key_of), F.col("tie").alias(tie_of)).agg(
        *[F.first(c).alias(f"_mix_{c}") for c in numbers[:-1]], shared.alias("_mix_shard_tokens")
    )
    same = F.col(key).eqNullSafe(F.col(key_of)) & (F.xxhash64(F.col(text)) == F.col(tie_of))
    joined = own.alias("own").join(best.alias("mix"), same)
    taken = total(F.col("mix._mix_shard_tokens")).alias("taken")
    return joined.select("own.*", *[F.col(f"mix._mix_{c}").alias(c) for c in numbers], taken)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", total("shard_tokens").alias("taken")
    )


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS order_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{", ".join(f"{float(w)}" for w in WEIGHTS)}][CAST((rank - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * {BUDGET} AS budget,
         greatest(1, least({BLOCK}, coalesce(min(CASE WHEN source_size > 0 THEN source_size END) OVER (), 1) // {SMALLEST_BLOCKS})) AS block,
         count(*) OVER () AS sources
  FROM sources),
levels AS (
  SELECT *, (budget - coalesce(CAST(sum({LIMIT} * source_size) OVER (ORDER BY {LIMIT} * source_size / weight, rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
            / sum(weight) OVER (ORDER BY {LIMIT} * source_size / weight, rank
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT *, CAST(coalesce(least({LIMIT} * source_size, weight * max(CASE WHEN {LIMIT} * source_size / weight > level THEN level END) OVER ()),
                     {LIMIT} * source_size) AS DOUBLE) AS target,
         CAST(ceil(source_size / block) AS BIGINT) AS blocks
  FROM levels),
-- every quotient of every block that a source could get, ranked
quotients AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * got + 1) DESC, rank, got) AS place, budget, block
  FROM (SELECT rank, target, budget, block, unnest(range(0, {LIMIT} * blocks)) AS got FROM targets WHERE target > 0)),
seats AS (
  SELECT rank, count(*) AS seats FROM quotients WHERE place <= floor(budget / block + 0.5) GROUP BY rank),
plan AS (
  SELECT t.source, source_size, target, block, greatest(blocks, 1) AS blocks, coalesce(seats, 0) AS seats,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(t.source, 'null')), 1, 8) AS BIGINT) % greatest(blocks, 1) AS first
  FROM targets t LEFT JOIN seats USING (rank)),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY order_key, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized)
SELECT doc_id, size, source_size, target,
       CAST((seats // blocks) * size
         + greatest(0, least(start + size, (first + seats % blocks) * block) - greatest(start, first * block))
         + greatest(0, least(start + size, (first + seats % blocks - blocks) * block) - start) AS BIGINT) AS taken
FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source
"""
