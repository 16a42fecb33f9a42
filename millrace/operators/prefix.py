"""Running totals over an ordered table without sending a whole group to one task.

The order is cut into consecutive buckets.  Bucket totals are a small table;
a window over it gives each bucket's offset, and a second window inside each
bucket gives the offset of each row.  Every task sees one bucket, never one
group, so a source holding a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import col

# 16^4 buckets of an evenly spread hash: about 50,000 rows each at 3 billion rows.
HASH_BUCKET_DIGITS = 4
ROWS_PER_BUCKET = 200_000
#: Bounds are a literal of the plan, so their number is limited; beyond it buckets
#: grow with the table (200,000 rows each up to 13 billion rows).
MAX_BUCKETS = 65_536
SAMPLES_PER_BUCKET = 16
SEPARATORS = ("\n", "\x00", "\x01", "\x1f")
ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "date", "timestamp")


@dataclass(frozen=True)
class Bounds:
    """Ascending upper bounds of ranges, as text, with the type to cast them to."""

    values: tuple[str, ...] = ()
    kind: str = "bigint"


def hash_bucket(order_hash: Column | str, digits: int = HASH_BUCKET_DIGITS) -> Column:
    """Leading hex digits; sorts like the hash itself."""
    return F.substring(col(order_hash), 1, digits)


def array_literal(values: Sequence, kind: str) -> Column:
    """A constant array that reaches the planner as one string, however long it is.

    Values that hold every separator are left out; among bounds that is one cut less.
    """
    texts = [str(v) for v in values]
    sep = min(SEPARATORS, key=lambda c: sum(c in t for t in texts))
    texts = [t for t in texts if sep not in t]
    return F.split(F.lit(sep.join(texts)), sep).cast(f"array<{kind}>")


def range_bounds(
    df: DataFrame,
    order: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
    weight: Column | None = None,
    weight_per_bucket: int = 1 << 26,
) -> Bounds:
    """Upper bounds that split ``order`` into even ranges, none for a small table.

    Works alike for every number, text, date and timestamp column, and raises
    for other types at any size.  The number of buckets follows from the rows
    and, if given, the summed ``weight``.  The bounds are quantiles of a seeded
    sample of keys, at most about ``SAMPLES_PER_BUCKET`` per bucket.
    """
    kind = df.schema[order].dataType.simpleString()
    if kind.split("(")[0].removesuffix("_ntz") not in ORDERED:
        raise ValueError(f"{order} has type {kind}, which cannot be cut into ranges")
    size = F.lit(0) if weight is None else weight.cast("double")
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0.0))).first()
    buckets = min(max_buckets, max(-(-rows // rows_per_bucket), int(total // weight_per_bucket) + 1))
    if buckets < 2:
        return Bounds(kind=kind)
    share = min(1.0, 1.2 * SAMPLES_PER_BUCKET * buckets / rows)
    drawn = F.pmod(F.xxhash64(order, F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = df.filter(F.col(order).isNotNull() & drawn).select(order).orderBy(order)
    sample = [r[0] for r in keys.select(F.col(order).cast("string")).limit(2 * SAMPLES_PER_BUCKET * buckets).collect()]
    cuts = (sample[i * len(sample) // buckets] for i in range(1, buckets)) if sample else ()
    return Bounds(tuple(dict.fromkeys(cuts)), kind)


def range_bucket(order: Column | str, bounds: Bounds | Sequence[int]) -> Column:
    """Number of bounds below the value: a binary search over one array literal.  Null is in the first bucket."""
    if not isinstance(bounds, Bounds):
        bounds = Bounds(tuple(map(str, bounds)))
    if not bounds.values:
        return F.lit(0)
    table = array_literal(bounds.values, bounds.kind)
    size, step = F.size(table), 1
    steps = []
    while step <= len(bounds.values):
        steps.insert(0, step)
        step *= 2
    value = col(order)

    def descend(below: Column, width: Column) -> Column:
        probe = below + width
        return F.when((probe <= size) & (F.get(table, probe - 1) < value), probe).otherwise(below)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), descend)
    return F.coalesce(found, F.lit(0))


def with_running_totals(
    df: DataFrame,
    values: dict[str, Column | str],
    order: Sequence[str],
    bucket: Column,
    group: Sequence[str] = (),
) -> DataFrame:
    """Add, for each entry of ``values``, the sum over all *preceding* rows of the group.

    ``bucket`` must be monotone in ``order``.  ``df`` should be narrow: the
    whole of it is shuffled by (group, bucket).
    """
    group = list(group)
    keys = [*group, "_bucket"]
    marked = df.withColumn("_bucket", bucket)
    for name, value in values.items():
        marked = marked.withColumn(f"_v_{name}", col(value).cast("bigint"))
    totals = marked.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = offsets.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    # null-safe: rows of a null group are a group of their own
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = marked.join(named, same)
    for name in values:
        local = F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0))
        joined = joined.withColumn(name, F.col(f"_o_{name}") + local)
    return joined.drop("_bucket", *[f"_k_{k}" for k in keys], *[f"_{p}_{n}" for n in values for p in "vo"])
