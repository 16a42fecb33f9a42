"""Connected components of an edge table, labelled by their smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import join_unique_side, materialize

MAX_ROUNDS = 60


def _to_smallest(links: DataFrame, hot_rows: int, rows: int, larger_only: bool) -> DataFrame:
    """Hang the neighbours of every node onto the smallest of them and the node itself.

    ``links`` holds (u, v).  The smallest neighbour is a map-side combined
    aggregate; handing it back to the neighbours splits hot nodes off.
    """
    lowest = links.groupBy("u").agg(
        F.least(F.col("u"), F.min("v")).alias("low"), F.count("*").alias("_rows")
    )
    linked = join_unique_side(links, lowest, ["u"], "_rows", hot_rows, rows)
    out = linked.select(F.col("v").alias("a"), F.col("low").alias("b"))
    if larger_only:
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    own = lowest.select(F.col("u").alias("a"), F.col("low").alias("b"))
    return out.unionByName(own)


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", hot_rows: int = 1_000_000, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(id, cluster) for every id that occurs in an edge; cluster is the smallest id reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which
    keep the number of edges from growing and need few rounds even on long
    chains.  Every round is written to the shared folder; the loop ends when a
    round leaves the edge set as it was.
    """
    high, low = F.greatest(src, dst), F.least(src, dst)
    current = edges.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct()
    current = materialize(current)
    rows, before = current.count(), None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, hot_rows, 2 * rows, larger_only=True).filter("a <> b").distinct()
        downward = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _to_smallest(downward, hot_rows, 2 * rows, larger_only=False).filter("a <> b").distinct()
        current = materialize(small.select(F.col("a").alias("u"), F.col("b").alias("v")))
        state = tuple(
            current.agg(
                F.count("*"),
                F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)),
                F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)),
            ).first()
        )
        if state == before:
            break
        rows, before = state[0], state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("cluster")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("cluster")).unionByName(roots)
