"""SimHash near-dedup: fingerprints, and an exact Hamming join over vantage-point trees.

**Fingerprint.**  A-Z lowered, words between blanks, every shingle of
:data:`SHINGLE` words (repeats included) hashed by XXH64; bit by bit the
majority of all hashes.  A text of fewer words is one shingle; a null, empty or
blank text has fingerprint zero and is linked like any other.

**Join.**  Equal fingerprints collapse to one row first, so a text that is
copied a million times is one point.  The 64 bits are cut into segments with a
radius each, such that two fingerprints within :data:`BITS` bits differ in some
segment by at most its radius (the radii plus one add up to more than BITS).
Hamming distance on a segment is a metric, and each segment gets a vantage-point
tree: a vantage point from a bounded sample of fingerprints, the median distance
to it, the closer and the farther side, and so on.  A fingerprint is at home in
one leaf.  As a query it prunes the branches that the triangle inequality rules
out and visits every other shard its ball overlaps.  Small radii keep that
overlap small: about a third of the points at radius 1 per level, none at 0,
against two thirds for one tree on all 64 bits with radius 4.

**Shards.**  A leaf compares its residents with all its visitors over all 64
bits, exactly, with early exits: points already joined in the shard are not
compared again, so a family of thousands of near copies costs a few sweeps, and
a shard gives a spanning forest of its links, never all pairs.  Shards above
:data:`SHARD_ROWS` are cut into blocks whose pairs are tasks of their own.

Components of the links come from large-star and small-star rounds.  Of all
documents the driver sees counts, and a sample of :data:`SAMPLE` fingerprints.

Rows that repeat a key are rows of their own, null keys are kept (a component is
named by its smallest non-null key).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import free, map_rows, table
from millrace.operators.components import connected_components
from millrace.session import join_unique_side, materialize

SHINGLE = 4
BITS = 4
SEED = 42
#: (first bit, width, radius): 2 + 2 + 1 > 4.
SEGMENTS = ((0, 24, 1), (24, 24, 1), (48, 16, 0))
SAMPLE = 50_000
LEAF_ROWS = 512
MAX_LEVELS = 16
SHARD_ROWS = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n == 1:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # long texts in pieces: 64 bytes per shingle at a time
        piece = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed 64-bit number."""
    kind = df.schema[key].dataType.simpleString()

    def run(k, t):
        return k, _signed(fingerprint(t, shingle))

    return map_rows(df.select(F.col(key), F.col(text)), run, f"id {kind}, fp bigint")


def check_segments(segments: tuple, bits: int) -> None:
    covered = np.zeros(64, int)
    for first, width, _ in segments:
        covered[first : first + width] += 1
    if (covered != 1).any() or sum(r + 1 for _, _, r in segments) <= bits:
        raise ValueError(f"segments {segments} do not catch every pair within {bits} bits")


def _segment(fps: np.ndarray, first: int, width: int) -> np.ndarray:
    return (fps.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)


class Tree:
    """A vantage-point tree as two arrays: node i has children 2i+1 (closer) and 2i+2.

    A node whose sample cannot be split has radius -1: everything is farther.
    """

    def __init__(self, sample: np.ndarray, levels: int, radius: int):
        self.levels, self.radius = levels, radius
        self.points = np.zeros((1 << levels) - 1, np.uint64)
        self.medians = np.full((1 << levels) - 1, -1, np.int16)
        rng = np.random.default_rng(7)
        work = [(0, np.sort(sample))]
        while work:
            node, mine = work.pop()
            if node >= len(self.points) or not len(mine):
                continue
            # of a few candidates, the point whose distances are spread most evenly about their median
            best = None
            for point in mine[rng.integers(0, len(mine), 5)]:
                d = np.bitwise_count(mine ^ point).astype(np.int16)
                for median in {int(np.median(d)), int(np.median(d)) - 1}:
                    near = int((d <= median).sum())
                    edge = int(((d > median - radius) & (d <= median + radius)).sum())
                    cost = max(near, len(mine) - near) + edge
                    if best is None or cost < best[0]:
                        best = cost, point, median, d
            _, self.points[node], self.medians[node], d = best
            work.append((2 * node + 1, mine[d <= self.medians[node]]))
            work.append((2 * node + 2, mine[d > self.medians[node]]))

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for each leaf that a ball of the tree's radius about a value overlaps."""
        rows = np.arange(len(values))
        nodes = np.zeros(len(values), np.int64)
        home = np.ones(len(values), bool)
        for _ in range(self.levels):
            d = np.bitwise_count(values[rows] ^ self.points[nodes]).astype(np.int16)
            median = self.medians[nodes]
            near, far = d - self.radius <= median, d + self.radius > median
            closer = d <= median
            rows = np.concatenate([rows[near], rows[far]])
            home = np.concatenate([home[near] & closer[near], home[far] & ~closer[far]])
            nodes = np.concatenate([2 * nodes[near] + 1, 2 * nodes[far] + 2])
        return rows, nodes - len(self.points), home


def build_trees(points: DataFrame, count: int, segments: tuple, leaf_rows: int, sample: int) -> list[Tree]:
    """One tree per segment from a seeded sample of the distinct fingerprints."""
    share = min(1.0, 1.2 * sample / max(1, count))
    draw = F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))
    taken = points.filter(draw).select("fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    taken = np.sort(taken) if len(taken) else np.zeros(1, np.int64)
    levels = max(0, min(MAX_LEVELS, int(np.ceil(np.log2(max(1, count / leaf_rows))))))
    return [Tree(_segment(taken, first, width), min(levels, width), radius) for first, width, radius in segments]


def routed(points: DataFrame, trees: list[Tree], segments: tuple) -> DataFrame:
    """(tree, leaf, home, fp): residents and visitors of every leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(fps), 8_192):
                part = fps[at : at + 8_192]
                for number, (tree, (first, width, _)) in enumerate(zip(trees, segments)):
                    rows, leaves, home = tree.route(_segment(part, first, width))
                    yield pd.DataFrame({"tree": np.int32(number), "leaf": leaves.astype(np.int32), "home": home, "fp": part[rows]})

    return points.select("fp").mapInPandas(run, "tree int, leaf int, home boolean, fp bigint")


def shard_links(fps: np.ndarray, home: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of all links (at most ``bits`` differing bits) between residents and any point.

    Every resident starts a sweep unless another reached it.  Whatever a sweep
    reaches, residents and visitors, is compared with all points not reached
    yet, so a point that is gone for a later sweep has met its links before.
    """
    values = fps.view(np.uint64)
    order = np.lexsort((~home,))  # residents first
    values, resident = values[order], home[order]
    left = np.arange(len(values))
    links: list[tuple[int, int]] = []
    for root in np.flatnonzero(resident):
        if not len(left):
            break
        spot = np.searchsorted(left, root)
        if spot == len(left) or left[spot] != root:
            continue  # reached before
        left = np.delete(left, spot)
        front = [root]
        while front and len(left):
            at = front.pop()
            close = np.bitwise_count(values[left] ^ values[at]) <= bits
            if close.any():
                reached = left[close]
                left = left[~close]
                links.extend((int(fps[order[at]]), int(fps[order[r]])) for r in reached)
                front.extend(reached.tolist())
    return links


def fingerprint_links(
    points: DataFrame,
    count: int,
    bits: int = BITS,
    segments: tuple = SEGMENTS,
    leaf_rows: int = LEAF_ROWS,
    sample: int = SAMPLE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(src, dst) between distinct fingerprints, enough to connect whatever is within ``bits`` bits."""
    check_segments(segments, bits)
    trees = build_trees(points, count, segments, leaf_rows, sample)
    visits = materialize(routed(points, trees, segments))
    sizes = visits.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > shard_rows).select("tree", "leaf", F.ceil(F.col("n") / shard_rows).cast("int").alias("blocks"))
    # at most visits / shard_rows shards are large
    cut = visits.join(F.broadcast(large), ["tree", "leaf"], "left")
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(11)), blocks).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(own, b).alias("low"), F.greatest(own, b).alias("high"))
    )
    dealt = cut.select("tree", "leaf", "home", "fp", F.explode(others).alias("pair")).select("tree", "leaf", "pair.*", "home", "fp")

    def compare(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        found = shard_links(shard["fp"].to_numpy(np.int64), shard["home"].to_numpy(bool), bits)
        return pd.DataFrame(found, columns=["src", "dst"]).astype("int64")

    return dealt.groupBy("tree", "leaf", "low", "high").applyInPandas(compare, "src bigint, dst bigint").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE, **options) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id it is connected to."""
    marks = materialize(fingerprints(df, key, text, shingle))
    points = materialize(marks.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
    count = points.count()
    return named_components(marks, points, count, fingerprint_links(points, count, bits, **options))


def named_components(marks: DataFrame, points: DataFrame, count: int, links: DataFrame) -> DataFrame:
    """(id, fp, component) per row of ``marks``, given the links between points."""
    linked = connected_components(links)
    labelled = points.join(linked.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "low", "copies", F.coalesce("cluster", "fp").alias("cluster")
    )
    labelled = materialize(labelled)
    roots = labelled.groupBy("cluster").agg(F.min("low").alias("component"), F.count("*").alias("points"))
    named = join_unique_side(labelled, roots, ["cluster"], "points", rows_hot(count), count).select("fp", "copies", "component")
    return join_unique_side(marks, named, ["fp"], "copies", rows_hot(count)).select("id", "fp", "component")


def rows_hot(rows: int) -> int:
    """Copies from which a key goes through a broadcast: bounded by rows / this."""
    return max(10_000, rows // 10_000)


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component stays: the smallest key, and one row of it if several have it.

    Rows of null key stay only where their whole component has no key.
    """
    found = materialize(near_duplicates(df, key, text, **options))
    gone_key, mark = free(df, "_id"), free(df, "_fp")
    named = F.col("id").isNotNull() | F.col("component").isNull()
    gone = found.filter(~(F.col("id").eqNullSafe(F.col("component")) & named)).select(
        F.col("id").alias(gone_key), F.col("fp").alias(mark)
    )
    lost = materialize(gone.filter(F.col(gone_key).isNotNull()).select(gone_key).distinct())
    kept = df.join(lost, F.col(key) == F.col(gone_key), "left_anti")
    odd = gone.filter(F.col(gone_key).isNull()).select(mark).distinct()
    if not odd.isEmpty():
        # a null key does not tell rows apart; their fingerprints do
        nameless = fingerprints_beside(kept.filter(F.col(key).isNull()), text, mark).join(odd, mark, "left_anti").drop(mark)
        kept = kept.filter(F.col(key).isNotNull()).unionByName(nameless)
    repeated = found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 AND id IS NOT NULL")
    repeated = materialize(repeated.select(F.col("id").alias(gone_key)))
    if not repeated.isEmpty():
        again = F.col(key) == F.col(gone_key)
        once = kept.join(repeated, again, "left_semi").dropDuplicates([key])
        kept = kept.join(repeated, again, "left_anti").unionByName(once)
    return kept


def fingerprints_beside(df: DataFrame, text: str, mark: str) -> DataFrame:
    """``df`` with the fingerprint of each row as column ``mark``."""
    at = df.columns.index(text)

    def run(*row):
        return (*row, _signed(fingerprint(row[at])))

    return map_rows(df, run, df.select("*", F.lit(0).cast("bigint").alias(mark)).schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint in hex and the smallest doc_id it is connected to."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
