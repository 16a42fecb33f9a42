"""Order MinHash fingerprints of documents.

A text becomes tokens: its runs of non-blank characters, long ones in pieces of
:data:`PIECE`.  Every token starts a k-mer of two tokens (shorter at the end of
the text), and equal k-mers of a text are numbered by occurrence.  Each of
:data:`SKETCHES` hash functions, seeded on its own, gives every numbered k-mer a
value, selects the :data:`TUPLE` smallest, puts them back into text order and
hashes the tuple of their k-mers.  Moving or editing text changes k-mers, their
numbers or their order, so the share of equal tuples follows edit distance rather
than set overlap alone (Marcais et al. 2019); its standard error is
sqrt(p (1 - p) / SKETCHES).

No k-mer is left out, and every function orders all of them by a mixed hash of
its own.  A text's values are a matrix, functions by k-mers, built in blocks of
:data:`BLOCK` k-mers inside Arrow batches, so memory does not grow with the text.
Nothing is shuffled but the documents themselves, once, with their sketch, to
stand beside their neighbour.  (In DataFrame operations alone the same minima cost
more CPU time than there is: lambdas over arrays are interpreted, and an
aggregate over all k-mers and functions that keeps the second smallest exactly
needs two minima for every bit of a position.)

A null text is an empty one; all empty texts have one fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, table
from millrace.operators.prefix import range_bounds, range_bucket

PIECE = 8
SKETCHES = 64
TUPLE = 2
#: K-mers of a block of the matrix: 64 functions take 2 MB.
BLOCK = 4096
ROWS_PER_BUCKET = 4096
CHARS_PER_BUCKET = 1 << 24
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
HALF = np.uint64(32)
LARGEST = np.uint64((1 << 64) - 1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers in which every bit depends on all bits."""
    values = (values ^ (values >> HALF)) * ODD[0]
    values = (values ^ (values >> HALF)) * ODD[1]
    return values ^ (values >> HALF)


def seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * ODD[2])


class Sketcher:
    """Sketches of texts; hashes of tokens are remembered while there are not too many."""

    def __init__(self, count: int = SKETCHES, piece: int = PIECE, block: int = BLOCK):
        self.seeds, self.block = seeds(count)[:, None], block
        self.token = re.compile(rf"[^\x20\x09-\x0D]{{1,{piece}}}")
        self.known: dict[str, int] = {}

    def hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))

    def kmers(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Per token the hash of its k-mer, and of the k-mer with its number among equal ones."""
        first = self.hashes(self.token.findall(text))
        then = np.zeros_like(first)
        then[:-1] = first[1:]
        kmers = mixed(first * ODD[2] + mixed(then))
        order = np.argsort(kmers, kind="stable")
        grouped = kmers[order]
        starts = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]]) if len(kmers) else np.zeros(0, np.int64)
        numbers = np.empty(len(kmers), np.uint64)
        numbers[order] = np.arange(len(kmers)) - np.repeat(starts, np.diff(np.r_[starts, len(kmers)]))
        return kmers, mixed(kmers + numbers * ODD[2])

    def smallest(self, marks: np.ndarray) -> np.ndarray:
        """Places of the :data:`TUPLE` smallest values of every function, in text order; -1 where there are fewer."""
        rows = np.arange(len(self.seeds))
        values = np.full((len(rows), TUPLE), LARGEST)
        places = np.full((len(rows), TUPLE), -1, np.int64)
        for at in range(0, len(marks), self.block):
            drawn = mixed(marks[None, at : at + self.block] ^ self.seeds)
            found, spots = [values], [places]
            for _ in range(min(TUPLE, drawn.shape[1])):
                low = drawn.argmin(axis=1)
                found.append(drawn[rows, low][:, None])
                spots.append(low[:, None] + at)
                drawn[rows, low] = LARGEST
            values, places = np.hstack(found), np.hstack(spots)
            best = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
            values, places = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
        return np.sort(places, axis=1)

    def sketch(self, text: str | None) -> bytes:
        """One 32-bit hash per function, big-endian."""
        kmers, marks = self.kmers(text or "")
        places = self.smallest(marks)
        out = self.seeds[:, 0].copy()
        for column in places.T:
            there = column >= 0
            out[there] = mixed(out[there] * ODD[0] + kmers[column[there]])
        return (out >> HALF).astype(">u4").tobytes()


def sketches(df: DataFrame, text: str, name: str, count: int = SKETCHES, piece: int = PIECE, keep: bool = True) -> DataFrame:
    """``df`` with the sketch of ``text`` as binary column ``name``, and without the text unless ``keep``."""
    df = df.select(text, *[c for c in df.columns if c != text])
    sketcher: list[Sketcher] = []

    def run(given, *row):
        if not sketcher:
            sketcher.append(Sketcher(count, piece))
        return (*((given,) if keep else ()), *row, sketcher[0].sketch(given))

    out = df if keep else df.drop(text)
    return map_rows(df, run, out.select("*", F.lit(b"").alias(name)).schema)


def printed(sketch: Column | str) -> Column:
    """Eight hex digits per hash function."""
    return F.lower(F.hex(sketch))


def likeness(a: Column | str, b: Column | str, count: int = SKETCHES) -> Column:
    """Share of hash functions that agree."""
    def part(c: Column | str, j: int) -> Column:
        return F.substring(c, 4 * j + 1, 4)

    return sum((part(a, j) == part(b, j)).cast("int") for j in range(count)) / F.lit(count)


def beside_next(
    df: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(key, text, derived columns, next) per row.

    ``next`` is a struct of the text and derived columns of the following row in
    descending key order, after the last the first.  ``derive`` adds columns, once
    per row, before the rows move.

    The order is cut into ranges of keys; each row goes to its range once, and
    the first row of every range also to the range before it, so no window
    spans more than a range.  Null keys come last; ties are ordered by digest.
    ``df`` is read three times: keys and lengths, first rows, all.
    """
    bounds = range_bounds(
        df, key, rows_per_bucket, weight=F.coalesce(F.char_length(text), F.lit(0)), weight_per_bucket=CHARS_PER_BUCKET
    )
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(range_bucket(key, bounds))
    marked = df.select(F.col(key), F.col(text), bucket.alias("_bucket"), F.xxhash64(text).alias("_tie"))
    firsts = marked.groupBy("_bucket").agg(F.max(F.struct(key, "_tie")).alias("_first"))
    # at most one row per range; the table of ranges is small by construction
    around = Window.partitionBy(F.lit(0)).orderBy(F.col("_bucket").desc())
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = F.coalesce(F.lag("_bucket").over(around), F.last("_bucket").over(whole))
    wanted = firsts.select(
        F.col(f"_first.{key}").alias("_k"), F.col("_first._tie").alias("_t"), target.alias("_to")
    )
    heads = (
        marked.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_tie") == F.col("_t")))
        .dropDuplicates(["_to"])
        .select(key, text, F.col("_to").alias("_bucket"), "_tie", F.lit(True).alias("_extra"))
    )
    both = marked.withColumn("_extra", F.lit(False)).unionByName(heads)
    own = set(both.columns)
    both = derive(both) if derive else both
    columns = [text, *[c for c in both.columns if c not in own]]
    order = Window.partitionBy("_bucket").orderBy("_extra", F.col(key).desc_nulls_last(), F.col("_tie").desc())
    # column by column: a struct would be put together before the shuffle and carry the text twice
    beside = both.withColumns({f"_next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col("_extra"))
    return beside.select(key, *columns, F.struct(*[F.col(f"_next_{c}").alias(c) for c in columns]).alias("next"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = beside_next(docs, "doc_id", "text", lambda both: sketches(both, "text", "sketch")).select(
        "doc_id", n.cast("bigint").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited")
    )
    both = sketches(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch", keep=False)
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed("sketch").alias("fingerprint"),
        printed("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
