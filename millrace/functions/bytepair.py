"""Byte-pair encoding by a merge table, in columns and Arrow batches.

The pieces of a text (words with the blank before them, numbers, punctuation,
white space) are cut by Spark's regular expressions.  A batch's pieces are made
distinct first; each distinct piece is merged once per task, and the ids of all
pieces are gathered from those of the distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.encoders import IDS, Encoder

# Fixed value: how byte-level vocabularies cut a text into pieces, in Java syntax.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Entries of a vocabulary that the driver takes: a model's, which does not grow with the corpus.
MAX_VOCABULARY = 1 << 21
#: Distinct pieces that a task remembers.
REMEMBERED = 200_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [b for low, high in ((33, 126), (161, 172), (174, 255)) for b in range(low, high + 1)]
    symbols = {b: chr(b) for b in own}
    others = [b for b in range(256) if b not in symbols]
    symbols |= {b: chr(256 + n) for n, b in enumerate(others)}
    return [symbols[b] for b in range(256)]


def _model(spark: SparkSession, path: str, merges: str) -> DataFrame:
    schema = f"model struct<vocab: map<string, int>, merges: {merges}>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.model.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a tokenizer stored as one JSON file."""
    return _model(spark, path, "array<string>").select(F.explode("vocab").alias("token", "id"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, left, right) of a tokenizer stored as one JSON file, its merges being pairs or blank-separated text."""
    pairs = _model(spark, path, "array<array<string>>").select(F.posexplode("merges").alias("rank", "pair"))
    if pairs.filter(F.size("pair") == 2).isEmpty():
        pairs = _model(spark, path, "array<string>").select(F.posexplode("merges").alias("rank", "text"))
        pairs = pairs.select("rank", F.split("text", " ").alias("pair"))
    return pairs.select("rank", F.get("pair", F.lit(0)).alias("left"), F.get("pair", F.lit(1)).alias("right"))


@dataclass(frozen=True)
class BytePairs:
    """Ids of the 256 bytes, and for each pair of ids the rank of its merge and the id it becomes."""

    bytes_: list[int]
    merges: dict[tuple[int, int], tuple[int, int]] = field(repr=False)

    def ids(self, piece: str) -> list[int]:
        """Ids of one piece: always the merge of lowest rank, of equal ones the leftmost."""
        ids = [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")]
        return self._short(ids) if len(ids) <= 32 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        merges, last = self.merges, (1 << 62, 0)
        while len(ids) > 1:
            rank, at = min((merges.get(pair, last)[0], k) for k, pair in enumerate(zip(ids, ids[1:])))
            if rank == last[0]:
                break
            ids[at : at + 2] = [merges[ids[at], ids[at + 1]][1]]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked places, n log n in the length of the piece."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[pair][0], k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapify(heap)
        while heap:
            _, at, left, right = heappop(heap)
            end = after[at]
            if ids[at] != left or end >= n or ids[end] != right:
                continue  # one of them has been merged since
            ids[at], ids[end] = merges[left, right][1], -1
            after[at] = after[end]
            if after[at] < n:
                before[after[at]] = at
            for first, second in ((before[at], at), (at, after[at])):
                if first >= 0 and second < n and (pair := (ids[first], ids[second])) in merges:
                    heappush(heap, (merges[pair][0], first, *pair))
        return [i for i in ids if i >= 0]


def byte_pairs(vocabulary: DataFrame, merges: DataFrame) -> BytePairs:
    """The tables (token, id) and (rank, left, right) as lookups; both are bounded by the vocabulary."""
    tokens = {r[0]: r[1] for r in vocabulary.select("token", "id").limit(MAX_VOCABULARY + 1).collect()}
    ranked = merges.select("rank", "left", "right").limit(MAX_VOCABULARY + 1).collect()
    if max(len(tokens), len(ranked)) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens or merges")
    missing = [s for s in byte_symbols() if s not in tokens]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
    return BytePairs([tokens[s] for s in byte_symbols()], {(tokens[a], tokens[b]): (rank, tokens[a + b]) for rank, a, b in ranked})


def pieces(text: Column | str) -> Column:
    """What is merged by itself, in the order of the text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


def _gathered(lists: pa.ListArray, ids_of) -> pa.ListArray:
    """Ids of every list of pieces, each distinct piece being encoded once."""
    offsets = np.asarray(lists.offsets)
    found = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    encoded = [np.array(ids_of(p), np.int32) for p in found.dictionary.to_pylist()]
    sizes = np.array([len(e) for e in encoded], np.int64)
    flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
    index = np.asarray(found.indices).astype(np.int64)
    counts = sizes[index] if len(sizes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = (np.cumsum(sizes) - sizes)[index] if len(sizes) else counts
    places = np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]].astype(np.int32)), pa.array(flat[places]))


def byte_pair(pairs: BytePairs, eos: int | None, pad: int | None = None) -> Encoder:
    """An encoder of byte pairs; text that spells a special token is text."""

    @F.arrow_udf(IDS)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}

        def ids_of(piece: str) -> list[int]:
            found = known.get(piece)
            if found is None:
                found = pairs.ids(piece)
                if len(known) < REMEMBERED:
                    known[piece] = found
            return found

        for lists in batches:
            yield _gathered(lists, ids_of)

    return Encoder(lambda text: encode(pieces(text)), eos, pad)


def byte_pair_file(spark: SparkSession, path: str, eos: int | None, pad: int | None = None) -> Encoder:
    """The encoder of a byte-level tokenizer stored as one JSON file that Spark can read."""
    return byte_pair(byte_pairs(read_vocabulary(spark, path), read_merges(spark, path)), eos, pad)
