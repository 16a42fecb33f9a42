"""MinHash signatures and banding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ngrams import NON_WORD

PRIME = (1 << 61) - 1
HASH_MASK = (1 << 32) - 1
PERMUTATION_SEED = 77

NUM_PERM = 256
THRESHOLD = 0.7
NGRAM = 5
KEY_BYTES = 4
SPLIT = re.compile(NON_WORD)
# Hashes per step: 128 x 256 words stay inside the second-level cache.
CHUNK = 128


@lru_cache
def permutations(num_perm: int, seed: int = PERMUTATION_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends from one seeded generator."""
    rng = np.random.default_rng(seed)
    mult, add = rng.integers(0, PRIME, (2, num_perm), dtype=np.uint64)
    return mult | np.uint64(1), add


def signature_of(hashes: np.ndarray, num_perm: int, seed: int = PERMUTATION_SEED) -> np.ndarray:
    """Per permutation the smallest permuted hash; all ones for an empty set.

    The 64-bit product wraps: with odd multipliers that is a bijection of 64-bit
    numbers, and one multiplication in place of a 128-bit remainder.  Documents
    go through in small chunks, so memory stays at one chunk.
    """
    mult, add = permutations(num_perm, seed)
    prime, mask = np.uint64(PRIME), np.uint64(HASH_MASK)
    lowest = np.full(num_perm, HASH_MASK, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        x = np.multiply.outer(hashes[at : at + CHUNK].astype(np.uint64), mult)
        x += add
        # Remainder modulo 2^61 - 1: fold the top bits, then take the prime off
        # once; below the prime that wraps to a huge value and loses.
        high = x >> np.uint64(61)
        x &= prime
        x += high
        np.subtract(x, prime, out=high)
        np.minimum(x, high, out=x)
        x &= mask
        np.minimum(lowest, x.min(axis=0), out=lowest)
    return lowest


def hashes_of(text: str, ngram: int, min_tokens: int) -> np.ndarray:
    """SHA-1 heads of the distinct word n-grams of one text."""
    tokens = SPLIT.split(text)
    if len(tokens) < max(ngram, min_tokens):
        return np.zeros(0, dtype="<u4")
    grams = {" ".join(tokens[i : i + ngram]) for i in range(len(tokens) - ngram + 1)}
    return np.frombuffer(b"".join(sha1(g.encode()).digest()[:4] for g in grams), dtype="<u4")


def signature(
    text: Column,
    num_perm: int = NUM_PERM,
    ngram: int = NGRAM,
    min_tokens: int = NGRAM,
    seed: int = PERMUTATION_SEED,
) -> Column:
    """Signature of a text as ``num_perm`` big-endian 4-byte words in one binary.

    The n-grams are hashed in the same Arrow batch function: as SQL lambdas
    over arrays they cost several times more, and would cross to Python too.
    """

    @F.arrow_udf(T.BinaryType())
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [
                signature_of(hashes_of(t or "", ngram, min_tokens), num_perm, seed).astype(">u4").tobytes()
                for t in batch.to_pylist()
            ]
            yield pa.array(found, type=pa.binary())

    return kernel(text)


def signature_words(sig: Column, num_perm: int) -> Column:
    """The signature as an array of integers."""

    def word(i: Column) -> Column:
        return F.conv(F.hex(F.substring(sig, i * KEY_BYTES + 1, F.lit(KEY_BYTES))), 16, 10).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(num_perm - 1)), word)


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """Key of each band: its slice of the signature, or its digest where that is shorter.

    Slices, not 64-bit hashes: at ten billion documents 64 bits would link
    strangers.
    """
    width = rows * KEY_BYTES

    def key(i: Column) -> Column:
        piece = F.substring(sig, i * width + 1, F.lit(width))
        return piece if width <= 16 else F.unhex(F.md5(piece))

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)


def _area(values: np.ndarray, step: float) -> float:
    """Simpson's rule over an odd number of evenly spaced values."""
    return float(step / 3 * (values[0] + values[-1] + 4 * values[1:-1:2].sum() + 2 * values[2:-1:2].sum()))


@lru_cache
def band_plan(
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    false_positive_weight: float = 0.5,
    false_negative_weight: float = 0.5,
    points: int = 1001,
) -> tuple[int, int]:
    """Bands and rows with the least weighted area of wrong decisions around ``threshold``.

    False positives are collisions below the threshold, false negatives the
    misses above it.
    """
    below = np.linspace(0.0, threshold, points)
    above = np.linspace(threshold, 1.0, points)
    best, plan = np.inf, (0, 0)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            missed_below = (1.0 - below**rows) ** bands
            missed_above = (1.0 - above**rows) ** bands
            wrong_hits = _area(1.0 - missed_below, threshold / (points - 1))
            wrong_misses = _area(missed_above, (1.0 - threshold) / (points - 1))
            error = false_positive_weight * wrong_hits + false_negative_weight * wrong_misses
            if error < best:
                best, plan = error, (bands, rows)
    return plan
