"""Packing token sequences: repeat counts of length combinations by non-negative least squares.

**Tokens.**  A document is its ids by a public tokenizer and an end id.  No token
of a byte-level vocabulary reaches from a character that is not white space over
one that is, so a text is cut there, and each distinct cut (white space and what
follows) is encoded once per task and remembered; the ids are those of the whole
text.

**Combinations.**  A document first gives whole windows.  What is left of it, 1
to WINDOW - 1 ids, counts in a histogram of lengths.  Shallow combinations, all
pairs and the likeliest triples of lengths that fill a window, are the columns
of a matrix; repeat counts x >= 0 that bring A x closest to the histogram come
from accelerated projected gradients, are rounded down, and never take more of a
length than there is.  The remainders of such a length take the slots of its
combinations in the order of their rank, whole.

**Residuals.**  Remainders beyond the slots are laid end to end and cut at every
window.  The one window that is not filled is cut into sequences whose lengths
are powers of two, which need no padding; so nothing is padded.

**At scale.**  The driver sees the histogram (fewer than WINDOW rows) and the
combinations (at most :data:`COMBINATIONS`).  Ranks inside a length come from
bucketed running totals over narrow rows, so a length that a third of all
documents have is spread like any other; where a residual starts follows from
its length and rank.  Ids are written once with digests of their windows; they move
only to build the sequences themselves.

A null text is an empty one and has the end id alone.  Every row is packed, also
those of repeated or null keys; an empty table gives no rows.  Columns other than
key and text are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.operators.prefix import with_running_totals
from millrace.session import broadcast_if_small, materialize

WINDOW = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"
#: Columns of the least-squares problem beyond the pairs; a bound of the driver's work, not of what is packed.
COMBINATIONS = 20_000
STEPS = 2_000
#: Characters of a text that are cut up at a time.
PART = 1 << 20
#: Characters of distinct cuts after which a worker's memory becomes the old one, from which only what is asked for comes back.
REMEMBERED = 1 << 21
BATCH_BYTES = 1 << 25
ROWS_PER_BUCKET = 8192
MAX_BUCKET_BITS = 16
# Fixed value: Unicode white space, as byte-level tokenizers cut at it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the library's letter for each byte: printable ones for themselves, the others from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
LIBRARY_LETTERS = {b: 256 + n for n, b in enumerate(_OTHERS)}
LIBRARY_BLANK = chr(LIBRARY_LETTERS[32])
#: A word of Latin letters, and ASCII marks behind it.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
CUT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space beyond single blanks and line ends, in Python's wider sense.
UNUSUAL = re.compile(r"[^\S \n]")
NEIGHBOURS = ("  ", " \n", "\n ", "\n\n")
_BORDER = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut only before white space."""
    at = 0
    while len(text) - at > size:
        border = _BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at : border.end()]
        at = border.end()
    yield text[at:]


class Cuts(dict):
    """Ids, as bytes, of ``prefix`` and the text asked for; unknown ones are encoded then.

    Cuts that were not asked for since the memory was full are forgotten.
    """

    def __init__(self, prefix: str, tokenizer) -> None:
        super().__init__()
        self.prefix = prefix
        # the library's two steps one by one: special tokens, which come before them, are text here
        self.words_of = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merged = tokenizer.model.tokenize
        self.before = b"" if prefix in ("", " ") else self.general(prefix)
        self.old: dict[str, bytes] = {}
        self.held = 0

    def word(self, letters: str) -> bytes:
        """Ids of a word in the library's own letters, one for each byte."""
        return array("I", [t.id for t in self.merged(letters)]).tobytes()

    def general(self, cut: str) -> bytes:
        return b"".join([self.word(w) for w, _ in self.words_of(cut)])

    def encoded(self, text: str) -> bytes:
        plain = PLAIN.fullmatch(text)
        if plain is None:
            return self.general(self.prefix + text)
        if plain[2]:  # the library cuts between a word and marks
            return self[plain[1]] + self.word(plain[2])
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(LIBRARY_LETTERS)
        return self.before + self.word(LIBRARY_BLANK + letters if self.prefix == " " else letters)

    def __missing__(self, text: str) -> bytes:
        if self.held > REMEMBERED:
            self.old = dict(self)
            self.clear()
            self.held = 0
        found = self.old.pop(text, None)
        ids = self.encoded(text) if found is None else found
        self.held += len(text)
        self[text] = ids
        return ids


class Encoder:
    """Ids of texts as bytes, little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise ValueError("this machine has other numbers")
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or tokenizer.post_processor is not None:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.after_blank, self.after_line, self.whole = (Cuts(prefix, tokenizer) for prefix in (" ", "\n", ""))

    def part_ids(self, part: str) -> bytes:
        if UNUSUAL.search(part) or any(pair in part for pair in NEIGHBOURS):
            return b"".join(map(self.whole.__getitem__, CUT.findall(part)))
        out = []
        start, blank = self.whole, self.after_blank.__getitem__
        for line in part.split("\n"):
            first, *words = line.split(" ")
            out.append(start[first])
            out.extend(map(blank, words))
            start = self.after_line
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        return b"".join([self.part_ids(part) for part in parts(text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process; what it remembers serves all its tasks."""
    return Encoder(path)


def digests(ids: bytes, window: int) -> list[int]:
    """CRC-32 of every whole window and of the rest."""
    step = 4 * window
    return [zlib.crc32(ids[at : at + step]) for at in range(0, len(ids), step)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoded(df: DataFrame, key: str, text: str, path: str | None = None, end: int = END, window: int = WINDOW) -> DataFrame:
    """(row, key, n, ids, digests) per row: ids as little-endian unsigned 32-bit numbers, the last one being ``end``, and digests of windows.

    ``path`` is the tokenizer's file on the workers; without it the public one's.
    """
    kind = df.schema[key].dataType.simpleString()
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path or vocabulary_path()).ids

        def finished(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
            kinds = (pa.int64(), key_type, pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = zip(*rows) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["row", "key", "n", "ids", "digests"])

        for batch in batches:
            rows, held = [], 0
            for number, name, whole in zip(*(batch.column(c) for c in range(3))):
                ids = ids_of(whole.as_py()) + last
                rows.append((number.as_py(), name.as_py(), len(ids) // 4, ids, digests(ids, window)))
                held += len(ids)
                if held > BATCH_BYTES:  # long texts leave in small batches
                    yield finished(rows, batch.column(1).type)
                    rows, held = [], 0
            yield finished(rows, batch.column(1).type)

    return numbered.mapInArrow(run, f"row bigint, key {kind}, n bigint, ids binary, digests array<bigint>")


def combinations(counts: np.ndarray, window: int = WINDOW, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths, ascending, that fill a window; of triples those whose rarest length is most frequent."""
    lengths = np.flatnonzero(counts)
    pairs = [(int(a), window - int(a)) for a in lengths if 2 * a <= window and counts[window - a]]
    triples: list[tuple[int, int, int, int]] = []
    for a in lengths[lengths * 3 <= window]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        c = window - a - b
        b, c = b[counts[c] > 0], c[counts[c] > 0]
        rarest = np.minimum(np.minimum(counts[b], counts[c]), counts[a])
        for i in np.argsort(-rarest, kind="stable")[: max(1, 8 * most // window)]:
            triples.append((-int(rarest[i]), int(a), int(b[i]), int(c[i])))
    return pairs + [t[1:] for t in sorted(triples)[:most]]


def repeat_counts(counts: np.ndarray, combos: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """x >= 0 with the least squared distance of A x to the histogram, by accelerated projected gradients."""
    if not combos:
        return np.zeros(0)
    rows = np.concatenate([np.array(c) for c in combos])
    columns = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    scale = 1.0 / np.sqrt(np.maximum(counts, 1.0))  # a length's error counts relative to how often it occurs
    target, weight = counts * scale, scale[rows]

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weight * x[columns], len(counts))

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(columns, weight * y[rows], len(combos))

    # the largest row sum of A'A bounds its largest eigenvalue
    bound = back(forward(np.ones(len(combos)))).max()
    x = ahead = np.zeros(len(combos))
    speed = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, ahead - back(forward(ahead) - target) / bound)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        step = new - x
        if (ahead - new) @ step > 0:  # overshot: start the acceleration anew
            faster = 1.0
        ahead = new + (speed - 1) / faster * step
        done = np.abs(step).max() < 1e-4 * max(1.0, new.max())
        x, speed = new, faster
        if done:
            break
    return x


def rounded(x: np.ndarray, combos: list[tuple[int, ...]], counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, combination): rounded down, larger counts first, within what is left of each length; then once more upwards."""
    left = counts.astype(np.int64).copy()
    repeats = np.zeros(len(combos), np.int64)

    def take(c: int, wanted: int) -> None:
        parts_of = combos[c]
        room = min(int(left[v]) // parts_of.count(v) for v in parts_of)
        n = max(0, min(wanted, room))
        repeats[c] += n
        for v in parts_of:
            left[v] -= n

    order = np.lexsort((np.arange(len(combos)), -x))
    for c in order:
        take(int(c), int(x[c] + 1e-9))
    for c in order:
        take(int(c), int(np.ceil(x[c])) - int(x[c] + 1e-9))
    return [(int(repeats[c]), combos[c]) for c in range(len(combos)) if repeats[c]]


@dataclass(frozen=True)
class Layout:
    """Where a remainder goes, by its length and its rank among those of its length."""

    #: (length, first rank, ranks, first sequence, offset)
    slots: list[tuple[int, int, int, int, int]]
    #: by length: ranks that have slots, place of the first residual in the row of all residuals, first full window
    lengths: list[tuple[int, int, int, int]]
    #: length of the row of residuals, its first sequence, and the borders of the sequences of its end
    residual: int
    first: int
    ends: list[int]


def layout(histogram: list[tuple[int, int, int]], window: int = WINDOW) -> Layout:
    """From (length, remainders, full windows) to places; full windows come first, then combinations, then residuals."""
    counts = np.zeros(window, np.int64)
    for length, n, _ in histogram:
        counts[length] = n
    counts[0] = 0
    combos = combinations(counts, window)
    taken = np.zeros(window, np.int64)
    slots = []
    sequence = sum(full for _, _, full in histogram)
    for repeats, combo in rounded(repeat_counts(counts, combos), combos, counts):
        at = 0
        for length in combo:
            slots.append((length, int(taken[length]), repeats, sequence, at))
            taken[length] += repeats
            at += length
        sequence += repeats
    lengths, place, full = [], 0, 0
    for length, n, windows in sorted(histogram):
        lengths.append((length, int(taken[length]), place, full))
        place += length * (n - int(taken[length])) if length else 0
        full += windows
    ends, at = [], place // window * window
    for bit in reversed(range(window.bit_length() - 1)):
        if (place - at) >> bit & 1:
            ends.append(at)
            at += 1 << bit
    return Layout(slots, lengths, place, sequence, ends)


def _pieces(plan: Layout, window: int) -> Column:
    """Array of (start, length, sequence, offset) of a row with its length n, place and slot."""
    whole = F.col("n") - F.col("r")

    def piece(start: Column, length: Column, sequence: Column, offset: Column) -> Column:
        fields = {"start": start, "length": length, "sequence_id": sequence, "offset": offset}
        return F.struct(*[c.cast("bigint").alias(name) for name, c in fields.items()])

    zero = F.lit(0)
    full = F.when(
        F.col("windows") > 0,
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1), lambda i: piece(i * window, F.lit(window), F.col("full") + F.col("before") + i, zero)),
    ).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"))
    in_slot = F.array(piece(whole, F.col("r"), F.col("first") + F.col("rank") - F.col("low"), F.col("at")))
    # a residual of the row of residuals from x on, cut at windows and at the borders of the last sequences
    x = F.col("place") + (F.col("rank") - F.col("taken")) * F.col("r")
    borders = F.array((F.floor(x / window) + 1) * window, *[F.lit(e).cast("bigint") for e in plan.ends])
    inside = F.filter(F.array_distinct(borders), lambda b: (b > x) & (b < x + F.col("r")))
    edges = F.array_sort(F.concat(F.array(x), inside, F.array(x + F.col("r"))))
    tail = plan.residual // window * window
    ends = F.array(*[F.lit(e).cast("bigint") for e in plan.ends]) if plan.ends else F.array().cast("array<bigint>")

    def cut(edge: Column, i: Column) -> Column:
        to = F.get(edges, i + 1)
        behind = F.size(F.filter(ends, lambda e: e <= edge))
        sequence = F.when(edge < tail, F.floor(edge / window)).otherwise(tail // window + behind - 1)
        offset = F.when(edge < tail, edge % window).otherwise(edge - F.element_at(ends, F.greatest(behind, F.lit(1)))) if plan.ends else edge % window
        return piece(whole + edge - x, to - edge, F.lit(plan.first) + sequence, offset)

    residual = F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), cut)
    last = F.when(F.col("r") == 0, F.filter(full, lambda p: F.lit(False))).when(F.col("first").isNotNull(), in_slot).otherwise(residual)
    return F.concat(full, last)


def placed_pieces(ids: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, key, n, digests, pieces) per row of a written table of ids, from its lengths alone."""
    sized = ids.select("row", "key", "n", "digests").withColumns({"r": F.col("n") % window, "windows": F.floor(F.col("n") / window)})
    histogram = sized.groupBy("r").agg(F.count("*").alias("rows"), F.sum("windows").alias("windows"))
    found = [tuple(r) for r in histogram.collect()]  # at most one row per length
    plan = layout(found, window)
    bits = min(MAX_BUCKET_BITS, max(0, sum(f[1] for f in found) // ROWS_PER_BUCKET).bit_length())
    spread = sized.withColumn("order", F.xxhash64("key", "row").bitwiseAND(F.lit((1 << 63) - 1)))
    ranked = with_running_totals(
        spread, {"rank": F.lit(1), "before": "windows"}, ["order", "row"], F.shiftrightunsigned("order", 63 - bits), ["r"]
    )
    # both have at most a few rows per length
    spark = ids.sparkSession
    lengths = spark.createDataFrame(plan.lengths, "r bigint, taken bigint, place bigint, full bigint")
    slots = spark.createDataFrame(plan.slots, "r bigint, low bigint, rows bigint, first bigint, at bigint")
    placed = ranked.join(F.broadcast(lengths), "r")
    own = (placed["r"] == slots["r"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("rows"))
    placed = placed.join(F.broadcast(slots), own, "left").drop(slots["r"])
    return placed.select("row", "key", "n", "digests", _pieces(plan, window).alias("pieces"))


def with_parts(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, key, n, start, length, sequence_id, offset, part) per piece; ``part`` has the bytes of its ids."""
    # cut before the rows multiply, so that no piece carries the whole document
    cut = F.transform("pieces", lambda p: p.withField("part", F.substring(F.col("ids"), (p["start"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))))
    return ids.select("row", "ids").join(placed, "row").select("row", "key", "n", F.inline(cut))


def pack(ids: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with their ids, of a written table of :func:`encoded`; every document moves once."""
    return with_parts(placed_pieces(ids, window), ids)


def piece_digests(ids: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n, start, length, sequence_id, offset, crc32) per piece.

    Whole windows and whole remainders have their digests since they were
    encoded; only documents that are cut elsewhere, at most one a sequence of
    residuals, are read again.
    """
    placed = materialize(placed_pieces(ids, window))
    whole = F.size("pieces") == F.size("digests")
    known = F.transform("pieces", lambda p, i: p.withField("crc32", F.get("digests", i)))
    uncut = placed.filter(whole).select("key", "n", F.inline(known))
    cut = with_parts(broadcast_if_small(placed.filter(~whole)), ids)
    return uncut.unionByName(cut.select("key", "n", "start", "length", "sequence_id", "offset", F.crc32("part").alias("crc32")))


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids, padding): the bytes of every sequence, and the ids it lacks to a window or power of two."""
    # a sequence has at most a window of ids
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    whole = joined.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["part"])).alias("ids"))
    size = F.floor(F.octet_length("ids") / 4)
    return whole.withColumn("padding", F.when(F.bit_count(size) == 1, F.lit(0)).otherwise(window - size).cast("bigint"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies, and a digest of its ids."""
    ids = materialize(encoded(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return piece_digests(ids).select(
        F.col("key").alias("doc_id"), "start", "length", F.col("crc32").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"
    )
