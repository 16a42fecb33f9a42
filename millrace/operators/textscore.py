"""Sentence BLEU and ROUGE over pairs of reference and predicted text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import row_cuts
from millrace.functions.stem import nested_stemmed_lists, nested_stems, stemmed_lists
from millrace.functions.text import col, let, strip, words

MAX_ORDER = 4
# Fixed value: smallest normal double, added inside the logarithms.
TINY = 2.2250738585072014e-308

# Tokenization of the NIST scorer, applied in this order.
LINE_RULES = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
ENTITIES = [("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")]
PUNCTUATION_RULES = [
    (r"([{-~\[-` -&(-+:-@/])", r" $1 "),
    (r"([^0-9])([.,])", r"$1 $2 "),
    (r"([.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
WORD_OR_MARK = r"([\w]+|[^\s\w])"


def split_punctuation(text: Column | str) -> Column:
    """Words and single punctuation marks, joined by blanks."""
    return F.array_join(F.regexp_extract_all(col(text), F.lit(f"(?U){WORD_OR_MARK}"), 1), " ")


def first_field(text: Column | str) -> Column:
    """Stripped text before the first tab; text after it is ignored."""
    return strip(F.substring_index(strip(text), "\t", 1))


def scored_text(text: Column | str) -> Column:
    return split_punctuation(F.lower(first_field(text)))


def normalized_words(text: Column | str) -> Column:
    """Lower-cased words with punctuation set apart."""
    out = col(text)
    for pattern, repl in LINE_RULES + ENTITIES:
        out = F.replace(out, F.lit(pattern), F.lit(repl))
    out = F.lower(F.concat(F.lit(" "), out, F.lit(" ")))
    for pattern, repl in PUNCTUATION_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return words(out)


def _grams(tokens: Column, n: int) -> Column:
    def gram(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])

    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n, F.transform(starts, gram)).otherwise(F.array().cast("array<string>"))


def _numbered(grams: Column) -> Column:
    """Grams in order, each but the first of equal ones with its number, so that sets of them compare as multisets.

    The separator is white space, which no word holds.
    """

    def run(sorted_: Column, starts: Column, first: Column, j: Column) -> Column:
        after = F.coalesce(F.get(starts, j + 1), F.size(sorted_))
        more = F.transform(F.sequence(first + 1, after - 1), lambda i: F.concat_ws("\x1f", F.get(sorted_, first), (i - first).cast("string")))
        return F.when(after == first + 1, F.array(F.get(sorted_, first))).otherwise(F.concat(F.array(F.get(sorted_, first)), more))

    def numbered(sorted_: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(sorted_) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
        return let(starts, lambda found: F.flatten(F.transform(found, lambda first, j: run(sorted_, found, first, j))))

    return F.when(F.size(grams) > 0, let(F.sort_array(grams), numbered)).otherwise(grams)


def _shared(predicted: str, expected: str, n: int) -> Column:
    """The n-grams of one array of words that the other has too, as often as both have them."""
    return F.array_intersect(_numbered(_grams(F.col(predicted), n)), _numbered(_grams(F.col(expected), n)))


def reference_length(lengths: Column, test_length: Column, rule: str = "shortest") -> Column:
    """Effective reference length from all reference lengths of a key."""
    if rule == "shortest":
        return F.array_min(lengths).cast("double")
    if rule == "average":
        total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return total / F.size(lengths)
    if rule == "closest":
        gaps = F.transform(lengths, lambda x, i: F.struct(F.abs(x - test_length), i, x.alias("len")))
        return F.array_min(gaps)["len"].cast("double")
    raise ValueError(f"unknown reference length rule {rule!r}")


def smoothed_bleu(matches: list[Column], test_length: Column, ref_length: Column) -> Column:
    """BLEU with add-one smoothing above unigrams and the shifted brevity penalty."""
    orders = len(matches)
    log_sum = F.lit(0.0)
    for n, hit in enumerate(matches, start=1):
        add = 0.0 if n == 1 else 1.0
        guesses = F.greatest(test_length - (n - 1), F.lit(0))
        log_sum = log_sum + F.log(hit + F.lit(add) + F.lit(TINY)) - F.log(guesses + F.lit(add) + F.lit(TINY))
    brevity = F.least(F.lit(0.0), F.lit(1.0) - (ref_length + 1.0) / (test_length + 1.0))
    return F.exp(log_sum / float(orders) + brevity)


def sentence_bleu(
    predictions: DataFrame,
    references: DataFrame,
    key: str,
    text: str = "text",
    rule: str = "shortest",
    ref_no: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """(key, bleu) for every key in both tables.

    Of several predictions of a key the last one in ``order`` counts (without it,
    the last in text order).  Several references of a key are all references, in
    the order of ``ref_no`` or of their texts.  Each reference meets the chosen
    prediction in a row, and only the grams they share leave it.
    """
    chosen = F.max_by(text, order) if order else F.max(text)
    hyp = predictions.groupBy(key).agg(chosen.alias("_t"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*([ref_no] if ref_no else []), text)) - 1
    ref = references.select(key, number.cast("bigint").alias("_no"), F.col(text).alias("_r"))
    toks = hyp.join(ref, key).select(key, "_no", normalized_words(scored_text("_t")).alias("_p"), normalized_words(scored_text("_r")).alias("_e"))
    length = F.size("_e").cast("bigint")

    def shared(n: int) -> Column:
        nothing = F.lit(None).cast("bigint")
        return F.transform(_shared("_p", "_e", n), lambda g: F.struct(F.lit(n).alias("n"), nothing.alias("no"), nothing.alias("len"), g.alias("gram")))

    # a record of order 0 carries the length of each reference
    own = F.array(F.struct(F.lit(0).alias("n"), F.col("_no").alias("no"), length.alias("len"), F.lit("").alias("gram")))
    records = F.concat(own, *[shared(n) for n in range(1, MAX_ORDER + 1)])
    rows = toks.select(key, F.size("_p").cast("bigint").alias("_len"), F.explode(records).alias("_s")).select(key, "_len", "_s.*")
    hits = [F.count_if(F.col("n") == n).alias(f"_m{n}") for n in range(1, MAX_ORDER + 1)]
    sums = rows.distinct().groupBy(key, "_len").agg(*hits, _reference_length(rule).alias("_ref"))
    return sums.select(key, _bleu(F.col("_ref")))


def _reference_length(rule: str) -> Column:
    """As :func:`reference_length`, as an aggregate over the records of order 0."""
    own, length = F.col("n") == 0, F.col("len")
    if rule == "shortest":
        return F.min(length).cast("double")
    if rule == "average":
        return F.when(F.count_if(own) == F.count(length), F.sum(length) / F.count_if(own))
    if rule == "closest":
        gap = F.struct(F.abs(length - F.col("_len")).alias("gap"), F.col("no"), length.alias("len"))
        return F.min(F.when(own, gap))["len"].cast("double")
    raise ValueError(f"unknown reference length rule {rule!r}")


def _bleu(ref_length: Column) -> Column:
    hits = [F.coalesce(f"_m{n}", F.lit(0)) for n in range(1, MAX_ORDER + 1)]
    return smoothed_bleu(hits, F.col("_len"), ref_length).alias("bleu")


def pair_bleu(df: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """(key, bleu) for pairs that sit in one row each, ``key`` being unique.

    The n-grams of a pair are counted and clipped inside its row.  Only those of
    a repeated key leave their rows, to be counted together with the pairs of
    that key which have the same lengths.
    """

    def grams(side: int, words_of: str) -> list[Column]:
        return [F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), _grams(F.col(words_of), n).alias("grams")) for n in range(1, MAX_ORDER + 1)]

    alone = F.count("*").over(Window.partitionBy(key)) == 1
    toks = df.select(key, F.col(predicted).alias("_p"), F.col(expected).alias("_e"), alone.alias("_alone"))
    toks = toks.select(key, "_alone", normalized_words(scored_text("_p")).alias("_p"), normalized_words(scored_text("_e")).alias("_e"))
    own = [f"_h{n}" for n in range(1, MAX_ORDER + 1)]
    # an empty gram of order 0 carries the lengths
    sizes = F.struct(F.lit(2).alias("side"), F.lit(0).alias("n"), F.array(F.lit("")).alias("grams"))
    sides = toks.select(
        key,
        F.size("_p").cast("bigint").alias("_len"),
        F.size("_e").cast("bigint").alias("_ref"),
        *[F.when(F.col("_alone"), F.size(_shared("_p", "_e", n))).alias(own[n - 1]) for n in range(1, MAX_ORDER + 1)],
        F.explode(F.when(F.col("_alone"), F.array(sizes)).otherwise(F.array(sizes, *grams(0, "_p"), *grams(1, "_e")))).alias("_s"),
    )
    pair = [key, "_len", "_ref", *own]
    rows = sides.select(*pair, F.col("_s.side").alias("side"), F.col("_s.n").alias("n"), F.explode("_s.grams").alias("gram"))
    counted = rows.groupBy(*pair, "n", "gram").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("e"))
    hits = [F.sum(F.when(F.col("n") == n, F.least("p", "e")).otherwise(0)) for n in range(1, MAX_ORDER + 1)]
    sums = counted.groupBy(*pair).agg(*[F.coalesce(h, s).alias(f"_m{n}") for n, (h, s) in enumerate(zip(own, hits), 1)])
    return sums.select(key, _bleu(F.col("_ref").cast("double")))


def corpus_bleu(sentence_scores: DataFrame) -> DataFrame:
    """Mean sentence BLEU times 100, and how many sentences it covers."""
    return sentence_scores.agg((F.avg("bleu") * 100.0).alias("bleu"), F.count("*").alias("sentences"))


def rouge_words(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)"), 1)


def f_measure(hits: Column, predicted: Column, expected: Column) -> Column:
    """Harmonic mean of hits over predicted and hits over expected; 0 without hits."""
    return F.when(hits > 0, hits * 2.0 / (predicted + expected)).otherwise(0.0)


def rouge_n(df: DataFrame, key: str, predicted: str, expected: str, n: int, stemmed: bool = False) -> DataFrame:
    """(key, f) for n-gram overlap; one shuffle of the pairs to their key."""
    toks = df.repartition(key).select(key, rouge_words(predicted).alias("_p"), rouge_words(expected).alias("_e"))
    if stemmed:  # both sides in one function, so that a task needs one Python process
        none = F.array().cast("array<string>")
        toks = toks.select(key, nested_stems(F.array(F.coalesce("_p", none), F.coalesce("_e", none))).alias("_w"))
        toks = toks.select(key, F.get("_w", F.lit(0)).alias("_p"), F.get("_w", F.lit(1)).alias("_e"))
    sides = F.array(
        F.struct(F.lit(0).alias("ref"), _grams(F.col("_p"), n).alias("g")), F.struct(F.lit(1).alias("ref"), _grams(F.col("_e"), n).alias("g"))
    )
    per_side = toks.select(key, F.explode(sides).alias("_s"))
    rows = per_side.select(key, F.col("_s.ref").alias("ref"), F.explode_outer("_s.g").alias("gram"))
    counted = rows.groupBy(key, "gram").agg(
        F.count_if((F.col("ref") == 0) & F.col("gram").isNotNull()).alias("p"),
        F.count_if((F.col("ref") == 1) & F.col("gram").isNotNull()).alias("e"),
    )
    sums = counted.groupBy(key).agg(
        F.sum(F.least("p", "e")).alias("hits"), F.sum("p").alias("p"), F.sum("e").alias("e")
    )
    return sums.select(key, f_measure(F.col("hits"), F.col("p"), F.col("e")).alias(f"rouge{n}"))


def _lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit rows: one big-integer step per word of ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def _lcs(left: str, right: str, stemmed: bool) -> Column:
    """Length of the longest common subsequence of two arrays of words, or of their stems."""

    @F.arrow_udf(T.LongType())
    def lengths(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in pairs:
            for start, rows in row_cuts(whole):
                sides = [side.slice(start, rows) for side in whole]
                sides = [(stemmed_lists(side) if stemmed else side).to_pylist() for side in sides]
                yield pa.array([_lcs_length(a or [], b or []) for a, b in zip(*sides)], pa.int64())

    return lengths(left, right)


def _subsequence_places(expected: list[str], predicted: list[str]) -> set[int]:
    """Places in ``expected`` of one longest common subsequence, found from the ends backwards.

    Bit rows are kept only every so often; the rows between two kept ones are
    computed again when the way back comes there, so memory grows with the
    square root of the predicted words.
    """
    places: dict[str, int] = {}
    for i, w in enumerate(expected):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(expected)) - 1

    def after(row: int, w: str) -> int:
        hit = row & places.get(w, 0)
        return ((row + hit) | (row - hit)) & full

    stride = math.isqrt(len(predicted)) + 1
    kept, row = [full], full
    for j, w in enumerate(predicted, 1):
        row = after(row, w)
        if j % stride == 0:
            kept.append(row)
    used: set[int] = set()
    i, j = len(expected), len(predicted)
    while i and j:
        start = (j - 1) // stride * stride
        rows = [kept[start // stride]]
        for w in predicted[start:j]:
            rows.append(after(rows[-1], w))

        def common(i: int, j: int) -> int:
            return i - (rows[j - start] & ((1 << i) - 1)).bit_count()

        while i and j > start:
            if expected[i - 1] == predicted[j - 1]:
                used.add(i - 1)
                i, j = i - 1, j - 1
            elif common(i, j - 1) > common(i - 1, j):
                j -= 1
            else:
                i -= 1
    return used


def _union_hits(expected: list[list[str]], predicted: list[list[str]]) -> int:
    """Words of each expected sentence that lie on a common subsequence with any predicted one."""
    left_e = Counter(w for sentence in expected for w in sentence)
    left_p = Counter(w for sentence in predicted for w in sentence)
    hits = 0
    for e in expected:
        used: set[int] = set()
        for p in predicted:
            used |= _subsequence_places(e, p)
        for i in sorted(used):
            w = e[i]
            if left_e[w] > 0 and left_p[w] > 0:
                left_e[w] -= 1
                left_p[w] -= 1
                hits += 1
    return hits


def _summary_hits(expected: str, predicted: str, stemmed: bool) -> Column:
    """:func:`_union_hits` of two arrays of sentences, each an array of words, or of their stems."""

    @F.arrow_udf(T.LongType())
    def hits(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in pairs:
            for start, rows in row_cuts(whole):
                sides = [side.slice(start, rows) for side in whole]
                sides = [(nested_stemmed_lists(side) if stemmed else side).to_pylist() for side in sides]
                yield pa.array([_union_hits(e or [], p or []) for e, p in zip(*sides)], pa.int64())

    return hits(expected, predicted)


def rouge_l(df: DataFrame, key: str, predicted: str, expected: str, stemmed: bool = False) -> DataFrame:
    """(key, rougeL): F-measure over the longest common word subsequence."""
    words_of = rouge_words if not stemmed else lambda c: F.coalesce(rouge_words(c), F.array().cast("array<string>"))
    toks = df.select(key, words_of(predicted).alias("_p"), words_of(expected).alias("_e"))
    sized = toks.select(key, _lcs("_p", "_e", stemmed).alias("_h"), F.size("_p").alias("_np"), F.size("_e").alias("_ne"))
    return sized.select(key, f_measure(F.col("_h"), F.col("_np"), F.col("_ne")).alias("rougeL"))


def rouge_lsum(df: DataFrame, key: str, predicted: str, expected: str, stemmed: bool = False) -> DataFrame:
    """(key, rougeLsum): as rougeL with lines as sentences and the union of their subsequences."""

    def sentences(c: str) -> Column:
        found = F.transform(F.split(F.col(c), "\n"), lambda line: rouge_words(line))
        return F.coalesce(found, F.array().cast("array<array<string>>")) if stemmed else found

    def size(c: str) -> Column:
        return F.aggregate(c, F.lit(0), lambda a, s: a + F.size(s))

    toks = df.select(key, sentences(predicted).alias("_p"), sentences(expected).alias("_e"))
    sized = toks.select(key, _summary_hits("_e", "_p", stemmed).alias("_h"), size("_p").alias("_np"), size("_e").alias("_ne"))
    return sized.select(key, f_measure(F.col("_h"), F.col("_np"), F.col("_ne")).alias("rougeLsum"))


def rouge(df: DataFrame, key: str, predicted: str, expected: str, stemmed: bool = True) -> DataFrame:
    """Mean ROUGE-1, -2, -L and -Lsum times 100, on stems unless told otherwise."""
    scores = rouge_n(df, key, predicted, expected, 1, stemmed).join(rouge_n(df, key, predicted, expected, 2, stemmed), key)
    scores = scores.join(rouge_l(df, key, predicted, expected, stemmed), key)
    scores = scores.join(rouge_lsum(df, key, predicted, expected, stemmed), key)
    return scores.agg(*[(F.avg(c) * 100.0).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")])
