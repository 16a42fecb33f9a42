"""Quality classifier: ordinal cumulative-link regression on hashed text.

``P(grade <= k) = sigmoid(threshold_k - score)`` with one weight vector for all
grades and ascending thresholds, fitted by maximum likelihood in numpy.  The
model gives every text its expected grade and its tail probability of reaching
a grade, by which documents are selected.

Grades come from the labels: 0 is poor text, 1 is good text that is toxic, 2 is
good text.  Features are hashed into :data:`FEATURES` buckets: beginnings of
words, symbols at the ends of tokens, case, and how often a token repeats the
one before, each by its rate in the whole text.  Features seen in
fewer than :data:`MIN_TEXTS` training texts have no weight.

Fitting reads at most about :data:`SAMPLE` labelled texts, chosen by a seeded
hash; only their features reach the driver.  Scoring is one pass over the rows.

A null or blank text has the lowest grade with certainty.  Rows that repeat are
scored alike.  A label row with a null in it is not used; a key that is labelled
several times counts as often.  Without usable labels nothing is rejected but
blank texts: every other one has the top grade.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import free, map_rows, table

FEATURES = 1 << 18
SAMPLE = 16_000
MIN_TEXTS = 5
GRADES = 3
STEPS = 300
RATE = 0.08
RIDGE = 5e-4
#: Rarer grades count more: by the inverse of their share to this power.
BALANCE = 0.5
FOLDS = 5
KEEP_GRADE = 2
KEEP_FROM = 0.5
PREFIX = 4

SYMBOLS = " .,;:!?*#$%&|\"'()[]{}<>=+-/_~^@`\\"


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (FEATURES - 1)


def features(text: str | None) -> dict[int, float]:
    """Slots with values ``log(1 + 100 * rate)``; empty for a text without tokens."""
    tokens = (text or "").split()
    if not tokens:
        return {}
    found: Counter[str] = Counter()
    for token, n in Counter(tokens).items():
        word = token.strip(SYMBOLS).lower()
        if word:
            found["p:" + word[:PREFIX]] += n
        found["s:" + token[len(token.rstrip(SYMBOLS)) :][:4]] += n
        if token.isupper():
            found["upper"] += n
        elif token[:1].isupper():
            found["title"] += n
    if repeats := sum(map(eq, tokens, tokens[1:])):
        found["repeats"] += repeats
    slots: Counter[int] = Counter()
    for feature, n in found.items():
        slots[_slot(feature)] += n
    scale = 100 / len(tokens)
    return {slot: math.log1p(n * scale) for slot, n in slots.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Shared weights and ascending thresholds."""

    def __init__(self, grades: int = GRADES):
        self.weights = np.zeros(FEATURES, np.float64)
        self.thresholds = np.linspace(-2, 0, grades - 1)

    def fit(
        self, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, steps: int = STEPS
    ) -> OrdinalModel:
        """Fit to texts given as (row, slot, value) triples and a grade per row.

        Adam on the mean log likelihood with a ridge; full batches, so nothing is random.
        """
        known = np.flatnonzero(np.bincount(slots, minlength=FEATURES) >= MIN_TEXTS)
        place = np.full(FEATURES, -1)
        place[known] = np.arange(len(known))
        used = place[slots] >= 0
        rows, columns, values = rows[used], place[slots[used]], values[used]
        n, top = len(grades), len(self.thresholds)
        counts = np.bincount(grades, minlength=top + 1)
        heavy = (n / np.maximum(1, counts[grades])) ** BALANCE
        heavy /= heavy.sum()
        weights = np.zeros(len(known))
        # thresholds as a first one and the logs of the gaps
        free = np.concatenate([self.thresholds[:1], np.log(np.diff(self.thresholds))])
        params = np.concatenate([weights, free])
        mean, square = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            weights, free = params[: len(known)], params[len(known) :]
            gaps = np.exp(free[1:])
            thresholds = np.concatenate([free[:1], free[0] + np.cumsum(gaps)])
            score = np.bincount(rows, values * weights[columns], minlength=n)
            above = np.where(grades < top, _sigmoid(thresholds[np.minimum(grades, top - 1)] - score), 1.0)
            below = np.where(grades > 0, _sigmoid(thresholds[np.maximum(grades - 1, 0)] - score), 0.0)
            likely = np.maximum(above - below, 1e-9)
            pull = (1 - above - below) * heavy
            grad_w = np.bincount(columns, values * pull[rows], minlength=len(known)) + RIDGE * weights
            grad_t = np.zeros(top)
            np.add.at(grad_t, np.minimum(grades, top - 1), np.where(grades < top, -above * (1 - above) / likely * heavy, 0))
            np.add.at(grad_t, np.maximum(grades - 1, 0), np.where(grades > 0, below * (1 - below) / likely * heavy, 0))
            grad_free = np.concatenate([[grad_t.sum()], gaps * np.cumsum(grad_t[::-1])[::-1][1:]])
            grad = np.concatenate([grad_w, grad_free])
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
            params = params - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        self.weights[known] = params[: len(known)]
        free = params[len(known) :]
        self.thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        return self

    def tails(self, found: dict[int, float]) -> list[float]:
        """P(grade >= 1), P(grade >= 2), .. of a text; all 0 without features."""
        if not found:
            return [0.0] * len(self.thresholds)
        score = self.weights[list(found)] @ np.fromiter(found.values(), float, len(found))
        return [float(p) for p in 1 - _sigmoid(self.thresholds - score)]


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def training_fold(key: Column) -> Column:
    """Keys that may be learnt from; the others measure the result."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS != 0


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel | None:
    """A model from labelled texts of the training folds, or None without any."""
    graded = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    rows = graded.filter(training_fold(F.col(key))).select(
        F.col(key).alias("_key"), grade(F.col("quality"), F.col("toxic")).alias("_grade"), F.xxhash64(F.col(key), F.lit(7)).alias("_draw")
    )
    # a share first, so that no task sends the whole sample's number of rows
    share = min(1.0, 1.2 * sample / max(1, rows.count()))
    chosen = rows.filter(F.pmod("_draw", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("_draw", "_key", "_grade").limit(sample)
    given = df.select(F.col(key).alias("_own"), F.col(text).alias("_text"))
    texts = given.join(F.broadcast(chosen), F.col("_own") == F.col("_key")).filter(F.col("_text").isNotNull())

    def run(k, g, t):
        found = features(t)
        return k, g, list(found), list(found.values())

    read = map_rows(
        texts.select(F.col("_key").cast("string"), "_grade", "_text"), run, "key string, grade int, slots array<int>, values array<float>"
    ).toArrow()
    read = read.filter(pc.greater(pc.list_value_length(read["slots"]), 0)).sort_by([("key", "ascending"), ("grade", "ascending")])
    if not len(read):
        return None
    sizes = pc.list_value_length(read["slots"]).to_numpy()
    return OrdinalModel().fit(
        np.repeat(np.arange(len(sizes)), sizes),
        pc.list_flatten(read["slots"]).to_numpy().astype(np.int64),
        pc.list_flatten(read["values"]).to_numpy().astype(np.float64),
        read["grade"].to_numpy().astype(np.int64),
    )


def grade_texts(df: DataFrame, model: OrdinalModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected_grade, tails) per row; tails are P(grade >= 1), P(grade >= 2)."""
    kind = df.schema[key].dataType.simpleString()

    def run(k, t):
        if model is None:
            tails = [float(bool((t or "").split()))] * (GRADES - 1)
        else:
            tails = model.tails(features(t))
        return k, sum(tails), tails

    return map_rows(df.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, expected_grade double, tails array<double>")


def accepted(df: DataFrame, model: OrdinalModel | None, text: str = "text", at_least: int = KEEP_GRADE, chance: float = KEEP_FROM) -> DataFrame:
    """Rows of ``df`` whose text reaches the grade with at least that probability, all columns kept."""
    columns, decision = df.columns, free(df, "_accepted")
    at = columns.index(text)

    def run(*row):
        t = row[at]
        good = bool((t or "").split()) if model is None else model.tails(features(t))[at_least - 1] >= chance
        return (*row, good)

    marked = map_rows(df, run, df.select("*", F.lit(True).alias(decision)).schema)
    return marked.filter(F.col(decision)).select(*columns)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the top grade and the decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = grade_texts(docs, model)
    top = F.get("tails", F.lit(KEEP_GRADE - 1))
    return found.select("doc_id", "expected_grade", top.alias("p_good"), (top >= KEEP_FROM).alias("accepted"))
