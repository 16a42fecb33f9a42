"""Language identification by a small byte convolutional network, trained here in numpy.

A text is its UTF-8 bytes with ASCII letters lowered and all other ASCII as
blanks, cut into windows of :data:`LENGTH` bytes over its whole length.  The
network embeds bytes, applies filters of several widths, takes the maximum of
each filter over the window, and ends in a softmax over the languages seen in
training.  A text's prediction averages the log probabilities of its windows,
weighted by their letters; windows are batched across texts.

Training reads at most about :data:`TEXTS` labelled texts of each language,
chosen by a seeded hash, and :data:`WINDOWS` windows of each, spread over the
whole text.  That sample is the one thing the driver gets; prediction is one
pass over the rows without a shuffle.

A null text, or one without a letter, is ``und`` with score 0, as is every text
if there is nothing to learn from.  Rows that repeat are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import flat_map_rows, table

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TEXTS = 1_000
WINDOWS = 6
EPOCHS = 5
BATCH = 64
RATE = 4e-3
BLOCK = 256
FOLDS = 5
UNDETERMINED = "und"

#: Bytes as the network sees them: a-z, bytes beyond ASCII, and one blank for the rest.
BYTES = np.zeros(256, np.uint8)
BYTES[128:] = np.arange(128, 256)
for _c in range(26):
    BYTES[65 + _c] = BYTES[97 + _c] = 97 + _c


def windows_of(text: str) -> np.ndarray:
    """(n, LENGTH) windows over the whole text, the last one filled with blanks."""
    raw = BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = max(1, -(-len(raw) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, LENGTH)


class ByteNetwork:
    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype(np.float32)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.weights["out_bias"] = np.zeros(len(labels), np.float32)

    def _columns(self, embedded: np.ndarray, width: int) -> np.ndarray:
        """(windows * positions, width * EMBEDDING): the input of a filter at each position."""
        flat = np.ascontiguousarray(embedded).reshape(len(embedded), -1)
        seen = np.lib.stride_tricks.sliding_window_view(flat, width * EMBEDDING, axis=1)[:, ::EMBEDDING]
        return seen.reshape(-1, width * EMBEDDING)

    def forward(self, windows: np.ndarray, keep: bool = False):
        p, n = self.weights, len(windows)
        embedded = p["embed"][windows]
        pooled, trail = [], []
        for w in WIDTHS:
            seen = self._columns(embedded, w)
            active = (seen @ p[f"conv{w}"] + p[f"bias{w}"]).reshape(n, -1, FILTERS)
            if keep:
                best = active.argmax(axis=1)
                trail.append((seen, best))
                top = np.take_along_axis(active, best[:, None], 1)[:, 0]
            else:
                top = active.max(axis=1)
            pooled.append(np.maximum(top, 0))
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ p["out"] + p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return (logs, hidden, trail) if keep else logs

    def gradients(self, windows: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.weights, len(windows)
        logs, hidden, trail = self.forward(windows, keep=True)
        delta = np.exp(logs)
        delta[np.arange(n), targets] -= 1
        delta /= n
        found = {"out": hidden.T @ delta, "out_bias": delta.sum(axis=0)}
        back = (delta @ p["out"].T) * (hidden > 0)
        embed = np.zeros_like(p["embed"])
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            seen, best = trail[i]
            mine = back[:, i * FILTERS : (i + 1) * FILTERS]
            # only the position of the maximum has a gradient
            at = seen.reshape(n, -1, w * EMBEDDING)[rows, best]
            found[f"conv{w}"] = np.einsum("nfd,nf->df", at, mine)
            found[f"bias{w}"] = mine.sum(axis=0)
            into = (mine[:, :, None] * p[f"conv{w}"].T[None]).reshape(-1, EMBEDDING)
            bytes_at = windows[rows[:, :, None], best[:, :, None] + np.arange(w)].reshape(-1)
            np.add.at(embed, bytes_at, into)
        found["embed"] = embed
        return found

    def train(self, windows: np.ndarray, targets: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        """Adam over shuffled batches; the order is seeded."""
        rng, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        total = max(1, epochs * (-(-len(windows) // BATCH)))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                chosen, step = order[at : at + BATCH], step + 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in self.gradients(windows[chosen], targets[chosen]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.weights[k] -= (
                        rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                    ).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and probability per text."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        sums = np.zeros((len(texts), len(self.labels)))
        weight = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal held, owner, size
            if size:
                windows, of = np.concatenate(held), np.concatenate(owner)
                for at in range(0, size, BLOCK):
                    part, whose = windows[at : at + BLOCK], of[at : at + BLOCK]
                    letters = (part > 0).sum(axis=1).astype(float)
                    np.add.at(sums, whose, self.forward(part) * letters[:, None])
                    np.add.at(weight, whose, letters)
            held, owner, size = [], [], 0

        asked = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        for i in asked:
            windows = windows_of(texts[i])
            held.append(windows)
            owner.append(np.full(len(windows), i))
            size += len(windows)
            if size >= 16 * BLOCK:
                flush()
        flush()
        for i in asked:
            mean = sums[i] / max(1.0, weight[i])
            shares = np.exp(mean - mean.max())
            best = int(shares.argmax())
            names[i], scores[i] = self.labels[best], float(shares[best] / shares.sum())
        return names, scores


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def training_windows(df: DataFrame, key: str, text: str, label: str, texts: int = TEXTS, windows: int = WINDOWS) -> list:
    """(label, window) of a bounded sample, in a fixed order."""
    sized = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = sized.groupBy(label).agg(F.count("*").alias("n"))
    if counts.limit(1001).count() > 1000:
        raise ValueError(f"{label} has over 1,000 values")
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(9)), F.lit(1 << 30))
    shares = counts.select(F.col(label).alias("_l"), F.least(F.lit(1.0), F.lit(float(texts)) / F.col("n")).alias("_share"))
    chosen = sized.join(F.broadcast(shares), F.col(label) == F.col("_l")).filter(draw < F.col("_share") * (1 << 30))

    def cut(k, name, t):
        found = windows_of(t)
        for i in np.unique(np.linspace(0, len(found) - 1, min(windows, len(found))).astype(int)):
            if (found[i] > 0).sum() >= 4:
                yield k, name, int(i), found[i].tobytes()

    rows = flat_map_rows(
        chosen.select(F.col(key).cast("string"), F.col(label), F.col(text)), cut, "key string, label string, at int, window binary"
    ).collect()
    return sorted((r.label, r.key or "", r.at, bytes(r.window)) for r in rows)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", **options) -> ByteNetwork | None:
    """A network for the labels of ``df``, or None if nothing is labelled."""
    rows = training_windows(df, key, text, label, **options)
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    network = ByteNetwork(labels)
    windows = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, LENGTH)
    network.train(windows, np.array([labels.index(r[0]) for r in rows]))
    return network


def predict_language(df: DataFrame, network: ByteNetwork | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row."""
    rows = df.select(F.col(key), F.col(text))
    if network is None:
        return rows.select(key, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([rows.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = network.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(out.field(0).type), pa.array(names, pa.string()).cast(out.field(1).type), pa.array(scores, pa.float64())], schema=out
            )

    return rows.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = train(docs.filter(fold(F.col("doc_id")) != 0))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return predict_language(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
