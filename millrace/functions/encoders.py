"""Text to token ids, as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import slices
from millrace.functions.text import col


@dataclass(frozen=True)
class Encoder:
    """Ids of a text, without truncation or special tokens, and the document separator."""

    ids: Callable[[Column], Column]
    eos: int | None = None
    pad: int | None = None

    def __call__(self, text: Column | str) -> Column:
        return self.ids(col(text))

    def with_separator(self, text: Column | str) -> Column:
        """Ids of a document followed by the separator id."""
        if self.eos is None:
            raise ValueError("the encoder has no separator id; set eos")
        return F.concat(self(text), F.array(F.lit(self.eos)))


IDS = T.ArrayType(T.IntegerType())


def _list_array(sequences: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(sequences) + 1, dtype=np.int32)
    np.cumsum([len(s) for s in sequences], out=offsets[1:])
    values = np.concatenate(sequences) if sequences else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


@F.arrow_udf(IDS)
def _code_points(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in slices(batches):
        yield _list_array([np.frombuffer((t or "").encode("utf-32-le"), dtype="<i4") for t in texts.to_pylist()])


def code_points(eos: int | None = 0, pad: int | None = -1) -> Encoder:
    """One id per character, its code point; needs no vocabulary.

    An Arrow batch function: splitting a string into an array of characters in
    SQL costs several times more.
    """
    return Encoder(_code_points, eos, pad)


def vocabulary_file(path: str, eos: int | None, pad: int | None = None) -> Encoder:
    """A trained tokenizer stored as one JSON file that every executor can read.

    The file is loaded once per Python worker task and applied to Arrow batches.
    """

    @F.arrow_udf(IDS)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in slices(batches):
            found = tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            yield _list_array([np.array(e.ids, dtype=np.int32) for e in found])

    return Encoder(encode, eos, pad)
