"""Tagged pair text: written once, parsed back, and assembled from the unified schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col, has_text

# The tag layout that written corpora carry.
SOURCE_TAG = "source"
IR_TAG = "llvm_ir"


def _framed(tag: str, body: Column) -> list[Column]:
    return [F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>")]


def pair_text(source: Column | str, ir: Column | str, missing: str | None = "") -> Column:
    """Both sides in their tags; ``missing`` when either side is null or empty."""
    joined = F.concat(*_framed(SOURCE_TAG, col(source)), F.lit("\n"), *_framed(IR_TAG, col(ir)))
    return F.when(has_text(source) & has_text(ir), joined).otherwise(F.lit(missing))


def tag_body(text: Column | str, tag: str) -> Column:
    """Text inside the first ``tag``, without the framing newlines; empty on a miss."""
    return F.regexp_extract(col(text), f"(?s)<{tag}>\n(.*?)\n</{tag}>", 1)


def parse_pair(text: Column | str) -> tuple[Column, Column]:
    return tag_body(text, SOURCE_TAG), tag_body(text, IR_TAG)
