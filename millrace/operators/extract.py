"""From heterogeneous source rows to the document table, and on to the unified schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.templates import pair_text, parse_pair
from millrace.functions.text import (
    col,
    estimate_tokens,
    first_map_value,
    first_present,
    non_empty,
    strip,
)

# Field names under which public dataset versions keep the same thing.
PAIR_SOURCE_KEYS = ("Source_Code", "source", "code", "src", "input")
PAIR_IR_KEYS = ("IR_Original", "ir", "llvm_ir", "llvm", "target", "output")
LANGUAGE_KEYS = ("language", "lang", "source_lang")
PROSE_TEXT_KEYS = ("text", "content")
PROSE_META_KEYS = {"id": ("id", "doc_id"), "source": ("source", "venue")}
CODE_TEXT_KEYS = ("content", "text", "code")
CODE_META_KEYS = {
    "lang": ("lang", "language"),
    "repo": ("max_stars_repo_name", "repo_name"),
    "license": ("license",),
}
WEB_TEXT_KEYS = ("text",)
WEB_META_KEYS = {"url": ("url",)}


@dataclass(frozen=True)
class SourceLabels:
    """Values of the ``source`` column that decide how a record is unified.

    ``paired`` holds tagged source/IR text, ``ir_only`` bare IR.  Every other
    source is text; ``code``, ``prose`` and ``math`` get a language label.
    """

    paired: str = "paired_ir"
    ir_only: str = "stack_llvm"
    code: str = "the_stack"
    prose: str = "pes2o"
    math: str = "openwebmath"


DEFAULT_LABELS = SourceLabels()


@dataclass(frozen=True)
class SourceSpec:
    """How one source becomes documents.

    ``text`` and ``meta`` take the raw frame, so that missing columns are
    resolved while the plan is built, and return columns.
    """

    name: str
    text: Callable[[DataFrame], Column]
    meta: Callable[[DataFrame], Column]
    fraction: float = 0.0
    keep_prob: float = 1.0
    allowed_langs: Sequence[str] | None = None
    subsets: Sequence[str] = field(default_factory=tuple)


def text_from(keys: Sequence[str]) -> Callable[[DataFrame], Column]:
    return lambda df: first_present(df, keys)


def meta_from(keys: dict[str, Sequence[str]]) -> Callable[[DataFrame], Column]:
    def build(df: DataFrame) -> Column:
        entries: list[Column] = []
        for name, alternatives in keys.items():
            entries += [F.lit(name), first_present(df, alternatives)]
        return F.create_map(*entries)

    return build


def paired_text(df: DataFrame) -> Column:
    return pair_text(first_present(df, PAIR_SOURCE_KEYS), first_present(df, PAIR_IR_KEYS))


paired_meta = meta_from({"language": LANGUAGE_KEYS, "ir_type": ("ir_type",)})
prose_text = text_from(PROSE_TEXT_KEYS)
prose_meta = meta_from(PROSE_META_KEYS)
code_text = text_from(CODE_TEXT_KEYS)
code_meta = meta_from(CODE_META_KEYS)
web_text = text_from(WEB_TEXT_KEYS)
web_meta = meta_from(WEB_META_KEYS)


def envelope(
    df: DataFrame,
    name: Column | str,
    text: Column,
    meta: Column,
    key: Column | str,
    tokens: Column | None = None,
) -> DataFrame:
    """The document table: order key, text, source, metadata, token estimate."""
    source = F.lit(name) if isinstance(name, str) else name
    return df.select(
        col(key).alias("key"),
        text.alias("text"),
        source.alias("source"),
        meta.alias("meta"),
        (estimate_tokens(text) if tokens is None else tokens).alias("est_tokens"),
    )


def extract(df: DataFrame, spec: SourceSpec, key: Column | str) -> DataFrame:
    return envelope(df, spec.name, spec.text(df), spec.meta(df), key)


def report_language(meta: Column | str) -> Column:
    """Language tag for reports: either key, trimmed, empty when absent."""
    return strip(first_map_value(meta, ("language", "lang")))


def unified_language(source: Column | str, meta: Column | str, labels: SourceLabels = DEFAULT_LABELS) -> Column:
    source = col(source)
    return (
        F.when(source == labels.paired, first_map_value(meta, ("language", "lang")))
        .when(source == labels.ir_only, F.lit("LLVM"))
        .when(source == labels.code, first_map_value(meta, ("lang", "language"), "code"))
        .when(source == labels.prose, F.lit("scientific"))
        .when(source == labels.math, F.lit("math"))
        .otherwise(F.lit(""))
    )


def unify(df: DataFrame, labels: SourceLabels = DEFAULT_LABELS, keep: Sequence[str] = ()) -> DataFrame:
    """Documents in the six-column schema; nulls mark the side a source does not have."""
    source = F.col("source")
    code, ir = parse_pair("text")
    paired, ir_only = source == labels.paired, source == labels.ir_only
    return df.select(
        *keep,
        F.when(paired, code).when(~ir_only, F.coalesce("text", F.lit(""))).alias("source_code"),
        F.when(paired, ir).when(ir_only, F.coalesce("text", F.lit(""))).alias("llvm_ir"),
        unified_language(source, "meta", labels).alias("language"),
        F.when(paired, F.col("meta")["ir_type"]).alias("ir_type"),
        source.alias("source_dataset"),
        F.coalesce(F.col("est_tokens").cast("bigint"), F.lit(0)).alias("est_tokens"),
    )


def assemble_text(df: DataFrame, labels: SourceLabels = DEFAULT_LABELS) -> Column:
    """Training text from the unified schema; null when a needed side is missing."""
    source = F.col("source_dataset")
    return (
        F.when(source == labels.paired, pair_text("source_code", "llvm_ir", missing=None))
        .when(source == labels.ir_only, non_empty("llvm_ir"))
        .otherwise(non_empty("source_code"))
    )


def preview(text: Column | str, chars: int = 200) -> Column:
    """One-line head of a text for reports."""
    return F.substring(F.replace(col(text), F.lit("\n"), F.lit(" ")), 1, chars)

