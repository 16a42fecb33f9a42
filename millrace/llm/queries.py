"""The queries of this subpackage by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import (
    decontaminate,
    fingerprints,
    html,
    langid,
    licenses,
    linededup,
    merkle,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    spelling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_simhash_dedup": simhash.op8_simhash_dedup,
    "op9_order_minhash": fingerprints.op9_order_minhash,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_packing": packing.op12_packing,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op2_line_dedup": linededup.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op6_source_mixing": mixing.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
