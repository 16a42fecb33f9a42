"""Time the headline queries once each on a warm session; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import catalogue, dedup  # noqa: E402
from millrace.plans.registry import table  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINES = (
    "source_profile",
    "source_lang_profile",
    "skip_reasons",
    "budget_gate_cross",
    "balanced_mix",
    "round_robin",
    "mixed_corpus",
    "unify_schema",
    "pack_blocks",
    "sft_examples",
    "near_dedup",
    "pass_at_k",
    "robust_pass",
    "status_counts",
    "bleu_corpus",
    "token_accuracy",
    "brace_close",
    "diff_apply",
)


def near_dedup_256(spark, sf_dir):
    """The near-duplicate job with its default 256 permutations."""
    return dedup.deduplicate(table(spark, sf_dir, "documents"), "doc_id", "text")[0]


def timed(fn, spark, sf_dir) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    jobs = {name: found[name] for name in HEADLINES} | {"near_dedup_256": near_dedup_256}
    timed(found["source_profile"], spark, sf_dir)
    timed(found["encoded_ids"], spark, sf_dir)
    seconds = {name: timed(fn, spark, sf_dir) for name, fn in jobs.items()}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
