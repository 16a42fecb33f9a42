"""Budget, mixing and unified-schema queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.keys import order_hash
from millrace.functions.templates import pair_text, parse_pair
from millrace.operators import budget, interleave, profile, select
from millrace.operators.extract import (
    DEFAULT_LABELS,
    SourceSpec,
    assemble_text,
    code_meta,
    code_text,
    prose_meta,
    prose_text,
    unify,
    web_meta,
    web_text,
)
from millrace.plans.mix import SourceInput, balanced_pairs, build_mix, group_key, manifest
from millrace.plans.registry import (
    TOKEN_DOCS,
    mixed_documents,
    query,
    rounded,
    sql_order,
    sql_tokens,
    sql_unit,
    sql_words,
    table,
    token_documents,
)
from millrace.session import ensure_checkpoint_dir, materialize
from millrace.sources import writers

GATE_TARGET = 20_000
REPORT_TARGETS = budget.fraction_targets(60_000, {"src0": 0.5, "src1": 0.25, "src2": 0.25}) | {
    "src3": 10_000_000,
    "src4": 0,
}
BALANCE_TOTAL = 300_000


def keyed_documents(spark, sf_dir):
    return token_documents(spark, sf_dir).withColumn("order_key", order_hash("doc_id", 42))


KEYED_DOCS = f"{TOKEN_DOCS}, keyed AS (SELECT doc_id, source, lang, est_tokens, {sql_order('doc_id', 42)} AS k FROM docs)"


@query(f"""
WITH {KEYED_DOCS}, run AS (SELECT *, coalesce(sum(est_tokens) OVER (PARTITION BY source ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, source, est_tokens FROM run WHERE before < {GATE_TARGET}""")
def budget_gate_cross(spark, sf_dir):
    kept = budget.within_budget(keyed_documents(spark, sf_dir), GATE_TARGET)
    return kept.select("doc_id", "source", "est_tokens")


@query(f"""
WITH {KEYED_DOCS}, run AS (SELECT *, sum(est_tokens) OVER w AS upto, row_number() OVER w AS rn FROM keyed
  WINDOW w AS (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, est_tokens FROM run WHERE upto <= {GATE_TARGET} OR rn = 1""")
def budget_gate_floor(spark, sf_dir):
    kept = budget.within_budget(keyed_documents(spark, sf_dir), GATE_TARGET, mode="floor")
    return kept.select("doc_id", "source", "est_tokens")


@query(f"""
WITH {KEYED_DOCS}, targets(source, target_tokens) AS (VALUES ('src0', 30000), ('src1', 15000), ('src2', 15000), ('src3', 10000000)),
run AS (SELECT k.*, target_tokens, coalesce(sum(est_tokens) OVER (PARTITION BY k.source ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed k JOIN targets t ON k.source = t.source),
sums AS (SELECT source, target_tokens, sum(est_tokens) AS w FROM run WHERE before < target_tokens GROUP BY ALL),
rolled AS (SELECT coalesce(source, 'TOTAL') AS source, CAST(sum(target_tokens) AS BIGINT) AS target_tokens,
  CAST(sum(w) AS BIGINT) AS written_tokens FROM sums GROUP BY ROLLUP (source))
SELECT source, target_tokens, written_tokens,
  round(written_tokens * 100.0 / (SELECT sum(w) FROM sums), 6) AS share_pct FROM rolled""")
def budget_report(spark, sf_dir):
    kept = budget.within_budget(keyed_documents(spark, sf_dir), select.funded(REPORT_TARGETS))
    return rounded(budget.budget_report(kept, REPORT_TARGETS), "share_pct")


AVAILABILITY_SQL = f"""{KEYED_DOCS}, grouped AS (SELECT *, source || '/' || lang AS grp, row_number() OVER (
    PARTITION BY source || '/' || lang ORDER BY k) AS r FROM keyed),
avail AS (SELECT grp, count(*) AS n_rows, avg(est_tokens) FILTER (r <= 200 AND est_tokens > 0) AS avg_tokens,
  CAST(floor(count(*) * coalesce(avg(est_tokens) FILTER (r <= 200 AND est_tokens > 0), 0)) AS BIGINT) AS available
  FROM grouped GROUP BY grp)"""
def allocation_sql(total: int) -> str:
    """Equal shares up to what groups have, from the level at which the total is spent."""
    return f"""levels AS (SELECT grp, available, floor(({total} - coalesce(sum(available) OVER (ORDER BY available, grp
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER (ORDER BY available, grp
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS level FROM avail),
water AS (SELECT max(level) AS level FROM levels WHERE available > level),
alloc AS (SELECT grp, available, CAST(least(available, coalesce((SELECT level FROM water), available))
  + floor(greatest({total} - (SELECT sum(available) FROM avail), 0) / (SELECT count(*) FROM avail)) AS BIGINT) AS budget FROM avail)"""


ALLOCATION_SQL = f"{AVAILABILITY_SQL}, {allocation_sql(BALANCE_TOTAL)}"


def grouped_documents(spark, sf_dir):
    return keyed_documents(spark, sf_dir).withColumn("grp", group_key("source", "lang"))


def document_availability(spark, sf_dir):
    return availability_of(grouped_documents(spark, sf_dir))


def availability_of(d):
    return budget.availability(d, "grp", "doc_id", "est_tokens", F.col("est_tokens") > 0, 42)


@query(f"WITH {AVAILABILITY_SQL} SELECT grp, n_rows, round(avg_tokens, 6) AS avg_tokens, available FROM avail")
def group_availability(spark, sf_dir):
    return rounded(document_availability(spark, sf_dir), "avg_tokens")


@query(f"WITH {ALLOCATION_SQL} SELECT grp, budget AS target_tokens FROM alloc")
def balanced_allocation(spark, sf_dir):
    return budget.balanced_targets(document_availability(spark, sf_dir), "grp", BALANCE_TOTAL)


@query(f"""
WITH {ALLOCATION_SQL}, run AS (
  SELECT g.doc_id, g.grp, g.est_tokens, a.budget, sum(g.est_tokens) OVER w AS upto, row_number() OVER w AS rn
  FROM grouped g JOIN alloc a ON g.grp = a.grp WHERE g.est_tokens >= 32
  WINDOW w AS (PARTITION BY g.grp ORDER BY g.k ROWS UNBOUNDED PRECEDING))
SELECT doc_id, grp, est_tokens FROM run WHERE budget > 0 AND (upto <= budget OR rn = 1)""")
def balanced_mix(spark, sf_dir):
    # words are counted once: probe, gate and result read the narrow table
    d = materialize(grouped_documents(spark, sf_dir))
    targets = budget.balanced_targets(availability_of(d), "grp", BALANCE_TOTAL)
    usable = d.filter(select.within_length(high=None))
    kept = budget.within_budget(usable, targets, group="grp", mode="floor")
    return kept.select("doc_id", "grp", "est_tokens")


@query(f"""
WITH numbered AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_order('doc_id', 42)}) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
sizes AS (SELECT lang, max(n) AS n, row_number() OVER (ORDER BY lang) - 1 AS subset_index FROM numbered GROUP BY lang),
turns AS (SELECT lang, n, subset_index, unnest(range((SELECT max(n) FROM sizes))) AS turn FROM sizes)
SELECT t.turn * (SELECT count(*) FROM sizes) + t.subset_index AS position, t.turn, t.subset_index, d.doc_id, d.lang
FROM turns t JOIN numbered d ON d.lang = t.lang AND d.i = t.turn % t.n""")
def round_robin(spark, sf_dir):
    d = keyed_documents(spark, sf_dir).select("doc_id", "lang", "order_key")
    out = interleave.round_robin(d, "lang", "order_key")
    return out.select(
        "doc_id", "lang", "turn", F.col("subset_index").cast("bigint").alias("subset_index"), "position"
    )


@query(f"""
WITH subsets AS (SELECT doc_id, nullif(lang, 'fr') AS lang FROM documents),
numbered AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_order('doc_id', 42)}) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM subsets),
sizes AS (SELECT lang, max(n) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS subset_index FROM numbered GROUP BY lang),
turns AS (SELECT lang, n, subset_index, unnest(range((SELECT max(n) FROM sizes))) AS turn FROM sizes)
SELECT t.turn * (SELECT count(*) FROM sizes) + t.subset_index AS position, t.turn, t.subset_index, d.doc_id, d.lang
FROM turns t JOIN numbered d ON d.lang IS NOT DISTINCT FROM t.lang AND d.i = t.turn % t.n""")
def round_robin_null_subset(spark, sf_dir):
    """A null subset takes turns like any other."""
    d = keyed_documents(spark, sf_dir).select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), "order_key")
    out = interleave.round_robin(d, "lang", "order_key")
    return out.select("doc_id", "lang", "turn", F.col("subset_index").cast("bigint").alias("subset_index"), "position")


def turn_pairs(spark, sf_dir):
    """Each user turn with the assistant's answer that follows it."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered")
    )
    return asked.join(answered, ["conv_id", "turn"])


TURN_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS asked, a.text AS answered
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
PAIR_SQL = r"""'<source>' || chr(10) || asked || chr(10) || '</source>' || chr(10) || '<llvm_ir>' || chr(10) || answered || chr(10) || '</llvm_ir>'"""


def raw_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"),
        F.col("asked").alias("Source_Code"),
        F.col("answered").alias("IR_Original"),
        F.concat(F.lit("lang"), F.col("conv_id") % 3).alias("language"),
        F.when(F.col("conv_id") % 2 == 0, "Perf_Optimized").otherwise("Size_Optimized").alias("ir_type"),
    )


@query(f"""
WITH {TURN_PAIRS}, tagged AS (SELECT *, {PAIR_SQL} AS text FROM pairs)
SELECT conv_id, turn, text, regexp_extract(text, '(?s)<source>\n(.*?)\n</source>', 1) AS source_code,
  regexp_extract(text, '(?s)<llvm_ir>\n(.*?)\n</llvm_ir>', 1) AS llvm_ir FROM tagged""")
def pair_template_roundtrip(spark, sf_dir):
    p = turn_pairs(spark, sf_dir).withColumn("text", pair_text("asked", "answered"))
    code, ir = parse_pair("text")
    return p.select("conv_id", "turn", "text", code.alias("source_code"), ir.alias("llvm_ir"))


MIX_TARGETS = {"pes2o": 120_000, "the_stack": 60_000, "openwebmath": 2_000, "stack_llvm": 0}


def mix_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return [
        SourceInput(SourceSpec("pes2o", prose_text, prose_meta, keep_prob=0.75), d, "doc_id"),
        SourceInput(SourceSpec("the_stack", code_text, code_meta, allowed_langs=("en", "DE", "llvm")), d, "doc_id"),
        SourceInput(SourceSpec("stack_llvm", code_text, code_meta, allowed_langs=("llvm",)), d, "doc_id"),
        SourceInput(
            SourceSpec("openwebmath", web_text, web_meta),
            table(spark, sf_dir, "benchmark").withColumn("url", F.concat(F.lit("item/"), "item_id")),
            "item_id",
        ),
    ]


MIX_SQL = f"""rows_in AS (
  SELECT 'pes2o' AS source, CAST(doc_id AS VARCHAR) AS key, text, 120000 AS target, source AS m FROM documents WHERE {sql_unit('doc_id', 42)} <= 0.75
  UNION ALL SELECT 'the_stack', CAST(doc_id AS VARCHAR), text, 60000, lang FROM documents WHERE lower(lang) IN ('en', 'de')
  UNION ALL SELECT 'openwebmath', CAST(item_id AS VARCHAR), text, 2000, 'item/' || item_id FROM benchmark),
est AS (SELECT *, {sql_tokens('text')} AS est_tokens, {sql_order("source || '/' || key", 42)} AS k FROM rows_in),
run AS (SELECT *, coalesce(sum(est_tokens) OVER (PARTITION BY source ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM est WHERE text <> '' AND est_tokens >= 32),
mix AS (SELECT * FROM run WHERE before < target)"""


@query(f"WITH {MIX_SQL} SELECT source, key, est_tokens, text, m FROM mix")
def mixed_corpus(spark, sf_dir):
    mix = build_mix(mix_sources(spark, sf_dir), MIX_TARGETS)
    shown = F.coalesce(F.col("meta")["source"], F.col("meta")["lang"], F.col("meta")["url"])
    return mix.select("source", "key", "est_tokens", "text", shown.alias("m"))


FUNDED_SQL = ", ".join(f"('{name}', {target})" for name, target in sorted(MIX_TARGETS.items()) if target > 0)


@query(f"""
WITH {MIX_SQL}, planned AS (SELECT * FROM (VALUES {FUNDED_SQL}) t(source, target)),
written AS (SELECT p.source, p.target, CAST(coalesce(sum(m.est_tokens), 0) AS BIGINT) AS tokens FROM planned p LEFT JOIN mix m ON m.source = p.source GROUP BY ALL)
SELECT 42 AS seed, 32 AS min_tokens_per_record, CAST(sum(tokens) AS BIGINT) AS tokens_written,
  string_agg(source || ':' || target || ':' || tokens, ',' ORDER BY source) AS sources FROM written""")
def run_manifest(spark, sf_dir):
    """The manifest as it is written to its file and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    writers.write_manifest(manifest(build_mix(mix_sources(spark, sf_dir), MIX_TARGETS), MIX_TARGETS, 42), path)
    schema = "seed int, min_tokens_per_record int, tokens_written bigint, sources array<struct<source: string, target_tokens: bigint, written_tokens: bigint>>"
    shown = F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["target_tokens"].cast("string"), s["written_tokens"].cast("string")))
    return spark.read.schema(schema).json(path).select("seed", "min_tokens_per_record", "tokens_written", F.array_join(shown, ",").alias("sources"))


PAIR_TOKENS = f"CAST(trunc(({sql_words('asked')} + {sql_words('answered')} + 5) * 1.5) AS BIGINT)"


@query(f"""
WITH {TURN_PAIRS}, rows_in AS (SELECT conv_id || ':' || turn AS pair_id, asked, answered, {PAIR_TOKENS} AS t,
  'lang' || (conv_id % 3) AS language, CASE WHEN conv_id % 2 = 0 THEN 'Perf_Optimized' ELSE 'Size_Optimized' END AS ir_type FROM pairs),
grouped AS (SELECT *, language || '/' || ir_type AS grp, md5('42:' || pair_id) AS k,
  row_number() OVER (PARTITION BY language || '/' || ir_type ORDER BY md5('42:' || pair_id)) AS r FROM rows_in),
avail AS (SELECT grp, CAST(floor(count(*) * avg(t) FILTER (r <= 200)) AS BIGINT) AS available FROM grouped GROUP BY grp),
{allocation_sql(30_000)},
run AS (SELECT g.*, budget, sum(t) OVER w AS upto, row_number() OVER w AS rn FROM grouped g JOIN alloc a ON g.grp = a.grp
  WHERE t >= 32 WINDOW w AS (PARTITION BY g.grp ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT pair_id AS key, language, ir_type, t AS est_tokens, {PAIR_SQL} AS text FROM run WHERE budget > 0 AND (upto <= budget OR rn = 1)""")
def balanced_pair_mix(spark, sf_dir):
    pairs = balanced_pairs(raw_pairs(spark, sf_dir), "pair_id", 30_000)
    return pairs.select(
        "key",
        F.col("meta")["language"].alias("language"),
        F.col("meta")["ir_type"].alias("ir_type"),
        "est_tokens",
        "text",
    )


def unify_input(spark, sf_dir):
    """Records of all five kinds: pairs, bare IR, code, prose, web; some pairs are broken."""
    pairs = raw_pairs(spark, sf_dir)
    broken = F.col("pair_id").endswith(":2")
    paired = pairs.select(
        F.col("pair_id").alias("key"),
        F.when(broken, F.col("Source_Code")).otherwise(pair_text("Source_Code", "IR_Original")).alias("text"),
        F.lit(DEFAULT_LABELS.paired).alias("source"),
        F.create_map(F.lit("language"), "language", F.lit("ir_type"), "ir_type").alias("meta"),
        F.length("Source_Code").cast("bigint").alias("est_tokens"),
    )
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in ("stack_llvm", "the_stack", "pes2o", "openwebmath")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    other = d.select(
        F.col("doc_id").cast("string").alias("key"),
        "text",
        kind.alias("source"),
        F.create_map(F.lit("lang"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))).alias("meta"),
        F.when(F.col("doc_id") % 10 > 0, F.col("n_chars")).alias("est_tokens"),
    )
    return paired.unionByName(other)


UNIFY_SQL = rf"""{TURN_PAIRS}, mixed AS (
  SELECT conv_id || ':' || turn AS key, CASE WHEN turn = 2 THEN asked ELSE {PAIR_SQL} END AS text, 'paired_ir' AS source,
    'lang' || (conv_id % 3) AS language, CASE WHEN conv_id % 2 = 0 THEN 'Perf_Optimized' ELSE 'Size_Optimized' END AS ir_type,
    length(asked) AS est_tokens FROM pairs
  UNION ALL SELECT CAST(doc_id AS VARCHAR), text, ['stack_llvm', 'the_stack', 'pes2o', 'openwebmath'][doc_id % 4 + 1],
    CASE WHEN lang = 'en' THEN '' ELSE lang END, NULL, CASE WHEN doc_id % 10 > 0 THEN n_chars END FROM documents),
unified AS (SELECT key,
  CASE source WHEN 'paired_ir' THEN regexp_extract(text, '(?s)<source>\n(.*?)\n</source>', 1) WHEN 'stack_llvm' THEN NULL ELSE text END AS source_code,
  CASE source WHEN 'paired_ir' THEN regexp_extract(text, '(?s)<llvm_ir>\n(.*?)\n</llvm_ir>', 1) WHEN 'stack_llvm' THEN text END AS llvm_ir,
  CASE source WHEN 'paired_ir' THEN language WHEN 'stack_llvm' THEN 'LLVM' WHEN 'the_stack' THEN coalesce(nullif(language, ''), 'code')
    WHEN 'pes2o' THEN 'scientific' ELSE 'math' END AS language,
  ir_type, source AS source_dataset, coalesce(est_tokens, 0) AS est_tokens FROM mixed)"""


@query(f"WITH {UNIFY_SQL} SELECT * FROM unified")
def unify_schema(spark, sf_dir):
    return unify(unify_input(spark, sf_dir), keep=("key",))


@query(f"""
WITH {UNIFY_SQL} SELECT count(*) AS records,
  count(*) FILTER (source_dataset = 'paired_ir' AND source_code <> '' AND llvm_ir <> '') AS both_fields,
  count(*) FILTER (source_dataset = 'paired_ir' AND NOT (source_code <> '' AND llvm_ir <> '')) AS parse_miss FROM unified""")
def parse_quality(spark, sf_dir):
    return profile.parse_quality(unify(unify_input(spark, sf_dir)), DEFAULT_LABELS.paired)


@query(f"""
WITH {UNIFY_SQL}, texts AS (SELECT key, CASE
  WHEN source_dataset = 'paired_ir' THEN CASE WHEN source_code <> '' AND llvm_ir <> '' THEN
    '<source>' || chr(10) || source_code || chr(10) || '</source>' || chr(10) || '<llvm_ir>' || chr(10) || llvm_ir || chr(10) || '</llvm_ir>' END
  WHEN source_dataset = 'stack_llvm' THEN nullif(llvm_ir, '') ELSE nullif(source_code, '') END AS text FROM unified)
SELECT * FROM texts WHERE text IS NOT NULL""")
def assembled_text(spark, sf_dir):
    unified = unify(unify_input(spark, sf_dir), keep=("key",))
    texts = unified.select("key", assemble_text(unified).alias("text"))
    return select.non_empty_rows(texts, "text")


@query(f"""
WITH {UNIFY_SQL} SELECT language AS value, count(*) AS records FROM unified WHERE source_dataset = 'paired_ir' GROUP BY ALL
UNION ALL SELECT ir_type, count(*) FROM unified WHERE source_dataset = 'paired_ir' GROUP BY ALL""")
def pair_value_counts(spark, sf_dir):
    pairs = unify(unify_input(spark, sf_dir)).filter(F.col("source_dataset") == DEFAULT_LABELS.paired)
    return profile.value_counts(pairs, "language").unionByName(profile.value_counts(pairs, "ir_type"))
