"""Packing, split and instruction-data queries, and the whole tokenize job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.bytepair import byte_pair_file, byte_symbols
from millrace.functions.encoders import Encoder, code_points
from millrace.functions.text import has_text
from millrace.operators import instruct, pack, profile
from millrace.operators.extract import DEFAULT_LABELS, SourceLabels, assemble_text, unify
from millrace.operators.prefix import ROWS_PER_BUCKET
from millrace.plans.mix import build_mix
from millrace.plans.mixing import MIX_SQL, MIX_TARGETS, TURN_PAIRS, mix_sources, turn_pairs
from millrace.plans.registry import joined, query, rounded, sql_order, table
from millrace.session import materialize, spread_small

BLOCK = 512
# Small buckets, so that the queries cross bucket borders on small tables too.
BUCKET_ROWS = 100


def tokenize_corpus(
    unified: DataFrame,
    key: str,
    encoder: Encoder,
    block_size: int,
    validation: float = 0.0,
    scope: str = "global",
    labels: SourceLabels = DEFAULT_LABELS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Unified table to training blocks with a ``split`` column, in the order of ``key``.

    ``key`` may be the mix's ``order_key``.  The encoded documents are written
    once, so that a slow tokenizer runs once although packing reads lengths
    first and ids later.  The number of blocks follows from the lengths; no
    block is written only to be counted or split.
    """
    texts = unified.select(key, assemble_text(unified, labels).alias("text")).filter(has_text("text"))
    encoded = materialize(pack.encode_documents(spread_small(texts), "text", encoder, [key]))
    blocks = pack.pack_blocks(encoded, key, block_size, scope, rows_per_bucket=rows_per_bucket)
    block_key, keys = "block_id", None
    if scope == "batch":
        # how many blocks a batch gives is known from the packing only
        blocks = profile.require_rows(materialize(blocks)).withColumn("block_key", F.concat_ws("/", "batch", "block_id"))
        block_key = "block_key"
    else:
        tokens = encoded.agg(F.sum(F.size("input_ids").cast("bigint"))).first()[0] or 0
        keys = encoded.sparkSession.range(tokens // block_size).withColumnRenamed("id", "block_id")
        profile.require_rows(keys)
    if validation > 0:
        blocks = pack.split_random(blocks, block_key, validation, keys=keys)
    else:
        blocks = blocks.withColumn("split", F.lit("train"))
    return pack.training_columns(blocks)


def encoded_documents(spark, sf_dir):
    d = spread_small(table(spark, sf_dir, "documents").filter(has_text("text")).select("doc_id", "text"))
    return pack.encode_documents(d, "text", code_points(eos=0), ["doc_id"])


def stored_documents(spark, sf_dir):
    return materialize(encoded_documents(spark, sf_dir))


STREAM = """chars AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda c: unicode(c)) || [0]) AS id,
    generate_subscripts(string_split(text, '') || ['x'], 1) AS p FROM documents WHERE text <> ''),
stream AS (SELECT id, row_number() OVER (ORDER BY doc_id, p) - 1 AS pos FROM chars)"""
BLOCKS_SQL = f"""{STREAM}, blocks AS (SELECT pos // {BLOCK} AS block_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
  FROM stream GROUP BY 1 HAVING count(*) = {BLOCK})"""


def packed(spark, sf_dir):
    return pack.pack_blocks(stored_documents(spark, sf_dir), "doc_id", BLOCK, rows_per_bucket=BUCKET_ROWS)


@query("""
SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)) || [0], ',') AS input_ids
FROM documents WHERE text <> ''""")
def encoded_ids(spark, sf_dir):
    return encoded_documents(spark, sf_dir).select("doc_id", joined("input_ids").alias("input_ids"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie; every machine has them at the same place."""
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return str(public_tokenizers.path(name))


SYMBOLS_SQL = ", ".join("'" + s.replace("'", "''") + "'" for s in byte_symbols())
PIECES_SQL = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+"


@query(rf"""
WITH RECURSIVE model AS MATERIALIZED (
  SELECT model FROM read_json('{vocabulary_path()}', columns = {{'model': 'STRUCT(vocab MAP(VARCHAR, INTEGER), merges VARCHAR[][])'}}, maximum_object_size = 100000000)),
merges AS MATERIALIZED (SELECT m[1] AS l, m[2] AS r, rank FROM (SELECT unnest(model.merges) AS m, generate_subscripts(model.merges, 1) AS rank FROM model)),
tokens AS MATERIALIZED (SELECT e.key AS token, e.value AS id FROM (SELECT unnest(map_entries(model.vocab)) AS e FROM model)),
cut AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), '{PIECES_SQL}') AS p FROM documents WHERE text <> ''),
pieces AS MATERIALIZED (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS place FROM cut),
work AS (
  SELECT piece, 0 AS step, list_transform(range(0, octet_length(encode(piece))),
    lambda i: [{SYMBOLS_SQL}][CAST('0x' || substr(hex(encode(piece)), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) + 1]) AS syms
  FROM (SELECT DISTINCT piece FROM pieces)
  UNION ALL
  SELECT piece, step + 1, list_concat(list_concat(syms[1:best.p - 1], [syms[best.p] || syms[best.p + 1]]), syms[best.p + 2:])
  FROM (SELECT a.piece, a.step, a.syms, min({{'rank': m.rank, 'p': a.p}}) AS best
    FROM (SELECT piece, step, syms, unnest(range(1, len(syms))) AS p FROM work) a JOIN merges m ON m.l = a.syms[a.p] AND m.r = a.syms[a.p + 1] GROUP BY ALL)),
merged AS (SELECT piece, arg_max(syms, step) AS syms FROM work GROUP BY piece),
parts AS (SELECT piece, unnest(syms) AS token, generate_subscripts(syms, 1) AS k FROM merged),
ids AS (SELECT piece, list(id ORDER BY k) AS ids FROM parts JOIN tokens USING (token) GROUP BY piece)
SELECT doc_id, CAST(sum(len(ids)) AS BIGINT) AS n_ids, string_agg(array_to_string(ids, ','), ',' ORDER BY place) AS input_ids
FROM pieces JOIN ids USING (piece) GROUP BY doc_id""")
def byte_pair_ids(spark, sf_dir):
    encoder = byte_pair_file(spark, f"file://{vocabulary_path()}", eos=50_256)
    d = spread_small(table(spark, sf_dir, "documents").filter(has_text("text")).select("doc_id", "text"))
    ids = d.select("doc_id", encoder("text").alias("input_ids"))
    return ids.select("doc_id", F.size("input_ids").cast("bigint").alias("n_ids"), joined("input_ids").alias("input_ids"))


@query(f"""
WITH {BLOCKS_SQL} SELECT block_id, input_ids, repeat('1,', {BLOCK - 1}) || '1' AS attention_mask, input_ids AS labels FROM blocks""")
def pack_blocks(spark, sf_dir):
    b = pack.training_columns(packed(spark, sf_dir))
    return b.select("block_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(f"""
WITH numbered AS (SELECT text, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS batch, doc_id FROM documents WHERE text <> ''),
chars AS (SELECT batch, doc_id, unnest(list_transform(string_split(text, ''), lambda c: unicode(c)) || [0]) AS id,
  generate_subscripts(string_split(text, '') || ['x'], 1) AS p FROM numbered),
stream AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, p) - 1 AS pos FROM chars)
SELECT batch, pos // {BLOCK} AS block_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
FROM stream GROUP BY ALL HAVING count(*) = {BLOCK}""")
def pack_blocks_by_batch(spark, sf_dir):
    b = pack.pack_blocks(
        stored_documents(spark, sf_dir), "doc_id", BLOCK, "batch", batch_records=300, rows_per_bucket=BUCKET_ROWS
    )
    return b.select("batch", "block_id", joined("input_ids").alias("input_ids"))


@query(f"WITH t AS (SELECT sum(length(text) + 1) AS n FROM documents WHERE text <> '') SELECT CAST(n // {BLOCK} AS BIGINT) AS blocks, CAST(n // {BLOCK} * {BLOCK} AS BIGINT) AS tokens FROM t")
def pack_summary(spark, sf_dir):
    return pack.pack_summary(packed(spark, sf_dir), BLOCK)


@query(f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_order('doc_id', 42)}) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= ceil(0.05 * n) THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_random(spark, sf_dir):
    return pack.split_random(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= round_even(n * 0.05, 0) THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_head(spark, sf_dir):
    return pack.split_head(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, BUCKET_ROWS)


@query("""
WITH t AS (SELECT count(*) AS rows_before, count(*) FILTER (text <> '' AND source <> 'src7') AS rows_after FROM documents)
SELECT *, rows_before - rows_after AS rows_dropped, round((rows_before - rows_after) * 100.0 / rows_before, 6) AS dropped_pct FROM t""")
def assemble_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    unified = d.select(
        F.when(F.col("source") != "src7", F.col("text")).alias("source_code"),
        F.lit(None).cast("string").alias("llvm_ir"),
        F.col("source").alias("source_dataset"),
    )
    texts = unified.select(assemble_text(unified).alias("text"))
    return rounded(profile.before_after(unified, texts.filter(has_text("text"))), "dropped_pct")


@query(f"""
WITH {MIX_SQL}, chars AS (SELECT k, unnest(list_transform(string_split(text, ''), lambda c: unicode(c)) || [0]) AS id,
  generate_subscripts(string_split(text, '') || ['x'], 1) AS p FROM mix),
stream AS (SELECT id, row_number() OVER (ORDER BY k, p) - 1 AS pos FROM chars),
blocks AS (SELECT pos // {BLOCK} AS block_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids
  FROM stream GROUP BY 1 HAVING count(*) = {BLOCK}),
r AS (SELECT *, row_number() OVER (ORDER BY {sql_order('block_id', 42)}) AS r, count(*) OVER () AS n FROM blocks)
SELECT block_id, input_ids, CASE WHEN r <= ceil(0.1 * n) THEN 'validation' ELSE 'train' END AS split FROM r""")
def tokenize_mix(spark, sf_dir):
    """Mix, unify, tokenize and pack in the mix's own order."""
    mix = build_mix(mix_sources(spark, sf_dir), MIX_TARGETS)
    unified = unify(mix, keep=("order_key",))
    b = tokenize_corpus(unified, "order_key", code_points(eos=0), BLOCK, 0.1, rows_per_bucket=BUCKET_ROWS)
    return b.select("block_id", joined("input_ids").alias("input_ids"), "split")


MAX_IDS = 600
EXAMPLES_SQL = f"""{TURN_PAIRS}, asked AS (SELECT conv_id * 1000 + turn AS pair_id,
    '### Instruction:' || chr(10) || asked || chr(10) || chr(10) || '### Response:' || chr(10) AS p, answered || chr(3) AS a FROM pairs),
ids AS (SELECT pair_id, list_transform(string_split(p || a, ''), lambda c: unicode(c))[1:{MAX_IDS}] AS ids, least(length(p), {MAX_IDS}) AS n FROM asked),
ex AS (SELECT pair_id, ids, list_transform(ids, lambda x, i: CASE WHEN i <= n THEN -100 ELSE x END) AS labels FROM ids)"""


def examples(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    return instruct.supervised_examples(
        pairs, "pair_id", "asked", "answered", code_points(), MAX_IDS, chr(3), instruct.INSTRUCTION_LAYOUT
    )


@query(f"""
WITH {EXAMPLES_SQL} SELECT pair_id, array_to_string(ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM ex""")
def sft_examples(spark, sf_dir):
    e = examples(spark, sf_dir)
    return e.select("pair_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query(f"""
WITH {EXAMPLES_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 8 AS batch FROM ex),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS missing FROM b)
SELECT pair_id, batch, array_to_string(ids || list_transform(range(missing), lambda i: -1), ',') AS input_ids,
  array_to_string(labels || list_transform(range(missing), lambda i: -100), ',') AS labels,
  array_to_string(list_transform(ids, lambda i: 1) || list_transform(range(missing), lambda i: 0), ',') AS attention_mask FROM m""")
def sft_padded(spark, sf_dir):
    b = instruct.padded_batches(examples(spark, sf_dir), "pair_id", 8, -1, rows_per_bucket=BUCKET_ROWS)
    return b.select("pair_id", "batch", *[joined(c).alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query(f"""
WITH {TURN_PAIRS} SELECT conv_id, turn, '### Diff:' || chr(10) || asked || chr(10) || chr(10) || '### Message:' || chr(10) AS prompt,
  answered || '</s>' AS response FROM pairs""")
def diff_message_prompts(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        instruct.prompt("asked", instruct.DIFF_LAYOUT).alias("prompt"),
        instruct.response("answered", "</s>").alias("response"),
    )
