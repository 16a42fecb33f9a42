"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier one is within one edit.

Lines are compared without blanks at their ends; lines below :data:`MIN_CHARS`
code points and blank ones always stay.  Order is document key (null last),
then line number.  A line is removed if any earlier line, removed or not, is
equal to it or differs by one inserted, deleted or replaced character.

1. Equal lines collapse by a 128-bit digest to their first place.
2. Of two lines within one edit, one half of the shorter is whole in the other:
   the start or the end.  Every distinct line gives the hashes of its halves, as
   the shorter and as the longer line of a pair.  Only lines that share a half
   go on; they know in which half the edit must be.
3. Those lines emit their deletion variants inside that half as hashed keys,
   in O(1) each from prefix sums.  Equal variants meet: two lines of one length
   that agree without position p, or a line and a longer one without p.  In the
   first kind of bucket all members are within one edit of each other, in the
   second each longer line is of the shorter one, so each member needs one
   partner, the earliest, and buckets of any size stay linear.
4. Each pair is verified on the texts by edit distance.

Rows that repeat a key and text are one document.  A null or empty text has no
lines to remove.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.text import let
from millrace.llm.common import free, table
from millrace.session import materialize, shuffled

MIN_CHARS = 20
BROADCAST_LINES = 500_000
PLACE = ["late", "doc", "line_no", "tie"]
#: Kinds of shared halves: start or end is whole, as the shorter or equal line, or as the longer line.
START, END, LONG_START, LONG_END = range(4)
#: Roles in a bucket: equal length; the shorter line; the longer line.
EQUAL, SHORT, LONG = range(3)
#: The role whose earliest member removes a member.
AGAINST = {EQUAL: EQUAL, SHORT: LONG, LONG: SHORT}

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def lines_of(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))


def _halves(line: Column, n: Column) -> Column:
    """Hashes of the four halves, in the order of the kinds."""

    def pair(short: Column) -> list[Column]:
        m = F.floor(short / 2).cast("int")
        start = F.substring(line, F.lit(1), m)
        end = F.substring(line, n - (short - m) + 1, short - m)
        return [F.xxhash64(short, F.lit(0), start), F.xxhash64(short, F.lit(1), end)]

    return F.array(*pair(n), *pair(n - 1))


def eligible_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(late, doc, line_no, tie, h1, h2, halves) of every line that is compared."""
    rows = docs.select("doc", "tie", F.posexplode(lines_of("text")).alias("line_no", "raw"))
    sized = rows.select("doc", "tie", "line_no", trimmed(F.col("raw")).alias("line")).withColumn("n", F.char_length("line"))
    return sized.filter(F.col("n") >= max(2, min_chars)).select(
        F.col("doc").isNull().alias("late"), "doc", "line_no", "tie",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        _halves(F.col("line"), F.col("n")).alias("halves"),
    )


def first_places(lines: DataFrame) -> DataFrame:
    """One row per distinct line: its earliest place and its halves."""
    grouped = lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.any_value("halves").alias("halves"))
    return grouped.select("first.*", "halves")


def candidates(firsts: DataFrame) -> DataFrame:
    """(place, kinds): lines that share a half with another line, and which."""
    keys = firsts.select(*PLACE, F.posexplode("halves").alias("kind", "half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    return keys.join(shuffled(shared), "half").groupBy(*PLACE).agg(F.collect_set("kind").alias("kinds"))


def line_texts(docs: DataFrame, found: DataFrame, bound: int = BROADCAST_LINES) -> DataFrame:
    """(place, kinds, line) for candidate places; up to ``bound`` of them are broadcast instead of shuffling texts."""
    wanted = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("line_no", "kinds")).alias("wanted"))
    wanted = F.broadcast(wanted) if found.limit(bound + 1).count() <= bound else shuffled(wanted)
    d, w = docs.alias("d"), wanted.alias("w")
    met = d.join(w, F.col("d.doc").eqNullSafe(F.col("w.doc")) & (F.col("d.tie") == F.col("w.tie")))
    rows = met.select("d.doc", "d.tie", lines_of("text").alias("lines"), F.explode("wanted").alias("x"))
    return rows.select(
        F.col("doc").isNull().alias("late"), "doc", F.col("x.line_no").alias("line_no"), "tie",
        F.col("x.kinds").alias("kinds"), trimmed(F.get("lines", F.col("x.line_no"))).alias("line"),
    ).dropDuplicates(PLACE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def line_keys(line: str, kinds: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, roles) of one line for the halves it shares.

    The hash of a text is the sum of its mixed characters times powers of BASE
    modulo 2^64; leaving out position p needs the sums before and after p only.
    """
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(chars)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = BASE
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(chars + np.uint64(1)) * powers[:n], out=sums[1:])
    without = sums[:n] + (sums[n] - sums[1:]) * UNBASE
    at = np.arange(n, dtype=np.uint64)
    parts: list[tuple[np.ndarray, int]] = []

    def add(hashes: np.ndarray, role: int, length: int, side: int, position: np.ndarray | int = 0) -> None:
        tag = np.uint64((length * 2 + side) * 4 + (0 if role == EQUAL else 1))
        parts.append((_mixed(hashes + _mixed(np.atleast_1d(tag + np.uint64(1) + (np.asarray(position, np.uint64) << np.uint64(36))))), role))

    whole = sums[n : n + 1]
    m, k = n // 2, (n - 1) // 2
    for kind, side, equal, long in (
        (START, 0, slice(m, n), None), (END, 1, slice(0, m), None), (LONG_START, 0, None, slice(k, n)), (LONG_END, 1, None, slice(0, k)),
    ):
        if kind not in kinds:
            continue
        if equal is not None:
            add(without[equal], EQUAL, n, side, at[equal])
            add(whole, SHORT, n, side)
        else:
            # leaving out either of two equal neighbours gives one variant
            add(np.unique(without[long]), LONG, n - 1, side)
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int8)
    keys = np.concatenate([p for p, _ in parts]).view(np.int64)
    return keys, np.concatenate([np.full(len(p), role, np.int8) for p, role in parts])


def variants(texts: DataFrame) -> DataFrame:
    """(key, role, place) for every deletion variant."""
    rows = texts.select(*PLACE, "kinds", "line")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("role", T.ByteType()), *[rows.schema[c] for c in PLACE]])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, lines = batch.column("kinds").to_pylist(), batch.column("line").to_pylist()
            keys, roles, at, held = [], [], [], 0
            for i, line in enumerate(lines):
                k, r = line_keys(line, set(kinds[i]))
                keys.append(k)
                roles.append(r)
                at.append(np.full(len(k), i))
                held += len(k)
                if held >= 100_000 or i == len(lines) - 1:
                    rows_at = pa.array(np.concatenate(at))
                    columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles))]
                    columns += [batch.column(c).take(rows_at).cast(out.field(c).type) for c in PLACE]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)
                    keys, roles, at, held = [], [], [], 0

    return rows.mapInArrow(run, schema)


def partners(found: DataFrame) -> DataFrame:
    """(place, partner): for each variant with an earlier line in its bucket, the earliest such line."""
    place = F.struct(*PLACE)
    lows = found.groupBy("key").agg(
        F.count("*").alias("n"), *[F.min(F.when(F.col("role") == r, place)).alias(f"low{r}") for r in (EQUAL, SHORT, LONG)]
    )
    # a line has as many variants as characters; both sides look no larger than the texts
    met = found.join(shuffled(lows.filter("n > 1")), "key")
    low = F.lit(None)
    for role, other in AGAINST.items():
        low = F.when(F.col("role") == role, F.col(f"low{other}")).otherwise(low)
    pairs = met.select(place.alias("place"), low.alias("partner")).filter(F.col("partner") < F.col("place"))
    return pairs.distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Places of lines whose partner is truly within one edit."""
    lines = shuffled(texts.select(F.struct(*PLACE).alias("p"), "line"))
    own = pairs.join(lines.select(F.col("p").alias("place"), F.col("line").alias("a")), "place")
    both = own.join(lines.select(F.col("p").alias("partner"), F.col("line").alias("b")), "partner")
    return both.filter(F.levenshtein("a", "b", 1) >= 0).select("place").distinct().select("place.*")


def kept_lines(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, tie, kept): per document, the numbers of compared lines that stay."""
    docs = _documents(df, key, text)
    firsts = materialize(first_places(eligible_lines(docs, min_chars)))
    found = materialize(candidates(firsts))
    texts = materialize(line_texts(docs, found))
    gone = verified(partners(variants(texts)), texts)
    f, g = firsts.select(*PLACE).alias("f"), gone.alias("g")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")) for c in PLACE]
    return f.join(g, same, "left_anti").groupBy("doc", "tie").agg(F.collect_list("line_no").alias("kept"))


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, n_lines, removed) per row of ``df``: the numbers of the lines that go, from 0."""
    kept = kept_lines(df, key, text, min_chars)
    lines = lines_of("text")
    compared = F.filter(
        F.transform(lines, lambda line, i: F.when(F.char_length(trimmed(line)) >= max(2, min_chars), i)), lambda i: i.isNotNull()
    )
    rows = _documents(df, key, text).select("doc", "tie", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), compared.alias("compared"))
    joined = _beside(rows, kept)
    gone = F.array_except(F.coalesce("compared", F.array().cast("array<int>")), F.coalesce("kept", F.array().cast("array<int>")))
    return joined.select(F.col("doc").alias(key), F.col("n_lines").cast("bigint").alias("n_lines"), gone.alias("removed"))


def _beside(rows: DataFrame, kept: DataFrame) -> DataFrame:
    r, k = rows.alias("r"), kept.alias("k")
    same = F.col("r.doc").eqNullSafe(F.col("k.doc")) & (F.col("r.tie") == F.col("k.tie"))
    return r.join(k, same, "left").select("r.*", "k.kept")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with the removed lines cut out of the texts; rows and other columns stay.

    A row of a null text stays as it is.  A text that loses all its lines becomes empty.
    """
    doc, tie, stay_in = free(df, "_doc"), free(df, "_tie"), free(df, "_kept")
    kept = kept_lines(df, key, text, min_chars).select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("kept").alias(stay_in))
    joined = df.join(kept, F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(tie)), "left")
    numbers = F.coalesce(F.col(stay_in), F.array().cast("array<int>"))

    def cut(lines: Column) -> Column:
        short = F.filter(
            F.transform(lines, lambda line, i: F.when(F.char_length(trimmed(line)) < max(2, min_chars), i)), lambda i: i.isNotNull()
        )
        stay = F.sort_array(F.array_union(short, numbers))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    clean = let(lines_of(F.col(text)), cut)
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), clean)).select(*df.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, of removed ones, and which."""
    found = removed_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed_lines"),
    )


SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(parts[i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
compared AS (SELECT * FROM lines WHERE length(line) >= {MIN_CHARS}),
firsts AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS place FROM compared GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b
  ON a.n = b.n AND a.place < b.place AND (left(a.line, CAST(a.n // 2 AS BIGINT)) = left(b.line, CAST(b.n // 2 AS BIGINT))
      OR substr(a.line, CAST(a.n // 2 + 1 AS BIGINT)) = substr(b.line, CAST(b.n // 2 + 1 AS BIGINT)))
  WHERE levenshtein(a.line, b.line) <= 1
  UNION
  SELECT DISTINCT CASE WHEN a.place < b.place THEN b.line ELSE a.line END FROM firsts a JOIN firsts b
  ON a.n + 1 = b.n AND (left(a.line, CAST(a.n // 2 AS BIGINT)) = left(b.line, CAST(a.n // 2 AS BIGINT))
      OR right(a.line, CAST(a.n - a.n // 2 AS BIGINT)) = right(b.line, CAST(a.n - a.n // 2 AS BIGINT)))
  WHERE levenshtein(a.line, b.line) <= 1),
removed AS (
  SELECT c.doc_id, c.line_no FROM compared c JOIN firsts f USING (line)
  WHERE f.place < (c.doc_id, c.line_no) OR c.line IN (SELECT line FROM near)),
per_doc AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM removed GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_removed, coalesce(p.removed, '') AS removed_lines
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""
