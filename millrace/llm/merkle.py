"""Merkle manifest of a dataset: a tree of digests per group, a tree over the groups, and a proof for every row.

**Nodes.**  A row's leaf is the SHA-256 of its columns, each as ``-`` if null,
else its UTF-8 byte count, a colon and its value.  The leaves of a group, in
ascending key order, are joined three by three (:data:`ARITY`; the last run may
be shorter, even a single node) by the SHA-256 of their hex digests, level by
level, until one node is left, the subroot.  Subroots in order of their group,
null first, give the root likewise.

**Windows.**  Rows of a group are numbered by bucketed running totals and dealt
into stretches of 3^:data:`LEVELS` consecutive ones, which no run of those levels
crosses.  A stretch is sorted once.  On level k a node stands on the row of its
first leaf, so its neighbours stand 3^k and 2*3^k rows away: lag and lead columns
of these fixed offsets, masked by the node's slot in its run, are its siblings,
and the row of each first child hashes the parent.  Beyond the end of a run there
is no row, or the slot masks it.  A running last value hands the siblings on to
the rows below the node.  The node that a stretch leaves is a row of the next,
3^LEVELS times shorter table, until every group has one node; so a hundred
billion rows take four exchanges, and no task sees more than a stretch.

**Proofs.**  A row's path is the siblings left and right of its ancestors, from
the leaf up.  Folding any leaf along it gives the root only if the leaf is the
one in the manifest.

Rows of equal key are ordered by leaf; rows alike in all columns are told apart
by a number and have equal leaves.  Null keys come first.  A null or repeated
group is a group like any other, an empty table has no rows and no root.  Other
columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.operators.prefix import range_bounds, range_bucket, with_running_totals
from millrace.session import broadcast_if_small, join_unique_side, materialize

ARITY = 3
#: Levels that one exchange serves: 2,187 rows of a stretch are within a window's memory buffer.
LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 16_384
HOT_ROWS = 100_000


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column | str) -> Column:
    """``-`` for null, else UTF-8 byte count, colon and value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column | str) -> Column:
    return digest(*[encoded(v) for v in values])


def ordered_group(group: Column | str) -> Column:
    """Text that is never null and sorts like the group, null first."""
    text = (F.col(group) if isinstance(group, str) else group).cast("string")
    return F.coalesce(F.concat(F.lit("s"), text), F.lit("n"))


def ordered_key(key: Column | str) -> Column:
    """Text that is never null and sorts like an integer key, null first."""
    number = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    shifted = F.lower(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))))
    return F.coalesce(F.concat(F.lit("k"), F.lpad(shifted, 16, "0")), F.lit("!"))


def numbered(nodes: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place inside its group from 0 on; no task sees a whole group."""
    bounds = range_bounds(nodes, order[0], ROWS_PER_BUCKET, MAX_BUCKETS)
    return with_running_totals(nodes, {"pos": F.lit(1)}, order, range_bucket(order[0], bounds), group)


def stretch_paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(group, pos, n, stretch, path, top): the siblings on the way up through ``levels`` levels.

    ``path`` is an array of (l, r), the digests left and right of an ancestor.
    ``top``, on the first row of a stretch, is the node that is left of it.
    """
    width = ARITY**levels
    df = nodes.select("group", "pos", "n", F.col("node").alias("node0"), F.floor(F.col("pos") / width).alias("stretch"))
    order = Window.partitionBy("group", "stretch").orderBy("pos")
    none = F.lit("")
    for k in range(levels):
        step = ARITY**k
        node = F.col(f"node{k}")
        near = df.withColumns(
            {"lag2": F.lag(node, 2 * step).over(order), "lag1": F.lag(node, step).over(order), "lead1": F.lead(node, step).over(order), "lead2": F.lead(node, 2 * step).over(order)}
        )
        slot = F.floor(F.col("pos") / step) % ARITY
        is_node = F.col("pos") % step == 0
        many = F.col("n") > step  # this level still has several nodes
        left = F.when(slot == 0, none).when(slot == 1, F.col("lag1")).otherwise(F.concat("lag2", "lag1"))
        right = F.when(slot == 0, F.concat(F.coalesce("lead1", none), F.coalesce("lead2", none))).when(slot == 1, F.coalesce("lead1", none)).otherwise(none)
        first = is_node & (slot == 0)
        parent = F.when(first & many, digest(node, F.coalesce("lead1", none), F.coalesce("lead2", none))).when(first, node)
        df = near.withColumns({f"l{k}": F.when(is_node & many, left), f"r{k}": F.when(is_node & many, right), f"node{k + 1}": parent}).drop("lag2", "lag1", "lead1", "lead2")
        if k:
            df = df.drop(f"node{k}")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    handed = df.withColumns({f"{side}{k}": F.last(f"{side}{k}", ignorenulls=True).over(so_far) for k in range(levels) for side in "lr"})
    steps = F.filter(F.array(*[F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(levels)]), lambda s: s["l"].isNotNull())
    return handed.select("group", "pos", "n", "stretch", F.col("node0").alias("node"), steps.alias("path"), F.col(f"node{levels}").alias("top"))


def tree_paths(nodes: DataFrame, largest: int, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Paths of all nodes to the root of their group, (group, pos, n, node, path), and the roots, (group, node).

    ``nodes`` has (group, pos, n, node), n being the size of the group and
    ``largest`` the size of the largest one.
    """
    width = ARITY**levels
    tables = []
    while True:
        done = materialize(stretch_paths(nodes, levels))
        tables.append(done)
        nodes = done.filter(F.col("pos") % width == 0).select(
            "group", F.col("stretch").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("node")
        )
        largest = -(-largest // width)
        if largest <= 1:
            break
    paths = tables.pop().drop("stretch", "top")
    while tables:
        above = paths.select("group", F.col("pos").alias("stretch"), F.col("path").alias("rest"))
        below = tables.pop().drop("top")
        # one row above for a stretch of rows below, so no key is hot
        paths = below.join(broadcast_if_small(above), ["group", "stretch"]).select("group", "pos", "n", "node", F.concat("path", "rest").alias("path"))
    return paths, nodes.select("group", "node")


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, levels: int = LEVELS, **other: Column) -> tuple[DataFrame, str | None]:
    """(key, leaf, subroot, path, others) per row, and the root of the dataset.

    ``other`` columns, over those of ``df``, are computed where the leaves are;
    a copy of a row with other values folds along the row's own path.
    """
    picked = df.select(
        F.col(key).alias("key"), ordered_group(group).alias("group"), ordered_key(key).alias("_key"), leaf(*columns).alias("node"),
        F.monotonically_increasing_id().alias("number"), *[c.alias(f"other_{n}") for n, c in other.items()],
    )
    leaves = materialize(picked.withColumn("_key", F.concat("_key", F.substring("node", 1, 8))))
    groups = materialize(leaves.groupBy("group").agg(F.count("*").alias("n")))
    count, largest = groups.agg(F.count("*"), F.max("n")).first()
    kept = [f"other_{n}" for n in other]
    if not count:
        empty = leaves.select("key", F.col("node").alias("leaf"), F.col("node").alias("subroot"), F.array(F.struct(F.lit("").alias("l"), F.lit("").alias("r"))).alias("path"), *kept)
        return empty.withColumnsRenamed({f"other_{n}": n for n in other}), None
    placed = materialize(numbered(leaves, ["_key", "node", "number"], ["group"]).drop("_key", "number"))
    rows = placed.count()
    sized = join_unique_side(placed.select("group", "pos", "node"), groups.withColumn("rows", F.col("n")), ["group"], "rows", HOT_ROWS, rows)
    paths, subroots = tree_paths(sized, largest, levels)
    # the tree over the groups has one group, whose nodes are the subroots
    tops = materialize(numbered(subroots, ["group"], [])).select(F.col("group").alias("name"), F.lit("").alias("group"), "pos", F.lit(count).cast("bigint").alias("n"), "node")
    upper, root = tree_paths(tops.drop("name"), count, levels)
    ends = tops.select("name", "pos", F.col("node").alias("subroot")).join(upper.select("pos", F.col("path").alias("rest")), "pos")
    ends = materialize(ends.join(groups.withColumnRenamed("group", "name"), "name").select(F.col("name").alias("group"), "subroot", "rest", "n"))
    whole = join_unique_side(paths.drop("n"), ends, ["group"], "n", HOT_ROWS, rows)
    own = whole.select("group", "pos", F.col("node").alias("leaf"), "subroot", F.concat("path", "rest").alias("path"))
    found = own.join(placed.drop("node"), ["group", "pos"]).select("key", "leaf", "subroot", "path", *kept)
    return found.withColumnsRenamed({f"other_{n}": n for n in other}), root.first()["node"]


def siblings(path: Column | str) -> Column:
    """All digests of a path from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(start: Column | str, path: Column | str) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, F.col(start) if isinstance(start, str) else start, lambda node, s: digest(s["l"], node, s["r"]))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a copy without line ends gives."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    given = leaf("doc_id", "source", "lang", "n_chars", text)
    rows, root = manifest(docs, given=given)
    folded_root = folded("given", "path")
    return rows.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        F.sha2(siblings("path"), 256).alias("proof_sha256"),
        folded_root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of ASCII text, bit by bit.
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _sql_leaf(text: str) -> str:
    parts = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


def _sql_tree(name: str, start: str) -> str:
    """Nodes (g, k, pos, n, node) of all levels; ``start`` selects the leaves as (g, k, pos, n, node)."""
    return f"""{name} AS ({start} UNION ALL
    SELECT g, k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, k, pos // 3, n)"""


def _sql_steps(tree: str) -> str:
    """(g, k, pos, l, r): what stands left and right of a node in its run."""
    return f"""SELECT a.g, a.k, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {tree} a JOIN {tree} b ON b.g = a.g AND b.k = a.k AND b.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY a.g, a.k, a.pos"""


SQL = f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_sql_leaf("text")} AS leaf,
  CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS given FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows_),
{_sql_tree("low", "SELECT g, 0 AS k, pos, n, leaf AS node FROM leaves")},
subroots AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_sql_tree("high", "SELECT 0 AS g, 0 AS k, pos, n, node FROM subroots")},
low_steps AS ({_sql_steps("low")}), high_steps AS ({_sql_steps("high")}),
path AS (
  SELECT e.g, e.pos, s.k, s.l, s.r FROM leaves e JOIN low_steps s ON s.g = e.g AND s.pos = e.pos // CAST(pow(3, s.k) AS BIGINT)
  UNION ALL
  SELECT e.g, e.pos, 100 + s.k, s.l, s.r FROM leaves e JOIN subroots t ON t.g = e.g JOIN high_steps s ON s.pos = t.pos // CAST(pow(3, s.k) AS BIGINT)),
paths AS (SELECT g, pos, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs, string_agg(l || r, '' ORDER BY k) AS proof FROM path GROUP BY g, pos),
folds AS (SELECT e.g, e.pos, 0 AS k, e.given AS node, coalesce(p.ls, []) AS ls, coalesce(p.rs, []) AS rs FROM leaves e LEFT JOIN paths p ON p.g = e.g AND p.pos = e.pos
  UNION ALL SELECT g, pos, k + 1, sha256(ls[k + 1] || node || rs[k + 1]), ls, rs FROM folds WHERE k < len(ls)),
root AS (SELECT node AS root FROM high WHERE n = 1)
SELECT e.doc_id, e.leaf, t.node AS subroot, root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM leaves e JOIN subroots t ON t.g = e.g LEFT JOIN paths p ON p.g = e.g AND p.pos = e.pos
JOIN folds f ON f.g = e.g AND f.pos = e.pos AND f.k = len(f.ls) CROSS JOIN root
"""
