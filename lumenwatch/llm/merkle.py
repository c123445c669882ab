"""Merkle dataset manifest: levels of hash trees as concatenated hex strings, worked with by SQL substrings.

A leaf is the SHA-256 of a row's fields. The leaves of a group (a source) ascend by id; every three neighbouring nodes
become their hash until one is left, and the groups' roots make a tree of the same kind.

Leaves are numbered by ranges: each task numbers its own sorted range and a prefix sum over tasks adds what stands
before, so a group that holds most rows spreads over all tasks. ``BLOCK`` neighbouring nodes, an aligned power of three,
form one row whose levels are hex strings of 64 characters a node. A run of three is a fixed-width substring, its hash
the parent; the siblings of a node are the substrings on its two sides. The tops of blocks are the nodes of the next
round, so a tree of n leaves takes log(n) / log(BLOCK) rounds and no row holds more than a block. Paths are handed
down the same way, joined once a block.

Defined cases: a null field counts as ``-``; a null group is a group of its own, first in order; null ids stand first;
rows that repeat an id stand by leaf; rows that are equal in all fields have equal leaves, each with its own place; a
lone leaf is its group's root, a lone group's root the root; an empty table gives no rows; columns that are not
fields are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.session import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, DEPTH = 3, 5
BLOCK = ARITY**DEPTH
#: Hex characters of a digest, and of a run of siblings.
NODE, RUN = 64, 64 * ARITY

_HEIGHT = f"CASE {' '.join(f'WHEN total <= {ARITY**k} THEN {k}' for k in range(DEPTH))} ELSE {DEPTH} END"
#: The levels of a block: level 0 is given, each next one hashes the runs of the last.
_LEVELS = f"""
aggregate(slice(sequence(1, {DEPTH}), 1, height), array(level), (levels, k) -> concat(levels, array(array_join(transform(
    sequence(0, CAST((length(element_at(levels, -1)) - 1) DIV {RUN} AS INT)),
    i -> sha2(substring(element_at(levels, -1), i * {RUN} + 1, {RUN}), 256)), ''))))
"""
#: For each node of a block its fields and, level by level, the siblings before and after the node above it.
_NODES = f"""
transform(kids, (kid, i) -> named_struct('kid', kid, 'steps', transform(slice(levels, 1, height), (level, k) -> named_struct(
    'left', substring(level, CAST(i DIV width(k) - i DIV width(k) % {ARITY} AS INT) * {NODE} + 1, CAST(i DIV width(k) % {ARITY} AS INT) * {NODE}),
    'right', substring(level, CAST(i DIV width(k) AS INT) * {NODE} + {NODE + 1}, CAST({ARITY - 1} - i DIV width(k) % {ARITY} AS INT) * {NODE})))))
""".replace("width(k)", f"element_at(array({', '.join(str(ARITY**k) for k in range(DEPTH))}), k + 1)")
_STEPS = "array<struct<left:string,right:string>>"


def leaf_of(values: Sequence[Column]) -> Column:
    """SHA-256 of fields: each is ``-`` if null, else its number of UTF-8 bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _group(of: Column) -> Column:
    """A name of the group without null; the null group's sorts first."""
    return F.coalesce(F.concat(F.lit("s"), of.cast("string")), F.lit(""))


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with ``place`` (from 0) within ``g`` in the order given, and ``total``, the rows of ``g``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    dealt = settle(dealt, name).withColumn("task", F.shiftright("at", 33))
    held = dealt.groupBy("g", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = settle(held.select(
        "g", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("total")
    ), f"{name}-tasks")
    return dealt.join(held, ["g", "task"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def _rounds(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Tables of blocks, from the leaves up: g, block, height, levels, kids. The last one has one block for each g.

    ``leaves`` has g, place, total, leaf, and what else a leaf carries.
    """
    most = leaves.agg(F.max("total")).first()[0] or 0
    carried = [c for c in leaves.columns if c not in ("g", "total")]
    out = []
    while True:
        kids = F.array_sort(F.collect_list(F.struct(*carried)))
        blocks = leaves.groupBy("g", F.expr(f"place DIV {BLOCK}").alias("block")).agg(F.first("total").alias("total"), kids.alias("kids"))
        blocks = blocks.withColumn("level", F.array_join(F.transform("kids", lambda k: k["leaf"]), "")).withColumn("height", F.expr(_HEIGHT))
        blocks = blocks.withColumn("levels", F.expr(_LEVELS)).withColumn("top", F.element_at("levels", -1)).drop("level")
        out.append(settle(blocks, f"{name}-{len(out)}"))
        if most <= BLOCK:
            return out
        most = -(-most // BLOCK)
        leaves = out[-1].select("g", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("leaf"))
        carried = ["place", "leaf"]


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf with its steps up to the root: g, the leaf's own columns, steps, and the columns of ``tops``.

    ``tops`` has for each g the steps above its root, and columns to hand down.
    """
    above, more = tops.withColumn("block", F.lit(0).cast("long")), [c for c in tops.columns if c not in ("g", "steps")]
    for blocks in reversed(rounds):
        joined = blocks.drop("total", "top").join(above.withColumnRenamed("steps", "upper"), ["g", "block"])
        nodes = joined.select("g", "upper", *more, F.explode(F.expr(_NODES)).alias("node"))
        above = nodes.select("g", F.col("node.kid.*"), F.concat("node.steps", "upper").alias("steps"), *more).withColumnRenamed("place", "block")
    return above.drop("block")


def manifest(docs: DataFrame, group: str = "source", doc_id: str = "doc_id", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row for each of the input: doc_id, leaf, subroot, root, steps, and with ``changed`` the leaf of the changed fields.

    ``steps`` is the proof: for each level from the leaf to the root the siblings' digests before and after it.
    """
    other = leaf_of([(changed or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(doc_id).alias("doc_id"), _group(F.col(group)).alias("g"), leaf_of([F.col(f) for f in fields]).alias("leaf"), other.alias("changed_leaf"))
    rounds = _rounds(_numbered(rows, ["doc_id", "leaf"], "leaves"), "blocks")
    roots = rounds[-1].select(F.col("g").alias("of"), F.col("top").alias("leaf"), F.lit("").alias("g"))
    upper = _rounds(_numbered(roots, ["of"], "group-roots"), "group-blocks")
    root = upper[-1].select("g", F.col("top").alias("root"), F.array().cast(_STEPS).alias("steps"))
    tops = settle(_paths(upper, root).select(F.col("of").alias("g"), F.col("leaf").alias("subroot"), "root", "steps"), "group-paths")
    return _paths(rounds, tops).select("doc_id", "leaf", "changed_leaf", "subroot", "root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives together with the siblings of its path."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    # A third party's tampering, for half of the documents: line feeds go.
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(touched, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = manifest(docs, changed={"text": text})
    rows = rows.withColumn("folded_root", folded(F.col("changed_leaf"), F.col("steps")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _oracle() -> str:
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    tree = """SELECT {g} AS g, 0 AS lvl, i, leaf AS h, n FROM {of}
      UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 3"""
    steps = """SELECT {key} AS key, {tree} AS tree, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < own.i // (3 ** t.lvl)::BIGINT), '') AS l,
        coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > own.i // (3 ** t.lvl)::BIGINT), '') AS r
      FROM {of} own JOIN {name} t ON t.g = own.g AND t.n > 1 AND t.i // 3 = own.i // (3 ** (t.lvl + 1))::BIGINT GROUP BY ALL"""
    return f"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
e AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 2 = 0, false) AS touched FROM documents, c),
d AS (SELECT doc_id, {leaf('text')} AS leaf, {leaf("(CASE WHEN touched THEN replace(text, chr(10), '') ELSE text END)")} AS leaf2, coalesce('s' || source, '') AS g FROM e),
s AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS ({tree.format(g='g', of='s', name='t')}),
q AS (SELECT g AS key, 0 AS g, h AS leaf, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS ({tree.format(g='g', of='q', name='u')}),
low AS ({steps.format(key='own.rid', tree=0, of='s', name='t')}),
high AS ({steps.format(key='own.key', tree=1, of='q', name='u')}),
p AS (SELECT rid, l, r, row_number() OVER (PARTITION BY rid ORDER BY tree, lvl) AS k FROM (
    SELECT key AS rid, tree, lvl, l, r FROM low UNION ALL SELECT s.rid, tree, lvl, l, r FROM s JOIN high ON high.key = s.g)),
f AS (SELECT rid, 0::BIGINT AS k, leaf2 AS h FROM s UNION ALL SELECT f.rid, f.k + 1, sha256(p.l || f.h || p.r) FROM f JOIN p ON p.rid = f.rid AND p.k = f.k + 1),
z AS (SELECT rid, arg_max(h, k) AS h FROM f GROUP BY rid),
w AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS x FROM p GROUP BY rid)
SELECT s.doc_id, s.leaf, q.leaf AS subroot, u.h AS root, sha256(coalesce(w.x, '')) AS proof_sha256, z.h AS folded_root, z.h = u.h AS verified
FROM s JOIN q ON q.key = s.g JOIN u ON u.n = 1 JOIN z USING (rid) LEFT JOIN w USING (rid)
"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _oracle()}
