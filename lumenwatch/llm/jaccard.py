"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact sorted-array intersection.

Every pair of documents whose shingle sets reach the threshold t is found; results are groups of linked documents.

1. A counting sketch of fixed size estimates how common each shingle is. Rare shingles come first in the global order.
2. Signatures. Equal sets (by fingerprint) become one class. Two sets that reach t share one of the first
   n - ceil(t n) + 1 shingles of each in any global order, so these are the keys of a class. The first that they share is
   among the first n - ceil(2 t / (1 + t) n) + 1 of the smaller set: these are its low keys.
3. Classes that agree in two of their least hashes are tied to the class of least number, a star for each such
   agreement. This only gathers likely copies under one label early; it decides nothing.
4. Tiles. Keys with classes of two or more labels are cut into size bands, and classes of one tile and different labels
   are compared where the key is a low one of the smaller: sizes, then the bound on the overlap that the bits in which
   two bitmaps differ give. Large tiles are cut into cells of blocks, and a label that has most of a tile is not compared
   with itself. As the input grows most tiles are a few classes that share a word sequence by chance, so many are
   worked on at once; together they pass on at most a spanning forest of the pairs that may reach t.
5. Connected components over both give clusters; no pair that reaches t lies across two. In a cluster pairs are
   bounded by bitmaps again and decided by intersecting sorted arrays, except pairs that are linked already. A cluster
   of more than ``cell`` classes is cut into blocks that share a few hub classes; afterwards only classes outside the
   cluster's largest group are compared with the others, block by block.

Nothing here holds all members of a group at once: a task holds two blocks of at most ``cell`` classes, or small tiles of
about ``DEAL`` classes in all. Texts are met with the classes and rows that need them behind a bitmap of these, so that the
others are not shuffled. The sketch and the bitmaps are of fixed size, and all that is collected.

Defined cases: null, empty and blank texts have no shingles and link with nothing; equal sets always link; a null
``doc_id`` takes part but is never a group's name unless all are null; rows that repeat an id are documents of their own;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenwatch.llm.common import fresh, held_bits, may_hold, row_key, table
from lumenwatch.llm.components import components
from lumenwatch.llm.shingles import Shingler, bitmap, fingerprint, mixed, signature_bits
from lumenwatch.session import settle

SKETCH_BITS = 21
CELL = 1024
DEAL = 4096
SMALL = 24
HUBS = 8
_SLICE = 1 << 14


def _sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Counts of shingles by their top bits, over all documents: 2**bits numbers, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, seen = Shingler(width), np.zeros(1 << bits, np.uint32), False
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = True
                at, n = np.unique((shingler(text) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if seen:
            blocks = counts.reshape(-1, min(_SLICE, len(counts)))
            packed = [zlib.compress(b.view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for b in blocks]  # low bytes first, the others are mostly 0
            yield pa.RecordBatch.from_pydict({"block": list(range(len(blocks))), "counts": packed})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(min(_SLICE, 1 << bits), np.uint64)
        for raw in t["counts"]:
            total += np.frombuffer(zlib.decompress(raw.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]
        return pa.table({"block": t["block"][:1], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    schema = "block long, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    merged = parts.groupBy("block").applyInArrow(add, schema).collect()  # 2**bits numbers in all
    if not merged:
        return np.zeros(1 << bits, np.uint32)
    return np.concatenate([np.frombuffer(r.counts, "<u4") for r in sorted(merged)])


def _signatures(docs: DataFrame, width: int, percent: int, sketch: np.ndarray, bits: int) -> DataFrame:
    """doc_id, row (as given), n, fp, stars (agreement keys), keys (prefix shingles), lows (how many are low), bits (bitmap)."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch)
    usual = 4 * int(sketch.mean()) + 64

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, common = Shingler(width), counts.value
        salts = mixed(np.arange(1, 7, dtype=np.uint64))
        for batch in batches:
            rows = {"doc_id": batch.column(0), "row": batch.column(2), "n": [], "fp": [], "stars": [], "keys": [], "lows": [], "bits": []}
            for text in batch.column(1).to_pylist():
                s = shingler(text)
                n = len(s)
                rows["n"].append(n)
                if not n:
                    for name in ("fp", "stars", "keys", "lows", "bits"):
                        rows[name].append(None)
                    continue
                often = common[(s >> np.uint64(64 - bits)).astype(np.int64)]
                prefix = n - -(-percent * n // 100) + 1
                rare = s[often <= usual]
                rare = rare if len(rare) else s
                least = [int(mixed(rare ^ x).min()) for x in salts]
                pairs = [mixed(np.array([least[i]], np.uint64) + np.uint64(i)) + np.uint64(least[i + 1] >> 1) for i in (0, 2, 4)]
                rows["fp"].append(fingerprint(s))
                rows["stars"].append([int(p[0].astype(np.int64)) for p in pairs])
                # Sets are sorted by hash, so a stable sort by count orders by (count, hash).
                rows["keys"].append(s[np.argsort(often, kind="stable")[:prefix]].astype(np.int64))
                rows["lows"].append(n - -(-2 * percent * n // (100 + percent)) + 1)
                rows["bits"].append(bitmap(s, signature_bits(n)).tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("n", pa.int64()), ("fp", pa.binary()), ("stars", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("lows", pa.int64()), ("bits", pa.binary())])
    return docs.select("doc_id", "text", "row").mapInArrow(
        sign, "doc_id long, row string, n long, fp binary, stars array<bigint>, keys array<bigint>, lows long, bits binary"
    )


class Forest:
    """Disjoint sets of the members of a cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _may_reach(sizes: np.ndarray, signs: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Members after i (sizes ascend) whose size and bitmap leave room for the threshold.

    |A n B| >= t |A u B| gives |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|), and at least one shingle of A ^ B stands
    behind every bit in which the bitmaps differ.
    """
    stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
    apart = np.bitwise_count(signs[i + 1 : stop] ^ signs[i]).sum(1, dtype=np.int64)
    return i + 1 + np.flatnonzero(apart * (100 + percent) <= (100 - percent) * (sizes[i + 1 : stop] + sizes[i]))


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _may_reach_pairs(sizes: np.ndarray, bits: pa.Array, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (a is not the larger) leave room for the threshold, as in ``_may_reach``."""
    _, ends, data = bits.buffers()
    ends = np.frombuffer(ends, np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64) // 8
    words, starts, lengths = np.frombuffer(data, "<u8", len(data) // 8), ends[:-1], np.diff(ends)
    fits = sizes[b] * percent <= sizes[a] * 100
    room = (100 - percent) * (sizes[a] + sizes[b])
    both = lengths[a] * (1 << 32) + lengths[b]
    for shape in np.unique(both[fits]).tolist():
        x, y = shape >> 32, shape & (2**32 - 1)
        at, least = np.flatnonzero(fits & (both == shape)), min(x, y)
        for k in range(0, len(at), step := max(1, (1 << 18) // max(x, y))):
            some = at[k : k + step]
            left, right = (
                np.bitwise_or.reduce(words[starts[rows[some], None] + np.arange(n)].reshape(len(some), -1, least), axis=1) for rows, n in ((a, x), (b, y))
            )
            fits[some] = np.bitwise_count(left ^ right).sum(1, dtype=np.int64) * (100 + percent) <= room[some]
    return fits


def _tiles(percent: int):
    """Edges of many cells of tiles: a spanning forest of the pairs that may reach the threshold and differ in label."""

    def run(t: pa.Table) -> pa.Table:  # cells of about DEAL rows in all, each of at most two blocks
        names = ("key", "band", "i", "j", "n")
        order = np.lexsort([t[c].to_numpy() for c in reversed(names)])
        key, band, i, j, sizes = (t[c].to_numpy()[order] for c in names)
        nodes, labels = t["node"].to_numpy()[order], t["label"].to_numpy()[order]
        probe, low, own = (t[c].to_numpy(zero_copy_only=False)[order] for c in ("probe", "low", "own"))
        bits = t["bits"].take(pa.array(order)).combine_chunks()
        new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (key, band, i, j)], axis=0)]))
        counts = np.diff(np.concatenate([new, [len(order)]]))
        group, forest, out = np.unique(labels, return_inverse=True)[1], Forest(len(np.unique(labels))), []

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            """Edges between rows a and b, where a is not the larger, that may link what no edge has linked."""
            meet = (labels[a] != labels[b]) & low[a] & (own[a] | own[b]) & (probe[a] | probe[b])
            a, b = a[meet], b[meet]
            reach = _may_reach_pairs(sizes, bits, a, b, percent)
            a, b = a[reach], b[reach]
            first = np.unique(np.minimum(group[a], group[b]) * (len(group) + 1) + np.maximum(group[a], group[b]), return_index=True)[1]
            out.extend((nodes[x], nodes[y]) for x, y in zip(a[first].tolist(), b[first].tolist()) if forest.join(int(group[x]), int(group[y])))

        for m in np.unique(counts[(counts > 1) & (counts <= SMALL)]).tolist():  # all pairs of the cells of m rows
            a, b = np.triu_indices(m, 1)
            starts = new[counts == m]
            for k in range(0, len(starts), step := max(1, (1 << 16) // len(a))):
                some = starts[k : k + step, None]
                keep((some + a).ravel(), (some + b).ravel())
        for start, m in zip(new[counts > SMALL].tolist(), counts[counts > SMALL].tolist()):
            cell = np.arange(start, start + m)
            for x in cell[:-1].tolist():
                if low[x]:
                    stop = start + int(np.searchsorted(sizes[start : start + m], sizes[x] * 100 // percent, "right"))
                    b = np.arange(x + 1, stop)
                    b = b[(labels[b] != labels[x]) & (own[b] | own[x]) & (probe[b] | probe[x])]
                    if len(b):
                        keep(np.full(len(b), x), b)
        return _edges(out)

    return run


def _exact(width: int, percent: int):
    """Links of a cell of a cluster: pairs that reach the threshold, as a spanning forest over the groups so far."""

    def run(t: pa.Table) -> pa.Table:  # at most two blocks of a cell
        shingler = Shingler(width)
        wanted, nodes, labels, probe = (t[c].to_pylist() for c in ("fp", "node", "label", "probe"))
        held: dict[int, tuple] = {}
        for k, text in enumerate(t["text"].to_pylist()):
            s = shingler(text)
            if fingerprint(s) == wanted[k]:  # else another row of the same doc_id
                was = held.get(nodes[k])
                held[nodes[k]] = (s, labels[k], probe[k] or bool(was and was[2]))
        rows = sorted(((len(s), node, label, p, s) for node, (s, label, p) in held.items()), key=lambda r: r[:2])
        if len(rows) < 2:
            return _edges([])
        sizes = np.array([r[0] for r in rows])
        bits = signature_bits(int(np.median(sizes)))
        signs = np.stack([bitmap(r[4], bits) for r in rows])
        probes = np.array([r[3] for r in rows])
        place = {label: k for k, label in enumerate(dict.fromkeys(r[2] for r in rows))}
        group, forest, out = [place[r[2]] for r in rows], Forest(len(place)), []
        for i in range(len(rows)):
            near = _may_reach(sizes, signs, i, percent)
            for j in near[probes[near] | probes[i]].tolist():
                if forest.find(group[i]) != forest.find(group[j]):
                    both = len(np.intersect1d(rows[i][4], rows[j][4], assume_unique=True))
                    if 100 * both >= percent * (rows[i][0] + rows[j][0] - both):
                        forest.join(group[i], group[j])
                        out.append((rows[i][1], rows[j][1]))
        return _edges(out)

    return run


def _cells(rows: DataFrame, size: Column, minor: Column, cell: int) -> DataFrame:
    """Deal groups to cells (``i``, ``j``) so that each pair with a minor member meets in one.

    ``size`` and ``minor`` count a group's members and its minor ones. Minor members stand in blocks of their own and
    alone are probes; the others are met by every block of minor ones.
    """
    spread = F.xxhash64("node", F.lit(7))
    blocks, others = F.ceil(minor / cell).cast("int"), F.ceil((size - minor) / cell).cast("int")
    mine = F.when(F.col("minor"), F.pmod(spread, F.greatest(blocks, F.lit(1)))).otherwise(F.pmod(spread, F.greatest(others, F.lit(1)))).cast("int")
    rows = rows.withColumns({"mine": mine, "blocks": blocks, "others": others})
    met = F.when(
        F.col("minor"),
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")),
            ),
            F.when(
                F.col("others") > 0,
                F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(F.col("mine").alias("i"), (-1 - k).alias("j"))),
            ).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
        ),
    ).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("mine")).alias("j")))
    )
    return rows.where(F.col("blocks") > 0).withColumn("met", F.explode(met)).select("*", "met.i", "met.j", F.col("minor").alias("probe")).drop("met", "mine")


def _tile_edges(signed: DataFrame, ids: DataFrame, labels: DataFrame, percent: int, cell: int) -> DataFrame:
    nodes = ids.select("node").join(labels.select("node", F.col("label").alias("star")), "node", "left").select("node", F.coalesce("star", "node").alias("label"))
    named = signed.select(F.col("id").alias("node"), "n", "lows", "keys").join(nodes, "node")
    keys = named.select("node", "label", "n", "lows", F.posexplode("keys").alias("at", "key"))
    keys = keys.select("key", "node", "label", (2 * F.col("n") + (F.col("at") < F.col("lows")).cast("long")).alias("sized"))  # n and whether the key is low, in one number
    of = Window.partitionBy("key")  # one shuffle of the keys; the rows of a common key go to disk if they are many
    seen = keys.withColumns({"least": F.min("label").over(of), "most": F.max("label").over(of), "lows": F.max(F.col("sized") % 2).over(of)})
    placed = settle(seen.where("least <> most AND lows = 1").select("key", "node", "label", "sized"), "tile-members")

    # A pair may span two neighbouring bands: a class stands in its own band and, for those one band up, in the next, where it is the smaller.
    low, n = F.col("sized") % 2 == 1, F.floor(F.col("sized") / 2)
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    placed = placed.select("key", "node", "label", n.alias("n"), low.alias("low"), F.posexplode(F.when(low, F.array(band, band + 1)).otherwise(F.array(band))).alias("up", "band"))
    placed = placed.withColumn("own", F.col("up") == 0).drop("up")
    by_label = placed.groupBy("key", "band", "label").agg(F.count("*").alias("count"), F.max("low").alias("low"), F.max("own").alias("own"))
    tiles = by_label.groupBy("key", "band").agg(
        F.sum("count").alias("size"), F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels"), F.max("low").alias("low"), F.max("own").alias("own")
    ).where("labels > 1 AND low AND own")
    tiles = settle(tiles.select("key", "band", "size", "most"), "tiles")
    large = F.col("size") > cell
    rows = placed.join(tiles, ["key", "band"]).withColumn("minor", ~large | (F.col("label") != F.col("most.label")))
    minor = F.when(large, F.col("size") - F.col("most.count")).otherwise(F.col("size"))
    rows = _cells(rows, F.col("size"), minor, cell).select("key", "band", "i", "j", "node", "label", "n", "low", "own", "probe")
    rows = rows.join(signed.select(F.col("id").alias("node"), "bits"), "node")
    blocks = F.ceil(minor / cell)
    dealt = tiles.agg(F.sum(F.when(large, minor * (blocks + F.ceil((F.col("size") - minor) / cell)) + (F.col("size") - minor) * blocks).otherwise(F.col("size")))).first()[0]
    deals = F.pmod(F.xxhash64("key", "band", "i", "j"), F.lit(int(dealt or 0) // DEAL + 1))
    return rows.groupBy(deals.alias("deal")).applyInArrow(_tiles(percent), "a long, b long").distinct()


def _links(docs: DataFrame, ids: DataFrame, clusters: DataFrame, width: int, percent: int, cell: int) -> DataFrame:
    """Links between classes of one cluster, enough of them to connect all that are connected."""
    members = clusters.withColumnRenamed("label", "cluster")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    members = members.join(sizes, "cluster").join(ids, "node")
    members = settle(members.select("cluster", "size", "node", "first", "fp", "n_docs"), "clustered-classes")
    texts = docs.select(F.col("doc_id").alias("of"), "text")
    texts = texts.join(*may_hold(held_bits(members, "first"), "of"), "left_semi")
    members = settle(members.join(texts, F.expr("first <=> of")).drop("of"), "cluster-members")
    exact = _exact(width, percent)
    spread = F.xxhash64("node", F.lit(11))
    blocks = F.ceil(F.col("size") / cell).cast("int")
    own = members.select("cluster", "node", "fp", "text", F.col("node").alias("label"), F.lit(True).alias("probe"), F.pmod(spread, blocks).cast("int").alias("i"))
    hub = members.where(F.col("size") > cell).groupBy("cluster", F.pmod(spread, F.lit(HUBS)).alias("h")).agg(
        F.min(F.struct((-F.col("n_docs")).alias("n"), spread.alias("s"), "node")).alias("hub")
    )
    hubs = members.join(hub.select(F.col("hub.node").alias("node")), "node").select(
        "cluster", "node", "fp", "text", F.col("node").alias("label"), F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i")
    )
    links = settle(own.unionByName(hubs).groupBy("cluster", "i").applyInArrow(exact, "a long, b long"), "links")
    if members.where(F.col("size") > cell).isEmpty():
        return links

    found = components(links)
    rows = members.where(F.col("size") > cell).join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = settle(rows, "large-clusters")
    most = rows.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("most"))
    rows = rows.join(settle(most, "largest-groups"), "cluster").withColumn("minor", F.col("label") != F.col("most.label"))
    rows = _cells(rows, F.col("size"), F.col("size") - F.col("most.count"), cell)
    rest = rows.select("cluster", "i", "j", "node", "fp", "text", "label", "probe").groupBy("cluster", "i", "j").applyInArrow(exact, "a long, b long")
    return links.unionByName(rest)


def near_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id",
    cell: int = CELL, sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, class_id (least doc_id with an equal set)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("string").alias("row"))
    return _groups(docs, width, percent, cell, sketch_bits).select("doc_id", "n_shingles", "component_id", "class_id")


def _groups(docs: DataFrame, width: int, percent: int, cell: int = CELL, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The columns of ``near_groups`` with row, as given, and label, a number that only one group has; null for no shingles."""
    sketch = _sketch(docs, width, sketch_bits)
    signed = settle(_signatures(docs, width, percent, sketch, sketch_bits).withColumn("id", F.monotonically_increasing_id()), "signatures")

    # A class goes by the least of its rows, whose keys and bitmap stand for it: equal sets have equal ones.
    ids = signed.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs"), F.min("id").alias("node"))
    ids = settle(ids, "classes")

    stars = settle(signed.select(F.col("id").alias("node"), "stars").join(ids.select("node"), "node").select("node", F.posexplode("stars").alias("k", "star")), "class-stars")
    centre = settle(stars.groupBy("k", "star").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b <> c"), "stars")
    star_edges = stars.join(centre, ["k", "star"]).where("node <> b").select(F.col("node").alias("a"), "b")
    near = components(star_edges)
    tied = near.select(F.col("node").alias("a"), F.col("label").alias("b"))
    clusters = components(tied.unionByName(settle(_tile_edges(signed, ids, near, percent, cell), "tile-edges")))
    groups = components(_links(docs, ids, clusters, width, percent, cell))

    classes = ids.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = settle(classes.groupBy("label").agg(F.min("first").alias("component_id")), "names")
    classes = settle(classes.join(names, "label").select("fp", F.col("first").alias("class_id"), "component_id", "label"), "named-classes")
    linked = signed.where("n > 0").join(classes, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "row", "label")
    alone = signed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), "row", F.lit(None).cast("long").alias("label"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the input without those that another row of their group stands for: that of least doc_id, and of several
    texts of this id that of least key; of rows that repeat id and text one stays. Rows without a doc_id or without
    shingles stay; input columns are kept as they are."""
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(F.col(doc_id).cast("long"), F.col(text)))
    groups = _groups(keyed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(key).alias("row")), width, percent)
    rows = groups.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("label", "doc_id", "row").agg(F.count("*").alias("times"))
    rows = settle(rows, "group-rows")
    kept = rows.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("kept"))
    judged = settle(rows.join(kept, "label").select(F.col("row").alias(key), (F.col("row") != F.col("kept.row")).alias("gone"), "times"), "judged-rows")
    gone, repeated = judged.where("gone").select(key), judged.where("NOT gone AND times > 1").select(key)
    held = may_hold(held_bits(judged.where("gone OR times > 1").select(key), key), key)  # the other rows stay without a shuffle
    some = keyed.join(*held, "left_semi").join(gone, key, "left_anti")
    if not repeated.isEmpty():
        some = some.join(repeated, key, "left_anti").unionByName(some.join(repeated, key, "left_semi").dropDuplicates([key]))
    return keyed.join(*held, "left_anti").unionByName(some).select(docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM d),
u AS (SELECT doc_id, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * c >= 90 * (len(sx.g) + len(sy.g) - c)),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
SELECT s.doc_id, len(s.g) AS n_shingles, min(r.o) AS component_id FROM s JOIN r USING (doc_id) GROUP BY ALL
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {"op3_jaccard_join": ORACLE}
