"""Hard-negative mining: exact inner-product search with lists shared by clusters of anchors.

Anchors are clustered by direction. For a cluster of anchors within an angle b of its centre, a candidate of length |x| at the angle t
from the centre has an inner product of at most |u| |x| cos(max(0, t - b)) with any member u. The candidates are sorted by
|x| cos(max(0, t - b)) once for the cluster, and every member walks that list, in steps that double, until no later
candidate can change its result: the bound of the next one is below its last wanted score.

Anchors are dealt to blocks of whole clusters (a cluster larger than a block is cut), candidates to chunks by a hash; a
task holds one block and one chunk, each of bounded size, and walks the chunk's list for every cluster of its block. The best of each chunk are merged
by a ranking that Spark limits before the shuffle. A first pass finds the positives, whose scores set the windows of the second.
All scores are integers and exact; only the certificate is floating-point, with a margin above its error.

Cluster centres are fitted on at most ``SAMPLE`` anchors, those of least hash; they decide how far lists are walked, never the result.

Defined cases: rows with a null label, id, vector or component, or a component that is not finite or of 2**18 and more in
size, take no part; a vector only meets others of its length; an empty vector has the score 0 with every other; rows that repeat an id are rows of
their own, each an anchor, a positive and a negative, and of such rows with equal scores the order is by row; a window of a negative positive score is empty; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.session import settle

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive score between which a negative's lies
CHUNK, ANCHORS = 8192, 2048
SAMPLE, MEMBERS, CLUSTERS, PASSES = 8192, 32, 256, 8
LARGEST = 2**18
STEP = 256
ANGLE_ERROR = 1e-7


def _grid(vectors: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """Rows that take part: row, id, label, v (integer components), dim."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    return settle(rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def fit_centres(sample: np.ndarray, members: int = MEMBERS, most: int = CLUSTERS, passes: int = PASSES) -> np.ndarray:
    """Spherical k-means over the rows of a sample, which must not be empty."""
    unit = _unit(sample)
    centres = unit[: max(1, min(most, math.ceil(len(unit) / members)))].copy()
    for _ in range(passes):
        near = (unit @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = _unit(unit[near == k].sum(0, keepdims=True))[0]
    return centres


def _clustered(anchors: DataFrame, block: int, chunks: int) -> DataFrame:
    """Anchors with their cluster and block, one row for each chunk of candidates."""
    picked = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v", "dim").collect()  # at most SAMPLE rows
    dims = [r.dim for r in picked]
    dim = max(set(dims), key=dims.count) if dims else 0
    centres = fit_centres(np.array([r.v for r in picked if r.dim == dim], np.float64)) if dim else np.zeros((1, 0))

    def nearest(batches):
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            near = np.zeros(len(sizes), np.int64)  # vectors of another length stand together
            if dim and (sizes == dim).any():
                near[sizes == dim] = (_matrix(batch.column("v").filter(pa.array(sizes == dim)), dim) @ centres.T).argmax(1)
            yield batch.append_column("cluster", pa.array(near))

    named = settle(anchors.mapInArrow(nearest, f"{', '.join(f'{n} {t}' for n, t in anchors.dtypes)}, cluster long"), "anchor-clusters")
    blocks, at, room = [], 0, block
    for cluster, n in sorted((r.cluster, r["count"]) for r in named.groupBy("cluster").count().collect()):  # at most CLUSTERS rows
        parts = -(-n // block)
        if n > room:
            at, room = at + (room < block), block
        blocks.append((cluster, at, parts))
        at, room = (at, room - n) if parts == 1 else (at + parts, block)
    dealt = named.sparkSession.createDataFrame(blocks, "cluster long, first_block long, parts long")
    placed = named.join(F.broadcast(dealt), "cluster").withColumn("block", F.col("first_block") + F.pmod(F.xxhash64("row"), "parts"))
    return placed.drop("first_block", "parts").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), at + 1


class Best:
    """The best few candidates of one list so far, by score, then id, then row."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids, self.rows = most, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.most else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        good = scores >= self.least()
        scores, ids, rows = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -scores))[: self.most]
        self.scores, self.ids, self.rows = scores[order], ids[order], rows[order]


class PositiveWalk:
    """An anchor's best other rows of its label."""

    def __init__(self, anchor: dict, most: int):
        self.row, self.label, self.lists = anchor["row"], anchor["label"], [Best(most)]

    def take(self, scores, ids, rows, labels) -> None:
        fit = (labels == self.label) & (rows != self.row)
        self.lists[0].add(scores[fit], ids[fit], rows[fit])

    def ended(self, bound: float) -> bool:
        return bound < self.lists[0].least()


class NegativeWalk:
    """For each positive of an anchor the best rows of other labels whose score lies in the positive's window."""

    def __init__(self, anchor: dict, most: int, low: int, high: int):
        self.label, self.lists = anchor["label"], [Best(most) for _ in anchor["positives"]]
        self.windows = [(low * p["score"] / 100, low * p["score"], high * p["score"]) for p in anchor["positives"]]

    def take(self, scores, ids, rows, labels) -> None:
        other = labels != self.label
        scores, ids, rows = scores[other], ids[other], rows[other]
        for best, (_, low, high) in zip(self.lists, self.windows):
            fit = (100 * scores >= low) & (100 * scores <= high)
            best.add(scores[fit], ids[fit], rows[fit])

    def ended(self, bound: float) -> bool:
        return all(bound < max(best.least(), low) for best, (low, _, _) in zip(self.lists, self.windows))


def shared_list(centre: np.ndarray, spread: float, candidates: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by their bound for a cluster, highest first, and those bounds for anchors of length 1."""
    cosine = np.divide(candidates @ centre, lengths, out=np.zeros(len(lengths)), where=lengths > 0)
    bounds = lengths * np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - spread))
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


def walk_cluster(anchors: np.ndarray, walks: list, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> int:
    """Walk the cluster's list with every member; the number of scores worked out."""
    lengths, own = np.sqrt((candidates**2).sum(1)), np.sqrt((anchors**2).sum(1))
    unit = _unit(anchors)
    centre = _unit(unit.sum(0, keepdims=True))[0]
    spread = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + ANGLE_ERROR
    order, bounds = shared_list(centre, spread, candidates, lengths)
    # Sums below 2**53 are exact in floating point; beyond, integers are used.
    exact = anchors.shape[1] * np.abs(anchors).max(initial=0) * np.abs(candidates).max(initial=0) < 2**53
    active, at, step, scored = list(range(len(walks))), 0, STEP, 0
    while active and at < len(order):
        part = order[at : at + step]
        if exact:
            scores = anchors[active] @ candidates[part].T
        else:
            scores = anchors[active].astype(np.int64) @ candidates[part].T.astype(np.int64)
        scored += scores.size
        for k, i in enumerate(active):
            walks[i].take(scores[k], ids[part], rows[part], labels[part])
        at, step = at + step, step * 2
        if at < len(order):
            most = bounds[at] * own * (1 + 1e-9) + 1e-6
            active = [i for i in active if not walks[i].ended(most[i])]
    return scored


def _cell(make: Callable[[dict], object]):
    """Results of the anchors of one block among the candidates of one chunk."""

    def run(t: pa.Table) -> pa.Table:  # at most about CHUNK + ANCHORS rows
        is_anchor, dim = t["anchor"].to_numpy(zero_copy_only=False), t["dim"][0].as_py()
        mine, others = t.filter(pa.array(is_anchor)), t.filter(pa.array(~is_anchor))
        out: dict[str, list] = {"row": [], "positive": [], "id": [], "of": [], "score": []}
        if mine.num_rows and others.num_rows:
            anchors, candidates = _matrix(mine["v"], dim), _matrix(others["v"], dim)
            ids, rows, labels = (others[c].to_numpy() for c in ("id", "row", "label"))
            clusters = mine["cluster"].to_numpy()
            fields = mine.select(["row", "label", "positives"]).to_pylist()
            for cluster in np.unique(clusters):
                at = np.flatnonzero(clusters == cluster)
                walks = [make(fields[i]) for i in at]
                walk_cluster(anchors[at], walks, candidates, ids, rows, labels)
                for i, walk in zip(at, walks):
                    for k, best in enumerate(walk.lists):
                        n = len(best.ids)
                        out["row"] += [fields[i]["row"]] * n
                        out["positive"] += [k] * n
                        out["id"] += best.ids.tolist()
                        out["of"] += best.rows.tolist()
                        out["score"] += [int(s) for s in best.scores]
        return pa.table(out, schema=_FOUND)

    return run


_FOUND = pa.schema([(n, pa.int64()) for n in ("row", "positive", "id", "of", "score")])
_POSITIVES = "array<struct<score:bigint,id:bigint>>"


def _search(anchors: DataFrame, candidates: DataFrame, make, most: int) -> DataFrame:
    """row, positive, id, score, rank: the best ``most`` of all chunks."""
    columns = ["dim", "chunk", "block", "anchor", "row", "id", "label", "v", "cluster", "positives"]
    cells = anchors.withColumn("anchor", F.lit(True)).select(columns).unionByName(
        candidates.withColumns({"anchor": F.lit(False), "cluster": F.lit(0).cast("long"), "positives": F.lit(None).cast(_POSITIVES)}).select(columns)
    )
    found = cells.groupBy("dim", "chunk", "block").applyInArrow(_cell(make), "row long, positive long, id long, of long, score long")
    order = Window.partitionBy("row", "positive").orderBy(F.desc("score"), "id", "of")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK, block: int = ANCHORS,
) -> DataFrame:
    """One row for each negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``.
    """
    rows = _grid(vectors, vec_id, label, vector)
    chunks = max(1, -(-rows.count() // chunk))
    anchors, blocks = _clustered(rows.where(is_anchor), block, chunks)
    candidates = rows.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(chunks)).cast("int"))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    first = _search(anchors.withColumn("positives", F.lit(None).cast(_POSITIVES)), candidates, lambda a: PositiveWalk(a, positives), positives)
    held = first.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("ranked"))
    held = settle(held.select("row", F.transform("ranked", lambda p: F.struct(p["score"].alias("score"), p["id"].alias("id"))).alias("positives")), "positives")
    found = _search(anchors.join(held, "row"), candidates, lambda a: NegativeWalk(a, negatives, low, high), negatives)
    names = rows.where(is_anchor).select("row", F.col("id").alias("anchor_id")).join(held, "row")
    positive = F.get("positives", F.col("positive").cast("int"))
    return found.join(names, "row").select(
        "anchor_id", positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label AS own, b.r AS o, b.vec_id AS other_id, b.label, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT r, o, anchor_id, own, other_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, p.o ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s ON s.r = p.r AND s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.r, p.o ORDER BY score DESC, other_id) <= 10
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": ORACLE}
