"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenwatch.session import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label: a node of the component, the same for all of its nodes. Nodes without edges are absent.

    A round sends every live node to the one of least hash among itself and its neighbours (hashes, so that no order of the
    nodes makes chains slow, and the same in all rounds, so that a star is done in two), replaces the ends of edges by where they went, and
    drops loops and double edges. Only ends of the edges left are live in the next round: a finished group, however large,
    takes part no more. At the end the rounds are replayed backwards. Each round is about half of the one before, so all
    rounds together are about twice the first. Hot nodes are folded on the map side, and joins stand directly between shuffles, where Spark splits hot keys.
    """
    live = settle(_distinct(edges), "edges")
    moves = []
    while not live.isEmpty():
        moves.append(settle(_moves(live), "moves"))
        to = moves[-1]
        moved = live.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        live = settle(_distinct(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    found = moves.pop().withColumnRenamed("to", "label")
    for to in reversed(moves):
        later = found.select(F.col("node").alias("to"), "label")
        found = settle(to.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "labels")
    return found


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moves(edges: DataFrame) -> DataFrame:
    """node, to: where each end of an edge goes in this round."""

    def ranked(node: Column) -> Column:
        return F.struct(F.xxhash64(node).alias("rank"), node.alias("node"))

    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
    nearest = edges.select(ends.alias("end")).select("end.node", ranked(F.col("end.near")).alias("near")).groupBy("node").agg(F.min("near").alias("near"))
    return nearest.select("node", F.least(ranked(F.col("node")), F.col("near"))["node"].alias("to"))
