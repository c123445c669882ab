"""Hops from a root over the call graph (G1)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenwatch.session import settle

ROOT = "api-gateway"


def hops_from(edges: DataFrame, root: str = ROOT) -> DataFrame:
    """Least number of calls from ``root`` to each service; unreachable services have null hops.

    Level by level: the newest frontier is joined with the edges and reached services are dropped. Each
    level is landed, so lineage stays flat, and the loop ends with the first empty frontier.
    """
    calls = settle(edges.select("caller", "callee").distinct(), "calls")
    frontier = edges.sparkSession.createDataFrame([(root,)], "service_name STRING").withColumn("hops", F.lit(0))
    reached = frontier
    for hop in itertools.count(1):
        step = (
            calls.join(frontier, calls["caller"] == frontier["service_name"], "left_semi")
            .select(F.col("callee").alias("service_name"))
            .distinct()
            .join(reached, "service_name", "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = settle(step, f"hop-{hop}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    services = calls.select(F.explode(F.array("caller", "callee")).alias("service_name")).distinct()
    return services.join(reached, "service_name", "left")
