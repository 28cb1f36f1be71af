"""Connected components by alternating large-star and small-star over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.llm.common import Staging


def components(edges: DataFrame, tables: Staging) -> DataFrame:
    """node, component: every node of ``edges`` (a, b) with the least node that it reaches.

    Each half-round links neighbours to the least node around; it ends when a whole
    round changes nothing.  Only that count comes to the driver.  The least
    neighbour of every node is a table of its own, so that the join of edges with it
    can be split where one node has many neighbours.
    """
    now = tables.put(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = tables.put(both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        tables.drop(least)
        # small star: edges point from the larger to the smaller node
        least = tables.put(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = tables.put(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "small",
        )
        tables.drop(large, least)
        same = small.count() == now.count() and small.exceptAll(now).isEmpty()
        tables.drop(now)
        now = small
        if same:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
