"""Connected components of links, by hooking and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the nodes of a component share
    one root. Each round every node hooks to the least of its neighbours and itself,
    and links are carried over to where their ends hooked; links within one node end.
    Only minima are gathered, so a node of any degree is summed up task by task."""
    links = written(_simple(links), "links")
    labels = written(
        links.select(F.col("a").alias("node"))
        .union(links.select("b"))
        .distinct()
        .withColumn("root", F.col("node")),
        "labels",
    )
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = written(
            both.groupBy(F.col("a").alias("root"))
            .agg(F.min("b").alias("least"))
            .withColumn("to", F.least("root", "least"))
            .select("root", "to"),
            "hooks",
        )
        labels = written(
            labels.join(hooks, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            ),
            "labels",
        )
        left = hooks.select(F.col("root").alias("a"), F.col("to").alias("x"))
        right = hooks.select(F.col("root").alias("b"), F.col("to").alias("y"))
        carried = links.join(left, "a").join(right, "b").select(
            F.col("x").alias("a"), F.col("y").alias("b")
        )
        links = written(_simple(carried), "links")
    return labels


def _simple(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select("a", "b").distinct()
