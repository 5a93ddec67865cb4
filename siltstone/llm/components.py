"""Connected components of a link table, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b), longs; root is the smallest node of the component.

    Each round every node takes its smallest neighbour or itself, jumps once along the new pointers, and the links are
    contracted to their roots. A round's tables are written in the shared folder. Self-links and nulls are ignored; an empty
    table gives no rows.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        far = near.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        step = written(near.join(far, "up").select(F.col("a").alias("from"), F.col("upper").alias("to")), "step")
        moved = (
            links.join(step.select(F.col("from").alias("a"), F.col("to").alias("ra")), "a")
            .join(step.select(F.col("from").alias("b"), F.col("to").alias("rb")), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        )
        if nodes is None:
            grown = step.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            grown = nodes.join(step, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        new_nodes = written(grown, "roots")
        new_links = written(moved.where("a <> b").distinct(), "links")
        drop_written(links.sparkSession, *[x for x in (links, nodes, step) if x is not None])
        nodes, links = new_nodes, new_links
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes
