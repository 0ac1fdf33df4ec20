"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialize


#: Links (counted both ways) up to which labels are broadcast, so that a round shuffles once.
BROADCAST_LINKS = 400_000


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach from each node of a link.

    Every round takes the smallest label among a node and its neighbours, then
    that label's own label, so labels travel ever farther; it ends when no
    label changes. Minima are pre-aggregated before the shuffle, so a node
    with very many links costs a row for each task. There are no more labels
    than edges; these are counted, and labels are broadcast only if they are
    few. Links with a null end go. An empty table gives no rows.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    few = edges.count() <= BROADCAST_LINKS
    sent = F.broadcast if few else (lambda df: df)
    keep = (lambda df: materialize(df.coalesce(4), "labels")) if few else (lambda df: materialize(df, "labels"))
    labels = keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = edges.join(sent(known), "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        was = labels.select("node", F.col("label").alias("was"))
        best = near.join(sent(was), "node").select("node", "was", F.least("was", "near").alias("low"))  # every node has an edge
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = keep(best.join(sent(jump), "low").select("node", "was", F.least("low", "far").alias("label")))
        drop(labels)
        labels = new
        if new.where(F.col("label") != F.col("was")).isEmpty():
            drop(edges)
            return labels
