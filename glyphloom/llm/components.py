"""Connected components of a table of links, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import Scratch


def components(links: DataFrame, own: Scratch) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for each node of ``links`` (``a``, ``b``: bigint).

    Each round keeps a forest that links nodes to smaller ones; it ends when every node hangs on its root. Only the
    last round's forest stays; the result is one of the caller's tables.
    """
    edges = own.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = (
            both.where("v > u").join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        roots = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        hung = large.join(roots, F.col("u") == F.col("w"))
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            roots.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
        before, edges = edges, own.table(small.distinct(), "edges", F.bit_xor(F.xxhash64("u", "v")).alias("state"))
        own.drop(before)
        if own.seen(edges) == last:
            break
        last = own.seen(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    labels = (
        edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
    labels = own.table(labels, "labels")
    own.drop(edges)
    return labels
