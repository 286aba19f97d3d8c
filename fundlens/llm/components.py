"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: every node hands its neighbours the smallest one."""
    both = edges if not larger else edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b): the smallest node of its component.

    Each round is written to the shared folder. The stars only ever lower a node's neighbours, and
    the rounds end when a round changes nothing (count and hash sum of the edges)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = write_table(edges, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = write_table(_stars(_stars(edges, True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v"), F.col("v")).distinct())
