"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import release, written


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood; and the table of those."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its smaller neighbours are linked to the smallest of them; and the table of those."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, as a written table.

    ``links`` has two columns of comparable node ids.  Each round is written
    to the shared folder, and the round before it is released; the rounds end
    when a round changes nothing.  A
    node with all links is never gathered: rows are only joined and reduced,
    and the minima are written first so that a join with a hot node is one
    that Spark can split.
    """
    a, b = links.columns
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = written(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
            release(edges)
            return out
        large, first = _large_star(edges)
        small, second = _small_star(large)
        before, last, edges = now, edges, written(small, "links")
        release(last, first, second)
