"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_table


def step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a, b) with a > b. Hot nodes: minima are combined before the shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct()


def mark(edges: DataFrame) -> tuple:
    """A number of edges and two order-free sums over them, by which equal tables are told."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum((h % 1_000_003).cast("decimal(38,0)")), F.sum(F.shiftright(h, 20).cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes but roots, for links (a, b); nodes are of any type with an order, roots are the least.

    Links with a null end, and links of a node to itself, join nothing and are left out. Each round's table is deleted behind the next.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = write_table(edges, "edges")
    before = mark(edges)
    while True:
        old, edges = edges, write_table(step(edges), "edges")
        drop_tables(old)
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
