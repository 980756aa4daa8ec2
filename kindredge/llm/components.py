"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


#: Edges that one partition holds: fewer than this are a single partition, within which no step needs an exchange.
PART = 500_000


def components(links: DataFrame, work: Work, name: str = "cc") -> DataFrame:
    """``links`` (a, b) -> (node, component), component being the smallest node reachable; nodes without links are absent.

    Only minima per node are aggregated (map-side first), so a hub of any size is never gathered in one task. Each round
    is written to the shared folder. Null ends and self-links are ignored.

    The steps always settle, in a number of rounds that grows with the logarithm of the nodes."""
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    edges = work.save(edges, f"{name}-0")
    for i in itertools.count(1):
        edges = edges.coalesce(1) if edges.count() <= PART else edges
        ends = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")
        both = edges.select(ends).select("e.v", "e.u")
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter("v <> u").distinct()
        floor = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(floor, "v").select(F.explode(F.array(
            F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        after = work.save(small.select("e.v", "e.u").filter("v <> u").distinct(), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        edges = after
        # every node points at one root, and no root points further: done
        roots = after.select(F.col("v").alias("u")).distinct()
        if not after.join(roots, "u", "left_semi").head(1):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
