"""Connected components of a link table, as rounds of Spark aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.session import written


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node reachable.

    Large-star and small-star rounds: every node hands its smallest neighbour to its other neighbours, first to the
    larger ones, then to the smaller ones, until each component is one star. Rounds grow with the logarithm of the
    longest chain. The smallest neighbour is an aggregate with map-side combine; the join that hands it on can be
    split for a hot node. Each round is a table in the shared folder, so that a lost executor costs one round at most.
    Links with a null end and links of a node to itself are left out; repeated links count once. No links: no rows.
    """
    u, v = F.col(left), F.col(right)
    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.lit(1).alias("both")).where(
        u.isNotNull() & v.isNotNull() & (u != v)).select("u", "v").distinct()
    links = written(links, "links")
    before = None
    while before != (now := _state(links)):
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = written(small.union(least.select("u", F.col("least").alias("v"))).distinct(), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("all")).first()
    return row["n"], row["all"]
