"""Groups of linked records: union by stars, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import spread_join, stage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), ``root`` being the smallest node linked to it in any way.

    Each round links every node's larger neighbours to its smallest one, then the smaller ones; the rounds needed
    grow with the logarithm of the longest chain. The links of a hub are joined in parts.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        both = stage(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = spread_join(both.where("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stage(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = spread_join(large, low, ["a"]).select(F.greatest("b", "low").alias("a"), F.col("low").alias("b")).where("a <> b")
        after = stage(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        if _settled(now, after):
            break
        now = after
    else:
        raise RuntimeError("links did not settle")
    roots = after.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _settled(one: DataFrame, two: DataFrame) -> bool:
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first())

    return mark(one) == mark(two)
