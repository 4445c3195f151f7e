"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node of the component.

    Each round makes, around every node, its larger neighbours point to the smallest one (large star), then its smaller
    ones (small star). Rounds grow with the logarithm of the longest chain. Hubs are aggregated or joined by their key: no task
    holds a hub's neighbours in memory, but without adaptive skew splitting one task reads them. Every round is checkpointed;
    only sums reach the driver.
    """
    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = _state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a <> b").distinct()
        now = checkpointed(small)
        if (new := _state(now)) == size:
            roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        size = new
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(xxhash64(a, b, 1) as decimal(20))"))).first())
