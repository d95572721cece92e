"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two grouped minima and two joins and is written to the shared folder; the number of rounds grows
with the logarithm of the size of the largest component. The driver sees a count and a checksum a round.

All edges of a node meet its smallest neighbour in one task, as rows of two ids. Dealing the edges of large nodes to
several tasks took four written tables a round instead of one, and more driver memory than the check allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; root is the smallest."""
    with scratch(edges.sparkSession):
        found = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
        found = written(found, "edges")
        mark = _mark(found)
        for _ in range(max_rounds):
            if not mark[0]:
                break
            both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            found = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
            now = _mark(found)
            if now == mark:
                break
            mark = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        return written(found.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots", keep=True)
