"""Connected components of an edge table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.runtime import discard, materialize


def components(edges: DataFrame, name: str = "cc", most: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node reachable; nodes without edges are left out.

    Alternates large-star and small-star steps, each a groupBy minimum and a join, until no
    edge changes; the number of rounds grows with the logarithm of the longest path. Each round
    is written to the shared folder, and only a count comes back to the driver. Edges are
    (a, b) of any orderable type; self-loops and repeats are allowed. No edges: an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = materialize(e, name)
    sign = None
    for _ in range(most):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        old, e = e, materialize(small.filter("u <> v").distinct(), name)
        discard(old)
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == tuple(got):
            break
        sign = tuple(got)
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
    out._quillon_path = e._quillon_path  # what discard() deletes
    return out
