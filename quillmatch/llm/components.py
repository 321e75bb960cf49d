"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import Scratch, hot_join


def _toward(edges: DataFrame, small: bool, scratch: Scratch) -> DataFrame:
    """Connect neighbours of each node to the least of its neighbourhood: its larger ones, or (small) itself and its smaller ones."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_rows")).withColumn("m", F.least("u", "m")))
    joined = hot_join(both, least, ["u"], "n_rows")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = scratch.keep(out.where("u != v").distinct())
    scratch.drop(least)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v) of any orderable type, in any direction -> (u, v): each node but the least of its component, with that one."""
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
        large = _toward(now, False, scratch)
        nxt = _toward(large, True, scratch)
        scratch.drop(now, large)
        now = nxt
