"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm._common import cut, discard


def _apart(df: DataFrame, key: str) -> DataFrame:
    """df with its key recomputed, so that a join deals it out anew. A join side that keeps an aggregate's partitions can't be split when a key is hot."""
    return df.withColumn(key, F.col(key) + F.lit(0).cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): for each node with an edge, the smallest node that it can reach.

    Alternates large-star and small-star steps until the edges are stars around each component's smallest node. Every step
    is a minimum by key and a join, so a hub is pre-aggregated and split, never gathered. Loops and nulls are ignored;
    no edges give an empty table. Each round is written to the shared folder; the one before is deleted.
    """
    spark = edges.sparkSession
    now, path = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = _apart(both.groupBy("n").agg(F.min("m").alias("least")), "n")
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.least("n", "least").alias("v")).distinct()
        large, mid = cut(large, "edges")
        least = _apart(large.groupBy("u").agg(F.min("v").alias("least")), "u")
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after, new = cut(small, "edges")
        discard(spark, path, mid)
        now, path = after, new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
