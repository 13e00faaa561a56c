"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder of spark.checkpoint.dir, or to a temporary one where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="terrace-"))
    return df.checkpoint()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node long) and edges (a, b) -> (node, root): the smallest node of each node's component.

    Each round every root takes the smallest root beside it, then labels are followed to their end; edges inside a component
    drop out, so rounds grow with the logarithm of the size.
    """
    labels = _kept(nodes.select("node", F.col("node").alias("root")).distinct())
    open_ = _kept(edges.where("a <> b").select("a", "b").distinct())
    while not open_.isEmpty():
        both = open_.union(open_.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
        while True:  # follow hooks to their ends
            onward = hooks.alias("x").join(hooks.alias("y"), F.col("x.b") == F.col("y.a"), "left").select("x.a", F.coalesce("y.b", "x.b").alias("b"), F.col("y.b").isNotNull().alias("moved"))
            onward = _kept(onward)
            hooks = onward.select("a", "b")
            if onward.where("moved").isEmpty():
                break
        to = hooks.select(F.col("a").alias("from"), F.col("b").alias("to"))
        labels = _kept(labels.join(to, labels["root"] == to["from"], "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = to.select(F.col("from").alias("a"), F.col("to").alias("a2")), to.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        open_ = _kept(open_.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b").distinct())
    return labels
