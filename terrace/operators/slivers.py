"""Parts that no one keeps: micro-polygons merged into a neighbour, and pieces that clipping cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.boxes import range_join
from terrace.functions.kernel import dumped, register, st, union_by, with_box
from terrace.operators.graph import _kept
from terrace.operators.topology import TOLERANCE

# A detached piece's share of its unit at most, and of its outline that lies on one neighbour at least.
DETACHED_SHARE, CONTACT = 0.01, 10 * TOLERANCE


def merge_micro(layer: DataFrame, width: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(layer, issues): parts no wider than `width` go to the part, of any unit, with which their slightly widened shape shares most area; ties to the lowest fid.

    Parts beside nothing are dropped, and units of which nothing is left. issues: fid, reason (merged or dropped), target.
    """
    register(layer.sparkSession)
    thin = 2 * st("area", "geom") <= width * st("perimeter", "geom")
    parts = with_box(dumped(layer.select("fid", "geom"))).withColumn("part", F.monotonically_increasing_id())
    parts = _kept(parts.withColumn("micro", thin & F.when(thin, 2 * st("inscribed_radius", "geom") <= width).otherwise(False)))
    micro, wide = parts.where("micro"), parts.where("not micro")
    met = range_join(micro, wide, TOLERANCE)
    shared = st("area", st("intersection", st("buffer", F.col("a.geom"), TOLERANCE), F.col("b.geom")))
    best = Window.partitionBy("part").orderBy(F.desc("shared"), "target")
    chosen = met.select(F.col("a.part").alias("part"), F.col("b.fid").alias("target"), shared.alias("shared")).where("shared > 0").withColumn("r", F.row_number().over(best)).where("r = 1").select("part", "target")
    placed = _kept(micro.join(chosen, "part", "left"))
    rows = wide.select("fid", "geom").unionByName(placed.where("target is not null").select(F.col("target").alias("fid"), "geom"))
    out = layer.drop("geom").join(union_by(rows, ["fid"]), "fid").select(*layer.columns)
    issues = placed.select("fid", F.when(F.col("target").isNull(), "dropped").otherwise("merged").alias("reason"), "target")
    return out, issues


def merge_detached(layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layer, issues): of each unit's parts the largest stays; a part of less than DETACHED_SHARE of it goes to the other unit on which the longest stretch of its outline lies.

    issues: fid, reason (merged, too-large, isolated), target. Parts that touch no other unit stay.
    """
    register(layer.sparkSession)
    parts = with_box(dumped(layer.select("fid", "geom"))).withColumns({"part": F.monotonically_increasing_id(), "area": st("area", "geom")})
    parts = _kept(parts)
    by = Window.partitionBy("fid")
    ranked = parts.withColumns({"r": F.row_number().over(by.orderBy(F.desc("area"), "part")), "most": F.max("area").over(by)})
    loose = _kept(ranked.where("r > 1"))
    small = loose.where(F.col("area") < DETACHED_SHARE * F.col("most"))
    met = range_join(small.drop("r", "most"), parts, TOLERANCE).where("a.fid <> b.fid")
    edge = st("length", st("collectionextract", st("intersection", st("boundary", F.col("a.geom")), st("boundary", F.col("b.geom"))), 1))
    contact = met.select(F.col("a.part").alias("part"), F.col("b.fid").alias("target"), edge.alias("edge")).groupBy("part", "target").agg(F.sum("edge").alias("edge")).where(F.col("edge") > CONTACT)
    chosen = contact.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("edge"), "target"))).where("k = 1").select("part", "target")
    placed = _kept(loose.join(chosen, "part", "left"))
    moved = placed.where("target is not null")
    rows = parts.join(moved.select("part"), "part", "left_anti").select("fid", "geom").unionByName(moved.select(F.col("target").alias("fid"), "geom"))
    out = layer.drop("geom").join(union_by(rows, ["fid"]), "fid").select(*layer.columns)
    reason = F.when(F.col("target").isNotNull(), "merged").when(F.col("area") >= DETACHED_SHARE * F.col("most"), "too-large").otherwise("isolated")
    return out, placed.select("fid", reason.alias("reason"), "target")
