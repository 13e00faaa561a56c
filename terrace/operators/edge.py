"""Layers fitted to outlines: extended beyond their edge, cut to an overlay, and stitched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.boxes import range_join
from terrace.functions.kernel import dumped, register, st, union_by, with_box
from terrace.operators.assign import assign_many, assign_one, overlaps
from terrace.operators.graph import _kept
from terrace.operators.package import clip
from terrace.operators.topology import TOLERANCE, clusters, coverage_clean, invalid_edges

# The distance between points in degrees, points on a segment at most, and how often the snapping distance grows.
DISTANCE, SEGMENT_POINTS, TRIES = 2e-4, 100, 10


def outer_lines(layer: DataFrame) -> DataFrame:
    """(fid, geom): each unit's boundary without what its neighbours share, in single lines."""
    register(layer.sparkSession)
    boxed = _kept(with_box(layer.select("fid", "geom")))
    met = range_join(boxed, boxed, TOLERANCE).where("a.fid <> b.fid")
    beside = met.select(F.col("a.fid").alias("fid"), st("boundary", F.col("b.geom")).alias("beside")).groupBy("fid").agg(st("union_array", F.collect_list("beside")).alias("beside"))
    own = layer.select("fid", st("boundary", "geom").alias("geom")).join(beside, "fid", "left")
    line = F.when(F.col("beside").isNull(), F.col("geom")).otherwise(st("collectionextract", st("difference", "geom", "beside"), 1))
    return dumped(own.select("fid", st("linemerge", line).alias("geom")))


def line_points(lines: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """(fid, x, y): points on the lines at most `distance` apart, up to SEGMENT_POINTS on a segment. Interpolated in plain expressions."""
    s = lines.select("fid", F.explode(st("segments", "geom")).alias("s"))
    s = s.select("fid", st("x", st("startpoint", "s")).alias("x0"), st("y", st("startpoint", "s")).alias("y0"), st("x", st("endpoint", "s")).alias("x1"), st("y", st("endpoint", "s")).alias("y1"))
    n = F.least(F.lit(SEGMENT_POINTS), F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / distance))).cast("int")
    s = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", (F.col("k") + 0.5) / F.col("n"))
    return s.select("fid", (F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))).alias("y"))


def edge_extend(layer: DataFrame, distance: float = DISTANCE, margin: float = 0.1) -> DataFrame:
    """layer with its outer units grown outwards: each place up to `margin` away goes to the unit whose edge is nearest.

    Cells around points of the outer edges, of one connected group of units at a time; a cell belongs to its point's unit, less all units there are.
    """
    register(layer.sparkSession)
    grouped = _kept(clusters(layer.select("fid", "geom")))
    points = _kept(line_points(outer_lines(layer), distance).join(grouped.select("fid", "cluster"), "fid"))
    area = union_by(grouped.select("cluster", st("buffer", "geom", float(margin)).alias("geom")), ["cluster"]).withColumnRenamed("geom", "reach")
    cells = points.groupBy("cluster").agg(st("collect_array", F.collect_list(st("point", "x", "y"))).alias("sites")).select("cluster", F.explode(st("voronoi", "sites")).alias("geom"))
    cells = _kept(with_box(cells))
    found = range_join(points.withColumns({"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")}), cells).where((F.col("a.cluster") == F.col("b.cluster")) & st("intersects", F.col("b.geom"), st("point", F.col("a.x"), F.col("a.y"))))
    grown = union_by(found.select(F.col("a.cluster").alias("cluster"), F.col("a.fid").alias("fid"), F.col("b.geom").alias("geom")), ["cluster", "fid"])
    whole = union_by(grouped.select("cluster", "geom"), ["cluster"]).withColumnRenamed("geom", "whole")
    grown = grown.join(area, "cluster").join(whole, "cluster").select("fid", st("difference", st("intersection", "geom", "reach"), "whole").alias("grown"))
    out = layer.join(grown, "fid", "left")
    shape = F.when(F.col("grown").isNull(), F.col("geom")).otherwise(st("union", "geom", "grown"))
    return out.select(*(shape.alias(c) if c == "geom" else F.col(c) for c in layer.columns))


def edge_stitch(layers: list[DataFrame]) -> DataFrame:
    """Layers as one coverage: cleaned with a snapping distance that grows until no invalid edges are left."""
    whole = _kept(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers))
    for k in range(1, TRIES + 1):
        out = _kept(coverage_clean(whole, TOLERANCE, k * TOLERANCE))
        if invalid_edges(out).isEmpty():
            return out
    raise RuntimeError(f"invalid edges are left at a snapping distance of {TRIES * TOLERANCE}")


def edge_match(layer: DataFrame, overlay: DataFrame, how: str = "auto", distance: float = DISTANCE, margin: float = 0.1) -> DataFrame:
    """layer fitted to the overlay: each unit assigned to an overlay unit, extended, cut to it, and the whole stitched; overlay_fid says which.

    how: 'many' assigns each unit by area, 'one' each source_file by most units, 'auto' many where most overlay units are met. Units that meet nothing pass as they are, with overlay_fid -1.
    """
    register(layer.sparkSession)
    a, b = _kept(with_box(layer)), _kept(with_box(overlay))
    if how == "auto":
        met, all_ = overlaps(a, b).select("b_fid").distinct().count(), b.count()
        how = "one" if "source_file" in layer.columns and met * 2 < all_ else "many"
    if how == "many":
        chosen = assign_many(a, b).withColumnRenamed("input_fid", "fid")
    else:
        chosen = layer.select("fid", "source_file").join(assign_one(a, b), "source_file").select("fid", "overlay_fid")
    rows = layer.join(chosen, "fid", "left").withColumn("overlay_fid", F.coalesce("overlay_fid", F.lit(-1)))
    grown = edge_extend(rows.where("overlay_fid >= 0"), distance, margin)
    fitted = clip(grown, overlay.select("fid", "geom"))
    return edge_stitch([fitted, rows.where("overlay_fid < 0")])


def no_erosion(before: DataFrame, after: DataFrame) -> None:
    """Raises if a unit of `after` doesn't cover what it was before."""
    lost = before.select("fid", F.col("geom").alias("old")).join(after.select("fid", "geom"), "fid").where(~st("covers", st("buffer", "geom", TOLERANCE), "old"))
    if n := lost.count():
        raise RuntimeError(f"{n} units lost area")
