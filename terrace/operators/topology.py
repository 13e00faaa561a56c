"""Coverage topology: gaps, overlaps, slivers, invalid edges; and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.boxes import range_join
from terrace.functions.kernel import dumped, register, st, union_by, with_box
from terrace.operators.graph import _kept, connected_components

# Tolerances in degrees, metres for a degree, and the floor of a latitude's cosine.
TOLERANCE, METERS, COS_FLOOR, AUTO, EVERYTHING, THIN = 1e-8, 111_320.0, 0.05, 1.01, 360.0, 0.3


def cos_latitude(y: Column) -> Column:
    return F.greatest(F.cos(F.radians(y)), F.lit(COS_FLOOR))


def pairs(layer: DataFrame, by: float = 0.0) -> DataFrame:
    """(a, b) of rows whose boxes meet, each unordered pair once. layer: fid, geom."""
    boxed = with_box(dumped(layer.select("fid", "geom"))).withColumn("part", F.monotonically_increasing_id())
    boxed = _kept(boxed)
    return range_join(boxed, boxed, by).where("a.part < b.part")


def overlaps(layer: DataFrame) -> DataFrame:
    """(unit_a, unit_b, geom, area): what two units share as area."""
    register(layer.sparkSession)
    met = pairs(layer).where("a.fid <> b.fid").select(F.least("a.fid", "b.fid").alias("unit_a"), F.greatest("a.fid", "b.fid").alias("unit_b"), st("collectionextract", st("intersection", F.col("a.geom"), F.col("b.geom")), 2).alias("geom"))
    shared = union_by(met.where(st("area", "geom") > 0), ["unit_a", "unit_b"])
    return shared.withColumn("area", st("area", "geom"))


def gaps(layer: DataFrame, min_width: float = 0.0) -> DataFrame:
    """(geom, area, width, thinness): holes of the whole layer wider than min_width; width is twice the inscribed circle's radius, thinness 4 pi A / P^2.

    Units are united by connected groups of touching boxes, as a hole never lies between groups.
    """
    register(layer.sparkSession)
    whole = union_by(clusters(layer).select("cluster", "geom"), ["cluster"])
    holes = with_box(whole.select(F.explode(st("holes", "geom")).alias("geom"))).withColumn("hole", F.monotonically_increasing_id())
    holes = _kept(holes)
    # units of another group inside a hole fill it
    filling = range_join(holes, with_box(dumped(layer.select("fid", "geom")))).where(st("intersects", F.col("a.geom"), F.col("b.geom")))
    filling = union_by(filling.select(F.col("a.hole").alias("hole"), F.col("b.geom").alias("geom")), ["hole"]).withColumnRenamed("geom", "filled")
    holes = dumped(holes.join(filling, "hole", "left").select(F.when(F.col("filled").isNull(), F.col("geom")).otherwise(st("difference", "geom", "filled")).alias("geom")))
    holes = holes.select(st("collectionextract", "geom", 2).alias("geom")).where(~st("isempty", "geom"))
    holes = holes.withColumns({"area": st("area", "geom"), "width": 2 * st("inscribed_radius", "geom")})
    return holes.where(F.col("width") > min_width).withColumn("thinness", 4 * F.pi() * F.col("area") / F.pow(st("perimeter", "geom"), 2))


def slivers(layer: DataFrame, width: float = TOLERANCE) -> DataFrame:
    """(fid, geom): parts no wider than `width`. The cheap bound 2A <= width * P comes before the inscribed circle."""
    register(layer.sparkSession)
    bound = dumped(layer.select("fid", "geom")).where(2 * st("area", "geom") <= width * st("perimeter", "geom"))
    return bound.where(2 * st("inscribed_radius", "geom") <= width)


def clusters(layer: DataFrame) -> DataFrame:
    """layer with `cluster`: the smallest fid of each connected group of units with meeting boxes."""
    met = pairs(layer, TOLERANCE).select(F.col("a.fid").alias("a"), F.col("b.fid").alias("b"))
    roots = connected_components(layer.select(F.col("fid").cast("long").alias("node")), met.select(F.col("a").cast("long"), F.col("b").cast("long")))
    return layer.join(roots, layer["fid"] == roots["node"]).drop("node").withColumnRenamed("root", "cluster")


def invalid_edges(layer: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(cluster, geom): edges of a connected group that its neighbours don't match; no row for a valid coverage. Gaps aren't seen."""
    register(layer.sparkSession)
    found = dumped(clusters(layer)).groupBy("cluster").agg(st("invalid_edges", F.collect_list("geom"), tolerance).alias("geom"))
    return found.where("geom is not null")


def coverage_clean(layer: DataFrame, gap: float = -1.0, snap: float = TOLERANCE) -> DataFrame:
    """layer with its polygons made a coverage: each connected group is noded, overlaps go to one unit, gaps up to `gap` wide to the unit with the longest edge on them.

    Independent of the rows' order: a group's polygons are taken by content. gap < 0: gaps stay.
    """
    register(layer.sparkSession)
    grouped = clusters(layer.select("fid", "geom")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("geom").alias("h"), "fid", "geom"))).alias("u"))
    cleaned = grouped.select(F.explode(F.arrays_zip(F.col("u.fid").alias("fid"), st("coverage_clean", F.col("u.geom"), float(snap), float(gap)).alias("geom"))).alias("x"))
    cleaned = cleaned.select(F.col("x.fid").alias("fid"), F.col("x.geom").alias("geom")).where(~st("isempty", "geom"))
    return layer.drop("geom").join(cleaned, "fid").select(*layer.columns)


def topo_detect(layer: DataFrame) -> DataFrame:
    """The report of a layer: gaps, overlaps, micro-polygons, with area and width in metres and thinness."""
    register(layer.sparkSession)
    none = F.lit(None)
    g = gaps(layer).select(F.lit("gap").alias("kind"), none.cast("long").alias("unit_a"), none.cast("long").alias("unit_b"), "geom", "width", "thinness")
    o = overlaps(layer).select(F.lit("overlap").alias("kind"), F.col("unit_a").cast("long"), F.col("unit_b").cast("long"), "geom", none.cast("double").alias("width"), none.cast("double").alias("thinness"))
    m = slivers(layer).select(F.lit("micro-polygon").alias("kind"), F.col("fid").cast("long").alias("unit_a"), none.cast("long").alias("unit_b"), "geom", none.cast("double").alias("width"), none.cast("double").alias("thinness"))
    rows = g.unionByName(o).unionByName(m)
    cos = cos_latitude((st("ymin", "geom") + st("ymax", "geom")) / 2)
    rows = rows.withColumns({"area_m2": st("area", "geom") * METERS * METERS * cos, "max_width_m": F.col("width") * METERS, "thinness_ratio": F.col("thinness")})
    by = Window.partitionBy("kind").orderBy(F.desc("area_m2"), F.col("unit_a").asc_nulls_last(), F.xxhash64("geom"))
    key = F.concat_ws("-", "kind", F.row_number().over(by).cast("string"))
    return rows.withColumn("key", key).select("key", "kind", "unit_a", "unit_b", "area_m2", "max_width_m", "thinness_ratio", "geom")


def topo_clean(layer: DataFrame, maximum_gap_width: float | str | None = None, snapping_distance: float = TOLERANCE) -> DataFrame:
    """layer cleaned, or as it is if it has nothing to clean. The width: a number; 'thin', a little over the widest thin gap; 'all'; or None, for gaps below the tolerance only.

    Raises if the result has invalid edges or an area much below the input's.
    """
    found = _kept(gaps(layer))
    if maximum_gap_width == "thin":
        widest = found.where(F.col("thinness") <= THIN).agg(F.max("width")).first()[0]
        width = -1.0 if widest is None else widest * AUTO
    elif maximum_gap_width == "all":
        width = EVERYTHING
    elif maximum_gap_width is None:
        width = TOLERANCE if found.limit(1).count() else -1.0
    else:
        width = float(maximum_gap_width)
    if width < 0 and invalid_edges(layer).isEmpty():
        return layer
    out = _kept(coverage_clean(layer, width, snapping_distance))
    if not invalid_edges(out).isEmpty():
        raise RuntimeError("cleaning left invalid edges")
    before, after = (df.agg(F.sum(st("area", "geom"))).first()[0] or 0.0 for df in (layer, out))
    shared = overlaps(layer).agg(F.sum("area")).first()[0] or 0.0
    if after < before * 0.98 - 3 * shared:
        raise RuntimeError("cleaning lost area")
    return out
