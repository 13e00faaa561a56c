"""A finest layer as polygons, label points and boundary lines of every level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target, levels_of
from terrace.functions.kernel import dumped, register, st, union_by, with_box
from terrace.operators.dissolve import dissolve
from terrace.operators.graph import _kept
from terrace.functions.boxes import range_join


def package_polygons(layer: DataFrame, fields: Target = Target(), geometry: bool = True) -> dict[int, DataFrame]:
    """{level: its units}: each coarser level is dissolved from the finest, never from another coarse one."""
    levels, out = levels_of(layer.columns, fields), {}
    if geometry:
        register(layer.sparkSession)
    for n in levels:
        if n == max(levels):
            out[n] = layer
            continue
        by = [levels[m][0] for m in levels if m <= n]
        rows = dissolve(layer, by, fields=fields, level=n)
        if geometry:
            shapes = union_by(layer.select(*by, "geom"), by)
            on = reduce(Column.__and__, (rows[c].eqNullSafe(shapes[c]) for c in by))
            rows = rows.join(shapes, on).select(*(rows[c] for c in rows.columns), shapes["geom"])
        out[n] = rows
    return out


def package_points(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """A label point for each unit of each level, `depth` its level: the centre of the largest circle inside."""
    register(layer.sparkSession)
    parts = [df.withColumn("depth", F.lit(n)).withColumn("geom", st("inscribed_center", "geom")) for n, df in package_polygons(layer, fields).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def package_lines(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """(depth, left, right, geom): boundaries that two finest units share, at the coarsest level whose codes differ, and outer boundaries, one level above the coarsest with right null.

    layer: a row for each finest unit. Touching in points makes no line.
    """
    register(layer.sparkSession)
    levels = levels_of(layer.columns, fields)
    codes = [levels[n][0] for n in levels]
    leaf = codes[-1]
    parts = _kept(with_box(dumped(layer.select(*codes, "geom"))))
    met = range_join(parts, parts).where(F.col(f"a.{leaf}") < F.col(f"b.{leaf}"))
    line = st("linemerge", st("collectionextract", st("intersection", st("boundary", F.col("a.geom")), st("boundary", F.col("b.geom"))), 1))
    depth = F.lit(max(levels))
    for n in sorted(levels, reverse=True):
        depth = F.when(~F.col(f"a.{levels[n][0]}").eqNullSafe(F.col(f"b.{levels[n][0]}")), n).otherwise(depth)
    shared = met.select(depth.alias("depth"), F.col(f"a.{leaf}").alias("left"), F.col(f"b.{leaf}").alias("right"), line.alias("geom")).where(~st("isempty", "geom"))
    shared = _kept(shared)
    inner = shared.select(F.explode(F.array("left", "right")).alias("unit"), "geom").groupBy("unit").agg(st("union_array", F.collect_list("geom")).alias("inner"))
    own = layer.groupBy(F.col(leaf).alias("unit")).agg(st("union_array", F.collect_list("geom")).alias("geom"))
    outer = own.join(inner, "unit", "left").select("unit", F.when(F.col("inner").isNull(), st("boundary", "geom")).otherwise(st("difference", st("boundary", "geom"), "inner")).alias("geom"))
    outer = outer.where(~st("isempty", "geom")).select(F.lit(min(levels) - 1).alias("depth"), F.col("unit").alias("left"), F.lit(None).cast("string").alias("right"), st("linemerge", "geom").alias("geom"))
    return shared.unionByName(outer)


def clip(inputs: DataFrame, overlay: DataFrame, vertices: int = 1350) -> DataFrame:
    """inputs (fid, overlay_fid, geom, ...) cut to their overlay unit; those of which no area is left are dropped.

    Heavy overlay units are cut in tiles first, so that neither one task nor one call has a whole large outline.
    """
    register(inputs.sparkSession)
    tiles = overlay.select(F.col("fid").alias("_o"), F.explode(st("subdivide", "geom", vertices)).alias("_tile"))
    pieces = inputs.join(tiles, inputs["overlay_fid"] == tiles["_o"]).select("fid", st("collectionextract", st("intersection", "geom", "_tile"), 2).alias("geom"))
    kept = union_by(pieces.where(~st("isempty", "geom")), ["fid"])
    return inputs.drop("geom").join(kept, "fid").select(*inputs.columns)
