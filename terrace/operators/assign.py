"""Which unit of one layer a unit of another belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.boxes import SIDES, area, range_join, shared_area
from terrace.functions.kernel import dumped, register, st, with_box


def _measured(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[str, str], Column]]:
    """Both layers' parts with their boxes, and what two parts a and b share.

    Polygons (WKB in `geom`) are taken apart, and share square metres of ground; boxes only sort out which parts can meet. Layers of
    boxes alone share their boxes' area. Where one layer has polygons the other's boxes become polygons too.
    """
    if not any("geom" in x.columns for x in (left, right)):
        return left, right, shared_area
    register(left.sparkSession)

    def parts(x: DataFrame) -> DataFrame:
        return with_box(dumped(x.drop(*SIDES)) if "geom" in x.columns else x.withColumn("geom", st("makeenvelope", *SIDES)))

    return parts(left), parts(right), lambda a, b: st("area_m2", st("intersection", f"{a}.geom", f"{b}.geom"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_fid, b_fid, shared_area) over all parts: layers have fid and `geom`, or a box for each part; sums of what parts share, none where that is nothing."""
    left, right, shared = _measured(left, right)
    met = range_join(left, right).withColumn("shared", shared("a", "b")).where("shared > 0")
    return met.groupBy(F.col("a.fid").alias("a_fid"), F.col("b.fid").alias("b_fid")).agg(F.sum("shared").alias("shared_area"))


def _sizes(layer: DataFrame, polygons: bool, name: str) -> DataFrame:
    """(<name>_fid, <name>_area): each unit's area over its parts, in the measure of overlaps()."""
    if polygons:
        register(layer.sparkSession)
        size = st("area_m2", "geom" if "geom" in layer.columns else st("makeenvelope", *SIDES))
    else:
        size = area("u")
    return layer.select("fid", F.struct(*layer.columns).alias("u"), *(["geom"] if "geom" in layer.columns else SIDES)).groupBy(F.col("fid").alias(f"{name}_fid")).agg(F.sum(size).alias(f"{name}_area"))


def assign_many(inputs: DataFrame, overlay: DataFrame, match: tuple[str, str] | None = None) -> DataFrame:
    """Each input's overlay unit: the one it shares most area with, the lowest of equals; inputs that share nothing are left out.

    With `match` columns (input's, overlay's) a unit with the same value that it overlaps wins; assignment_method says 'code' or 'spatial_fallback', and
    spatial_agrees whether area says the same.
    """
    pairs = overlaps(inputs, overlay)
    best = Window.partitionBy("a_fid").orderBy(F.desc("shared_area"), "b_fid")
    spatial = pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("a_fid").alias("input_fid"), F.col("b_fid").alias("spatial_fid"))
    if match is None:
        return spatial.select("input_fid", F.col("spatial_fid").alias("overlay_fid"))
    one, two = match
    keys_a = inputs.select(F.col("fid").alias("a_fid"), F.col(one).alias("ka")).distinct()
    keys_b = overlay.select(F.col("fid").alias("b_fid"), F.col(two).alias("kb")).distinct()
    coded = pairs.join(keys_a, "a_fid").join(keys_b, "b_fid").where("ka = kb").groupBy(F.col("a_fid").alias("input_fid")).agg(F.min("b_fid").alias("code_fid"))
    both = coded.join(spatial, "input_fid", "full")
    return both.select("input_fid", F.coalesce("code_fid", "spatial_fid").alias("overlay_fid"), F.when(F.col("code_fid").isNotNull(), "code").otherwise("spatial_fallback").alias("assignment_method"), (F.col("code_fid") == F.col("spatial_fid")).alias("spatial_agrees"))


def unassigned(inputs: DataFrame, assigned: DataFrame) -> DataFrame:
    return inputs.join(assigned, inputs["fid"] == assigned["input_fid"], "left_anti")


def assign_one(inputs: DataFrame, overlay: DataFrame) -> DataFrame:
    """(source_file, overlay_fid): for each file the overlay unit that most of its units meet, the lowest of equals."""
    inputs, overlay, shared = _measured(inputs, overlay)
    met = range_join(inputs, overlay).where(shared("a", "b") > 0)
    votes = met.groupBy(F.col("a.source_file").alias("source_file"), F.col("b.fid").alias("overlay_fid")).agg(F.count_distinct("a.fid").alias("votes"))
    best = Window.partitionBy("source_file").orderBy(F.desc("votes"), "overlay_fid")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("source_file", "overlay_fid")


def gap_fill(result: DataFrame, overlay: DataFrame) -> DataFrame:
    """result and, for overlay units that nothing was assigned to, their own rows."""
    missing = overlay.join(result, overlay["fid"] == result["overlay_fid"], "left_anti")
    return result.unionByName(missing.withColumn("overlay_fid", F.col("fid")).drop("fid"), allowMissingColumns=True)


def schema_join(layer: DataFrame, other: DataFrame, columns: list[str], min_overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """layer with `columns` of the unit of the other layer that it shares most area with, overlap_share, and findings.

    A column that both have is compared: if it differs anywhere the other's comes beside it under a numbered name. Findings: value-mismatch where both
    are given and differ, low-overlap below min_overlap (the share at the six places that the finding gives), no-overlap.
    """
    from terrace.functions.hierarchy import free_sibling

    pairs = overlaps(layer, other)
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("a_fid").orderBy(F.desc("shared_area"), "b_fid"))).where("r = 1").drop("r")
    theirs = other.select(F.col("fid").alias("b_fid"), *(F.col(c).alias(f"_j_{c}") for c in columns)).dropDuplicates(["b_fid"])
    sizes = _sizes(layer, "geom" in layer.columns or "geom" in other.columns, "a")
    rows = layer.join(best.join(sizes, "a_fid").join(theirs, "b_fid", "left"), layer["fid"] == best["a_fid"], "left").withColumn("overlap_share", F.col("shared_area") / F.nullif("a_area", F.lit(0.0)))
    shared = [c for c in columns if c in layer.columns]
    differs = rows.agg(*(F.bool_or(~F.col(c).eqNullSafe(F.col(f"_j_{c}"))).alias(c) for c in shared)).first() if shared else {}
    names, taken = {}, list(layer.columns)
    for c in columns:
        if c not in layer.columns:
            names[c] = c
        elif differs[c]:
            names[c] = free_sibling(c, taken)
        taken.append(names.get(c, c))
    out = rows.select(*layer.columns, *(F.col(f"_j_{c}").alias(n) for c, n in names.items()), "overlap_share")
    note = lambda where, kind, value: rows.where(where).select("fid", F.lit(kind).alias("kind"), value.cast("string").alias("detail"))
    issues = note(F.col("b_fid").isNull(), "no-overlap", F.lit(None)).unionByName(note(F.round("overlap_share", 6) < min_overlap, "low-overlap", F.round("overlap_share", 6)))
    for c in shared:
        issues = issues.unionByName(note(F.col(c) != F.col(f"_j_{c}"), "value-mismatch", F.lit(c)))
    return out, issues


def coverage_ratios(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_fid, b_fid, shared_area, coverage_a, coverage_b, iou) of two layers' overlapping units."""
    polygons = "geom" in a.columns or "geom" in b.columns
    pairs = overlaps(a, b).join(_sizes(a, polygons, "a"), "a_fid").join(_sizes(b, polygons, "b"), "b_fid")
    s, x, y = F.col("shared_area"), F.col("a_area"), F.col("b_area")
    return pairs.select("a_fid", "b_fid", "shared_area", (s / F.nullif(x, F.lit(0.0))).alias("coverage_a"), (s / F.nullif(y, F.lit(0.0))).alias("coverage_b"), (s / F.nullif(x + y - s, F.lit(0.0))).alias("iou"))
