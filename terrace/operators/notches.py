"""Notches: stretches where two units' edges run beside each other without meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.boxes import range_join
from terrace.functions.kernel import dumped, register, st, union_by, with_box
from terrace.operators.graph import _kept

# Fixed values, in degrees: how near edges count, the spacing that a score counts in, the least score, the share of the longest edge that an end may lie off, the margin around pieces, and what counts as no distance.
NEAR, SPACING, LEAST_SCORE, END_SHARE, MARGIN, NOTHING, NO_LENGTH = 2.5e-5, 2e-4, 2.0, 0.1, 3e-4, 1e-9, 1e-12


def open_segments(layer: DataFrame) -> DataFrame:
    """(fid, geom, box) of boundary segments that one unit has alone, whichever way they run."""
    register(layer.sparkSession)
    s = with_box(layer.select("fid", F.explode(st("segments", "geom")).alias("geom")))
    start, end = st("startpoint", "geom"), st("endpoint", "geom")
    s = s.withColumn("key", F.array_sort(F.array(start, end)))
    own = s.groupBy("key").agg(F.count_distinct("fid").alias("n")).where("n = 1").select("key")
    return s.join(own, "key", "left_semi").drop("key")


def detect_notches(layer: DataFrame) -> DataFrame:
    """(n, unit_a, unit_b, score, geom): pairs of units whose open edges run within NEAR of each other without touching, in pieces joined where they lie close.

    score: the pieces' length in spacings, at least LEAST_SCORE; some piece's end must lie off the other edge, by more than nothing and at most END_SHARE of the longest edge.
    Numbered by units, then place.
    """
    segments = _kept(open_segments(layer).withColumn("seg", F.monotonically_increasing_id()))
    met = range_join(segments, segments, NEAR).where("a.fid <> b.fid")
    piece = st("intersection", F.col("a.geom"), st("buffer", F.col("b.geom"), NEAR))
    touching = st("length", st("collectionextract", st("intersection", F.col("a.geom"), F.col("b.geom")), 1))
    off = F.greatest(*(st("distance", st(end, F.col("a.geom")), F.col("b.geom")) for end in ("startpoint", "endpoint")))
    longest = F.greatest(st("length", F.col("a.geom")), st("length", F.col("b.geom")))
    pieces = met.select(F.least("a.fid", "b.fid").alias("unit_a"), F.greatest("a.fid", "b.fid").alias("unit_b"), piece.alias("geom"), touching.alias("touching"), off.alias("off"), longest.alias("longest"))
    pieces = pieces.withColumn("length", st("length", "geom") - F.col("touching")).where(F.col("length") > NO_LENGTH)
    pieces = _kept(pieces.withColumn("moved", F.col("off").between(NOTHING, F.col("longest") * END_SHARE)))
    blobs = dumped(union_by(pieces.select("unit_a", "unit_b", st("buffer", "geom", MARGIN).alias("geom")), ["unit_a", "unit_b"]))
    blobs = _kept(with_box(blobs).withColumn("blob", F.monotonically_increasing_id()))
    inside = range_join(with_box(pieces), blobs).where((F.col("a.unit_a") == F.col("b.unit_a")) & (F.col("a.unit_b") == F.col("b.unit_b")) & st("intersects", F.col("a.geom"), F.col("b.geom")))
    scored = inside.groupBy(F.col("b.blob").alias("blob")).agg((F.sum("a.length") / SPACING).alias("score"), F.bool_or("a.moved").alias("moved"))
    rows = blobs.join(scored, "blob").where((F.col("score") >= LEAST_SCORE) & F.col("moved"))
    number = F.row_number().over(Window.orderBy("unit_a", "unit_b", "xmin", "ymin", F.xxhash64("geom")))  # findings, few
    return rows.select(number.alias("n"), "unit_a", "unit_b", "score", "geom")
