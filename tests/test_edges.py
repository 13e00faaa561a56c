import math

from pyspark.sql import functions as F

from terrace.functions.codes import CodeFormat
from terrace.functions.kernel import register, st
from terrace.operators import edge
from terrace.operators.code_update import code_update_level


def test_codes_of_a_new_version(spark):
    old = spark.createDataFrame([(1, "W.001", "W"), (2, "W.002", "W"), (3, "W.003", "W"), (4, "W.007", "W")], "fid long, code string, parent_code string")
    new = spark.createDataFrame([(10, "W"), (11, "W"), (2, "W"), (13, "V")], "fid long, parent_code string")
    links = spark.createDataFrame([(1, 10, "unchanged"), (2, 11, "modified"), (3, 13, "renamed")], "a_fid long, b_fid long, change string")
    got = {r.fid: (r.code, r.predecessor_code, r.retained) for r in code_update_level(old, new, links, CodeFormat("W"), 1).collect()}
    # fid 11 comes before fid 2, as text
    assert got == {10: ("W.001", "W.001", True), 11: ("W.008", "W.002", False), 2: ("W.009", None, False), 13: ("V.003", "W.003", True)}


def _boxes(spark, rows):
    register(spark)
    return spark.createDataFrame(rows, "fid long, a double, b double, c double, d double").select("fid", st("makeenvelope", "a", "b", "c", "d").alias("geom"))


def test_extension_covers_and_keeps(spark):
    units = _boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 2.0, 1.0)])
    lines = edge.outer_lines(units).groupBy("fid").agg(F.sum(st("length", "geom")).alias("n")).collect()
    assert {r.fid: round(r.n, 9) for r in lines} == {1: 3.0, 2: 3.0}
    grown = edge.edge_extend(units, distance=0.1, margin=0.5)
    edge.no_erosion(units, grown)
    areas = {r.fid: r.a for r in grown.select("fid", st("area", "geom").alias("a")).collect()}
    assert all(2.0 < a < 3.5 for a in areas.values()) and math.isclose(areas[1], areas[2], rel_tol=0.05)


def test_matching_fits_units_to_their_outline(spark):
    units = _boxes(spark, [(1, 0.1, 0.1, 1.0, 0.9), (2, 1.0, 0.1, 1.9, 0.9), (3, 9.0, 9.0, 9.5, 9.5)])
    overlay = _boxes(spark, [(7, 0.0, 0.0, 2.0, 1.0)])
    got = {r.fid: (r.overlay_fid, r.a) for r in edge.edge_match(units, overlay, "many", distance=0.05, margin=0.3).select("fid", "overlay_fid", st("area", "geom").alias("a")).collect()}
    assert got[3] == (-1, 0.25) and got[1][0] == got[2][0] == 7
    assert math.isclose(got[1][1] + got[2][1], 2.0, rel_tol=1e-6)


def test_notches_between_edges_that_run_apart(spark):
    from terrace.operators.notches import detect_notches

    register(spark)
    rows = [(1, "POLYGON((0 0,0.01 0,0.01 0.004,0.01001 0.005,0.01 0.006,0.01 0.01,0 0.01,0 0))"), (2, "POLYGON((0.01 0,0.02 0,0.02 0.01,0.01 0.01,0.01 0.006,0.01 0.004,0.01 0))"), (3, "POLYGON((0.02 0,0.03 0,0.03 0.01,0.02 0.01,0.02 0))")]
    layer = spark.createDataFrame(rows, "fid long, w string").select("fid", st("geomfromtext", "w").alias("geom"))
    found = detect_notches(layer).collect()
    assert [(r.unit_a, r.unit_b) for r in found] == [(1, 2)] and found[0].score >= 2
    assert detect_notches(layer.where("fid > 1")).count() == 0
