import pytest
from pyspark.sql import functions as F

from terrace.__main__ import main
from terrace.functions.kernel import register, st
from terrace.operators import schema_map, slivers


def _units(spark, n=120):
    rows = [("XX", "Land", f"XX{k % 4:02}", f"District {'ABCD'[k % 4]}", f"XX{k % 4:02}{k % 24:03}", f"Commune {chr(65 + k % 24)}", k, float(k)) for k in range(n)]
    return spark.createDataFrame(rows, "iso string, land string, pcode1 string, n1 string, pcode2 string, n2 string, objectid int, area double")


def test_levels_are_found_from_values(spark):
    found = {r.source_column: (r.target_column, r.unique_count) for r in schema_map.schema_map(_units(spark)).collect()}
    assert found == {"land": ("adm0_name", 1), "iso": ("adm0_name1", 1), "pcode1": ("adm1_code", 4), "n1": ("adm1_name", 4), "pcode2": ("adm2_code", 24), "n2": ("adm2_name", 24)} or found["pcode2"][0] == "adm2_code"
    assert found["pcode1"][0] == "adm1_code" and found["n1"][0] == "adm1_name" and found["n2"][0] == "adm2_name"
    layer = _units(spark).drop("objectid", "area")
    renamed = schema_map.mapped(layer, schema_map.schema_map(layer))
    assert {"adm1_code", "adm2_name"} <= set(renamed.columns)


def test_slivers_go_to_the_neighbour_they_touch(spark):
    register(spark)
    box = lambda f, a, b, c, d: (f, a, b, c, d)
    rows = spark.createDataFrame([box(1, 0.0, 0.0, 1.0, 1.0), box(2, 1.0, 0.0, 2.0, 1.0), box(3, 2.0, 0.0, 2.0 + 5e-9, 1.0)], "fid long, a double, b double, c double, d double").select("fid", st("makeenvelope", "a", "b", "c", "d").alias("geom"))
    out, issues = slivers.merge_micro(rows)
    assert sorted(r.fid for r in out.collect()) == [1, 2]
    assert [(r.fid, r.reason, r.target) for r in issues.collect()] == [(3, "merged", 2)]
    two = spark.createDataFrame([(1, "MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((2 0,2.05 0,2.05 0.05,2 0.05,2 0)))"), (2, "POLYGON((2.05 0,3 0,3 1,2.05 1,2.05 0))")], "fid long, w string").select("fid", st("geomfromtext", "w").alias("geom"))
    out, issues = slivers.merge_detached(two)
    assert [(r.fid, r.reason, r.target) for r in issues.collect()] == [(1, "merged", 2)]
    assert {r.fid: round(r.a, 9) for r in out.select("fid", st("area", "geom").alias("a")).collect()} == {1: 1.0, 2: 0.9525}


def test_command_line(spark, tmp_path):
    register(spark)
    layer = _units(spark, 24).selectExpr("pcode1 AS adm1_code", "n1 AS adm1_name", "pcode2 AS adm2_code", "n2 AS adm2_name", "objectid AS k")
    layer.select("*", st("makeenvelope", F.col("k").cast("double"), F.lit(0.0), F.col("k") + 1.0, F.lit(1.0)).alias("geometry")).write.parquet(str(tmp_path / "in.parquet"))
    out = main(["code-create", str(tmp_path / "in.parquet"), "--root-code", "W", "--output", str(tmp_path / "out.parquet")], spark)
    assert {r.adm1_code for r in spark.read.parquet(out).collect()} == {f"W.00{k}" for k in range(1, 5)}
    report = main(["code-detect", str(tmp_path / "in.parquet"), "--output", str(tmp_path / "r.csv")], spark)
    assert report.endswith("r.csv")
    with pytest.raises(SystemExit):
        main(["change", str(tmp_path / "in.parquet")], spark)


def test_areas_are_of_polygons_not_of_boxes(spark):
    from terrace.operators import assign

    register(spark)
    shapes = lambda rows: spark.createDataFrame(rows, "fid long, name string, w string").select("fid", "name", st("geomfromtext", "w").alias("geom"))
    ell = "POLYGON((0 0,10 0,10 1,1 1,1 10,0 10,0 0))"
    layer = shapes([(1, "in the hollow", "POLYGON((4 4,6 4,6 6,4 6,4 4))"), (2, "triangle", "POLYGON((0 0,3 0,0 3,0 0))"), (3, "two parts", "MULTIPOLYGON(((0 8,1 8,1 9,0 9,0 8)),((7 7,8 7,8 8,7 8,7 7)))")])
    other = shapes([(10, "ell", ell), (11, "square", "POLYGON((3 3,9 3,9 9,3 9,3 3))")])
    pairs = {(r.a_fid, r.b_fid): r for r in assign.coverage_ratios(layer, other).collect()}
    assert set(pairs) == {(1, 11), (2, 10), (3, 10), (3, 11)}
    assert abs(pairs[1, 11].coverage_a - 1) < 1e-6 and abs(pairs[2, 10].coverage_a - 8 / 9) < 0.001
    assert abs(pairs[3, 10].coverage_a - 0.5) < 0.01 and abs(pairs[3, 11].coverage_a - 0.5) < 0.01
    # a square degree at the equator
    assert abs(pairs[1, 11].shared_area / 4 - 12.3e9) < 0.1e9
    assert {tuple(r) for r in assign.assign_many(layer, other).where("input_fid < 3").collect()} == {(1, 11), (2, 10)}
    out, issues = assign.schema_join(layer, other, ["name"])
    assert {r.fid: (r.name1, round(r.overlap_share, 1)) for r in out.collect()}[1] == ("square", 1.0)
    assert {r.kind for r in issues.where("fid = 1").collect()} == {"value-mismatch"}
