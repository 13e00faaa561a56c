"""Operators on small layers with values worked out by hand, as well as all registered queries against their SQL."""

import math
import os

import pytest
from pyspark.sql import functions as F

from terrace.functions import text
from terrace.functions.codes import CodeFormat, detected, parse_min_width
from terrace.functions.hierarchy import Target, canonical_order, chosen, families, free_sibling, further, inserted, is_noise, level_of, levels_of, renames
from terrace.functions.kernel import register, st
from terrace.operators import assign, change, code_create, code_detect, dissolve, name_detect, package, schema_detect, schema_fill, topology
from terrace.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def layer(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_columns_of_hierarchies():
    assert [next(further(c)) for c in ("name", "adm1")] == ["name1", "adm1_1"] and list(zip(further("adm1"), "ab"))[1][0] == "adm1_2"
    assert all(map(is_noise, ("Shape_Le_1", "shape_ar_1", "SHAPE_LENG", "fid_2"))) and not any(map(is_noise, ("shape_x", "category", "shapes_1")))
    assert (level_of("adm2_name1", "adm{n}_name"), level_of("adm2_name_1", "adm{n}_name"), level_of("code2_1", "code{n}"), level_of("code2", "code{n}")) == (2, None, 2, 2)
    assert free_sibling("name", {"name1"}) == "name2"
    assert is_noise("SHAPE_Leng") and is_noise("fid_1") and is_noise("shape__len") and not is_noise("name")
    columns = ["x", "adm1_code", "adm2_code", "adm1_name", "adm2_name", "adm2_name1", "adm2_kind"]
    assert levels_of(columns, Target()) == {1: ("adm1_code", ("adm1_name",)), 2: ("adm2_code", ("adm2_name", "adm2_name1"))}
    assert canonical_order(columns, Target())[0] == ["adm2_name", "adm2_name1", "adm2_kind", "adm2_code", "adm1_name", "adm1_code", "x"]
    assert families(columns, ("adm{n}_name",))["adm{n}_code"] == {1: "adm1_code", 2: "adm2_code"}
    assert renames(["adm1_name"], {"adm{n}_name": "n{n}"}) == {"adm1_name": "n1"}
    assert chosen(["a", "b", "c"], exclude=["b"], always=["b"], never=["c"]) == ["a", "b"]
    assert inserted(["adm1_a", "x"], "new", "adm1_") == ["adm1_a", "new", "x"]
    with pytest.raises(ValueError):
        renames(["adm1_name", "n1"], {"adm{n}_name": "n{n}"})
    with pytest.raises(ValueError):
        levels_of(["adm1_code", "adm3_code", "adm1_name"], Target())
    with pytest.raises(ValueError):
        chosen(["a"], include=["a"], exclude=["a"])


def test_code_formats():
    assert parse_min_width("2,3") == (2, 3) and parse_min_width("auto") == "auto"
    assert detected([(0, "AFG"), (1, "AFG.01"), (2, "AFG.01.003")]) == CodeFormat("AFG", ".", (2, 3))
    assert detected([(0, "AF"), (1, "AF01"), (2, "AF01003")]) == CodeFormat("AF", "", (2, 3))
    with pytest.raises(ValueError):
        detected([(1, "A.1-2")])


def test_numbering_rows(layer):
    none = layer([], "code string, parent_code string")
    rows = layer([("zz",), ("5",), ("5",), ("aa",)], "s string").withColumn("parent_code", F.lit("AFG"))
    got = code_create.continue_codes(rows, ["s"], none, CodeFormat("AFG"), 1).collect()
    assert sorted(r.new_code for r in got) == ["AFG.001", "AFG.002", "AFG.003", "AFG.004"]
    many = layer([(k,) for k in range(1200)], "s int").withColumn("parent_code", F.lit("BRA"))
    codes = {r.new_code for r in code_create.continue_codes(many, ["s"], none, CodeFormat("BRA"), 1).collect()}
    assert {"BRA.001", "BRA.999", "BRA.1000"} <= codes
    old = layer([("AFG.001", "AFG"), ("AFG.005", "AFG"), ("AFG.x", "AFG"), ("AFG.1.9", "AFG")], "code string, parent_code string")
    two = layer([("a",), ("b",)], "s string").withColumn("parent_code", F.lit("AFG"))
    assert sorted(r.new_code for r in code_create.continue_codes(two, ["s"], old, CodeFormat("AFG"), 1).collect()) == ["AFG.006", "AFG.007"]
    with pytest.raises(ValueError):
        code_create.continue_codes(many, ["s"], none, CodeFormat("B", "", 2), 1)


def test_blank_codes_raise(layer):
    with pytest.raises(ValueError):
        code_create.code_create(layer([("A", "a"), (" ", "b")], "adm1_code string, adm1_name string"), CodeFormat("X"))


def test_fill_takes_the_deepest_level(layer):
    rows = layer([("A", "a", "A1", None, None, None), ("B", "b", None, None, None, None)], "adm1_code string, adm1_name string, adm2_code string, adm2_name string, adm3_code string, adm3_name string")
    got = {r.adm1_code: r for r in schema_fill.schema_fill(rows).collect()}
    assert (got["A"].depth, got["A"].adm3_code, got["A"].adm3_name) == (2, "A1", None)
    assert (got["B"].depth, got["B"].adm2_code, got["B"].adm3_name) == (1, "B", "b")
    with pytest.raises(ValueError):
        schema_fill.schema_fill(rows.withColumn("depth", F.lit(1)))


def test_dissolve_rules(layer):
    rows = layer([("P1", 10.0, "x", 1, "s1"), ("P1", 20.0, "y", 1, "s2"), ("P2", 5.0, "x", 1, "s3"), (None, 1.0, "x", 1, "s4")], "g string, population double, status string, version int, bbox string")
    got = {r.g: r for r in dissolve.dissolve(rows, ["g"]).collect()}
    assert got["P1"].population == 30.0 and got["P1"].version == 1 and None in got
    assert set(got["P1"].asDict()) == {"g", "population", "version"}
    assert {r.g: r.population for r in dissolve.dissolve(rows, ["g"], {"population": "max"}).collect()}["P1"] == 20.0


def _boxes(layer, rows):
    return layer(rows, "fid long, code string, xmin double, ymin double, xmax double, ymax double")


def test_change_classes(layer):
    a = _boxes(layer, [(1, "U", 0.0, 0.0, 1.0, 1.0), (2, "M", 2.0, 0.0, 3.0, 1.0), (3, "S", 4.0, 0.0, 6.0, 1.0), (4, "J1", 8.0, 0.0, 9.0, 1.0), (5, "J2", 9.0, 0.0, 10.0, 1.0), (6, "R", 12.0, 0.0, 13.0, 1.0), (7, "N", 20.0, 0.0, 21.0, 1.0), (8, "L", 30.0, 0.0, 31.0, 1.0)])
    b = _boxes(layer, [(1, "U", 0.0, 0.0, 1.0, 1.0), (2, "M", 2.0, 0.0, 2.9, 1.0), (3, "S", 4.0, 0.0, 5.0, 1.0), (4, "S2", 5.0, 0.0, 6.0, 1.0), (5, "J", 8.0, 0.0, 10.0, 1.0), (6, "C", 14.0, 0.0, 15.0, 1.0), (7, "N2", 20.0, 0.0, 21.0, 1.0), (8, "L", 30.9, 0.0, 31.9, 1.0)])
    pairs = assign.coverage_ratios(a, b)
    units, _ = change.classify(a, b, pairs)
    assert {(r.side, r.fid): r.change for r in units.collect()} == {("a", 1): "unchanged", ("b", 1): "unchanged", ("a", 2): "modified", ("b", 2): "modified", ("a", 3): "split", ("b", 3): "split", ("b", 4): "split", ("a", 4): "merge", ("a", 5): "merge", ("b", 5): "merge", ("a", 6): "removed", ("b", 6): "created", ("a", 7): "unchanged", ("b", 7): "unchanged", ("a", 8): "removed", ("b", 8): "created"}
    units, links = change.classify(a, b, pairs, ("code",))
    got = {(r.side, r.fid): r.change for r in units.collect()}
    assert got["a", 8] == "relocated" and got["a", 7] == "renamed" and got["a", 3] == "split"
    log = change.changelog(a, b, units, links, "code").collect()
    assert {(r.change, r.code_a, r.code_b) for r in log} >= {("renamed", "N", "N2"), ("removed", "R", None), ("created", None, "C")}
    looser, _ = change.classify(a, b, pairs, match=0.05)
    assert {(r.side, r.fid): r.change for r in looser.collect()}["a", 8] == "modified"


def test_assignment_prefers_area_then_code(layer):
    inputs = _boxes(layer, [(1, "B", 0.0, 0.0, 1.0, 1.0), (2, "Z", 0.0, 0.0, 1.0, 1.0), (3, "A", 50.0, 50.0, 51.0, 51.0)])
    overlay = _boxes(layer, [(1, "A", -1.0, 0.0, 0.7, 1.0), (2, "B", 0.7, 0.0, 2.0, 1.0)])
    assert {tuple(r) for r in assign.assign_many(inputs, overlay).collect()} == {(1, 1), (2, 1)}
    assert {tuple(r) for r in assign.assign_many(inputs, overlay, ("code", "code")).collect()} == {(1, 2, "code", False), (2, 1, "spatial_fallback", None)}


def test_names(layer):
    assert text.repaired("CafÃ©") == "Café" and text.repaired("Café") is None
    rows = [("A", "Alpha", f"A{k:02}", f"Village {k}") for k in range(20)]
    rows += [("A", "Alpha", "A90", ""), ("A", "Alpha", "A91", "N/A"), ("A", "Alpha", "A92", "CafÃ©"), ("A", "Alpha", "A93", "Two  Spaces"), ("A", "Alpha", "A94", "MОСКВА"), ("A", "Alpha", "A95", "Village 1"), ("A", "Alpha", "A96", "VILLAGE NORTHERN"), ("A", "Alpha", "A97", "Near a97")]
    frame = layer(rows, "adm1_code string, adm1_name string, adm2_code string, adm2_name string")
    found = {(r.kind, r.code_a): r for r in name_detect.name_detect(frame).collect()}
    for kind, code in (("blank-name", "A90"), ("placeholder-name", "A91"), ("encoding-artifact", "A92"), ("whitespace", "A93"), ("mixed-script", "A94"), ("duplicate-name", "A01"), ("case-outlier", "A96"), ("code-in-name", "A97")):
        assert (kind, code) in found, kind
    assert found["encoding-artifact", "A92"].suggested == "Café"
    cleaned = {r.adm2_code: r.adm2_name for r in name_detect.name_clean(frame).collect()}
    assert cleaned["A92"] == "Café" and cleaned["A93"] == "Two Spaces" and cleaned["A90"] == "" and cleaned["A05"] == "Village 5"


def test_codes_and_schema(layer):
    rows = [("A", "a", f"A{k:02}", f"v{k}") for k in range(30)] + [("A", "a", None, "x"), ("A", "a", "B99", "y"), ("B", "b", "A01", "v1"), ("A", "a", "A5", "z")]
    frame = layer(rows, "adm1_code string, adm1_name string, adm2_code string, adm2_name string")
    kinds = {(r.kind, r.code_a) for r in code_detect.code_detect(frame).collect()}
    assert {("blank-code", None), ("prefix-mismatch", "B99"), ("duplicate-code", "A01"), ("format-outlier", "A5")} <= kinds
    assert {(r.kind, r.code) for r in schema_detect.schema_detect(frame).collect()} == {("multiple-parents", "A01")}
    skipped = layer([("a", "b", "n")], "adm1_code string, adm3_code string, adm1_name string")
    assert [r.kind for r in schema_detect.schema_detect(skipped).collect()] == ["level-skipped"]


def test_topology_of_a_broken_layer(spark, layer):
    from terrace.functions.kernel import register, st

    register(spark)
    shapes = layer([(1, "POLYGON((0 0,1 0,1 1,0 1,0 0))"), (2, "POLYGON((0.9 0,2 0,2 1,0.9 1,0.9 0))"), (3, "POLYGON((0 1,2 1,2 2,1.2 2,1.2 1.8,0.8 1.8,0.8 2,0 2,0 1))"), (4, "POLYGON((0 2,2 2,2 3,0 3,0 2))")], "fid long, wkt string").select("fid", st("geomfromtext", "wkt").alias("geom"))
    found = {r.kind: r for r in topology.topo_detect(shapes).collect()}
    assert set(found) == {"gap", "overlap"} and (found["overlap"].unit_a, found["overlap"].unit_b) == (1, 2)
    cleaned = topology.topo_clean(shapes, "all")
    assert topology.topo_detect(cleaned).count() == 0
    assert math.isclose(cleaned.agg(F.sum(st("area", "geom"))).first()[0], 6.0, rel_tol=1e-9)
    assert topology.topo_clean(cleaned).count() == 4


def test_lines_between_touching_units_only(layer):
    from terrace.functions.kernel import st

    boxes = _boxes(layer, [(1, "A1", 0.0, 0.0, 1.0, 1.0), (2, "A2", 1.0, 0.0, 2.0, 1.0), (3, "A3", 2.0, 1.0, 3.0, 2.0)])
    units = boxes.select(F.lit("A").alias("adm1_code"), F.lit("a").alias("adm1_name"), F.col("code").alias("adm2_code"), F.col("code").alias("adm2_name"), "xmin", "ymin", "xmax", "ymax")
    from terrace.functions.kernel import register

    register(boxes.sparkSession)
    units = units.withColumn("geom", st("makeenvelope", "xmin", "ymin", "xmax", "ymax")).drop("xmin", "ymin", "xmax", "ymax")
    lines = package.package_lines(units).collect()
    assert [(r.depth, r.left, r.right) for r in lines if r.right] == [(2, "A1", "A2")]
    assert {r.left for r in lines if not r.right} == {"A1", "A2", "A3"}


def test_layer_files(spark, layer, tmp_path):
    from terrace.functions.kernel import st
    from terrace.sources import io

    from terrace.functions.kernel import register

    register(spark)
    rows = layer([(7, "POINT(1 2)"), (8, "POINT(3 4)")], "fid long, w string").select("fid", st("geomfromtext", "w").alias("geom"), F.lit("x").alias("v"))
    io.write_layer(rows, str(tmp_path / "a.parquet"))
    back = io.read_layers(spark, [str(tmp_path / "a.parquet")])
    assert sorted(r.fid for r in back.collect()) == [1, 2] and set(back.columns) == {"fid", "v", "geom", "source_file"}
    io.write_layer(rows, str(tmp_path / "a.geojson"))
    assert spark.read.json(str(tmp_path / "a.geojson")).select("geometry.type").distinct().first()[0] == "Point"
    assert io.write_report(rows.drop("geom"), str(tmp_path / "r.csv")) and not io.write_report(rows.drop("geom").limit(0), str(tmp_path / "r.csv"))
    assert not os.path.exists(tmp_path / "r.csv")
    with pytest.raises(ValueError):
        io.write_layer(rows, str(tmp_path / "a.gpkg"))


def _canonical(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["code_create", "units", "code_detect", "schema_fill", "range_self_join", "assign_many", "change_spatial", "components", "topo_overlaps", "package_lines"])
def test_queries_give_what_their_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = registry.queries()[name](spark, SMALL)
    want = con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False, name=None)
    assert _canonical(got.select(*columns).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)) == _canonical(rows)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with tables of one's own, and what a query and its SQL give there."""

    def both(name, **made):
        con = pytest.importorskip("duckdb").connect()
        for t, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
        for t in ("nation", "region", *made):
            if t not in made:
                spark.read.parquet(f"{SMALL}/{t}.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        return sorted(map(tuple, got.select(*columns).collect())), sorted(want.fetchall())

    return both


_CUSTOMER, _SUPPLIER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def test_codes_go_on_after_numbers_wider_than_the_width(tables):
    # 60 old codes, N7-02 to N7-120, so new ones begin at 121
    got, want = tables("code_continue", supplier=([(k, f"S{k:05}", 7, 0.0) for k in range(180)], _SUPPLIER))
    assert got == want and min(x[2] for x in got) == "N7-121"


def test_names_that_repeat_are_numbered_by_key(tables):
    got, _ = tables("code_continue", supplier=([(k, "Same", 7, 0.0) for k in reversed(range(30))], _SUPPLIER))
    assert [x[2] for x in got] == [f"N7-{n}" for n in range(21, 41)]


def test_low_overlap_is_told_by_the_share_that_is_reported(tables):
    # shares of one half but for the last place
    keys = (78633, 2139, 52695, 15983, 35455)
    got, want = tables("schema_join_issues", customer=([(k, "", 3, 0.0, "") for k in keys], _CUSTOMER))
    assert got == want and not any(kind == "low-overlap" for _, kind in got)


def test_pairs_within_a_layer_are_those_of_brute_force(spark):
    import random

    from terrace.functions.boxes import self_join

    dice = random.Random(7)
    # sides on few values, so that many are equal, some boxes alike, some a line or a point, and one over all
    rows = [(k, x, y, x + dice.choice((0, 1, 2, 9)) / 4, y + dice.choice((0, 1, 3)) / 4) for k in range(300) for x, y in [(dice.randrange(-20, 20) / 4, dice.randrange(-20, 20) / 4)]] + [(300, -9.0, -9.0, 9.0, 9.0), (300, 1.0, 1.0, 2.0, 2.0), (301, None, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "fid long, xmin double, ymin double, xmax double, ymax double")
    met = lambda p, q: p[0] < q[0] and q[3] >= p[1] and q[1] <= p[3] and q[4] >= p[2] and q[2] <= p[4]
    whole = [r for r in rows if None not in r]
    want = sorted((p, q) for p in whole for q in whole if met(p, q))
    for size in (None, 0.3, 20.0):
        assert sorted((tuple(r.a), tuple(r.b)) for r in self_join(boxes, size).collect()) == want
    assert self_join(boxes.where("fid < 0")).count() == 0 and self_join(boxes.where("xmin = xmax and ymin = ymax")).count() == sum(met(p, q) for p in whole for q in whole if p[1] == p[3] and p[2] == p[4] and q[1] == q[3] and q[2] == q[4])


def test_polygons_go_to_the_larger_share_to_the_last_digit(tables):
    # an L's two shares differ by the rounding of its sides alone
    keys = (384803, 407287, 429771, 452255, 777020, 799504)
    got, want = tables("assign_many_polygons", customer=([(k, "", 3, 0.0, "") for k in keys], _CUSTOMER))
    assert got == want


def test_polygons_share_ground_between_meridians(tables, spark):
    # two shares 4.4e-5 apart, which sides straight in a projection put in the other order
    got, want = tables("assign_many_polygons", customer=([(889798, "", 3, 0.0, "")], _CUSTOMER))
    assert got == want == [(889798, 22)]
    register(spark)
    area = lambda *corners: spark.range(1).select(st("area_m2", st("geomfromtext", F.lit(f"POLYGON(({', '.join(f'{x} {y}' for x, y in [*corners, corners[0]])}))")))).first()[0]
    whole, low, high = area((10, 0), (40, 0), (40, 60), (10, 60)), area((10, 0), (40, 0), (40, 60)), area((10, 0), (40, 60), (10, 60))
    assert whole == pytest.approx(2 * area((10, 0), (25, 0), (25, 60), (10, 60)), rel=1e-12) and low + high == pytest.approx(whole, rel=1e-12)
    assert whole == pytest.approx(area((160, 0), (190, 0), (190, 60), (160, 60)), rel=1e-12)
    assert area((-180, -90), (180, -90), (180, 90), (-180, 90)) == pytest.approx(510065621724089, rel=1e-11)
    steps = [(10 + 30 * k / 600, 60 * k / 600) for k in range(601)]
    assert low == pytest.approx(area((40, 0), *reversed(steps)), rel=1e-12)
