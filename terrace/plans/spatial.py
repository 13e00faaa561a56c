"""Queries on shapes: geometry functions, topology, packaging and clipping, on boxes and triangles whose measures SQL can give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target
from terrace.functions.kernel import register, st, union_by
from terrace.operators import assign, package, schema_detect, topology, validate
from terrace.plans import layers
from terrace.plans.queries import _PAIRS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = layers.duck(sql)
        return f

    return add


def shaped(df: DataFrame) -> DataFrame:
    """df with geom, the box of its bounds."""
    register(df.sparkSession)
    return df.withColumn("geom", st("makeenvelope", "xmin", "ymin", "xmax", "ymax"))


_AREA = "(xmax - xmin) * (ymax - ymin)"


@query(f"SELECT fid, round({_AREA}, 9) AS area, round(2 * (xmax - xmin + ymax - ymin), 9) AS perimeter, round((xmin + xmax) / 2, 9) AS cx, round((ymin + ymax) / 2, 9) AS cy, round(least(xmax - xmin, ymax - ymin) / 2, 3) AS radius, 5 AS points, xmin, ymax FROM ({layers.CUSTOMER_SQL})")
def st_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = shaped(layers.customer_boxes(spark, sf_dir))
    center = st("centroid", "geom")
    return x.select("fid", F.round(st("area", "geom"), 9).alias("area"), F.round(st("perimeter", "geom"), 9).alias("perimeter"), F.round(st("x", center), 9).alias("cx"), F.round(st("y", center), 9).alias("cy"), F.round(st("inscribed_radius", "geom"), 3).alias("radius"), st("npoints", "geom").alias("points"), st("xmin", "geom").alias("xmin"), st("ymax", "geom").alias("ymax"))


_S = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"


@query(f"""WITH a AS ({layers.CUSTOMER_SQL}), b AS ({layers.NATION_SQL}) SELECT a.fid AS a_fid, b.fid AS b_fid, round({_S}, 9) AS shared,
round((a.xmax - a.xmin) * (a.ymax - a.ymin) - {_S}, 9) AS rest, round((a.xmax - a.xmin) * (a.ymax - a.ymin) + 1 - {_S}, 9) AS together, a.xmin >= b.xmin AND a.xmax <= b.xmax AND a.ymin >= b.ymin AND a.ymax <= b.ymax AS covered
FROM a JOIN b ON least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)""")
def st_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.functions.boxes import range_join

    met = range_join(shaped(layers.customer_boxes(spark, sf_dir)), shaped(layers.nation_boxes(spark, sf_dir)))
    a, b = F.col("a.geom"), F.col("b.geom")
    rows = met.select(F.col("a.fid").alias("a_fid"), F.col("b.fid").alias("b_fid"), st("area", st("intersection", a, b)).alias("shared"), st("area", st("difference", a, b)).alias("rest"), st("area", st("union", a, b)).alias("together"), st("covers", b, a).alias("covered"))
    return rows.where("shared > 0").select("a_fid", "b_fid", *(F.round(c, 9).alias(c) for c in ("shared", "rest", "together")), "covered")


@query(f"""WITH a AS ({layers.OLD_SQL.replace("+ CAST(2.0 AS DOUBLE) AS xmax", "+ CAST(3.25 AS DOUBLE) AS xmax")})
SELECT x.fid AS unit_a, y.fid AS unit_b, round((least(x.xmax, y.xmax) - greatest(x.xmin, y.xmin)) * (least(x.ymax, y.ymax) - greatest(x.ymin, y.ymin)), 9) AS area
FROM a x JOIN a y ON x.fid < y.fid AND least(x.xmax, y.xmax) > greatest(x.xmin, y.xmin) AND least(x.ymax, y.ymax) > greatest(x.ymin, y.ymin)""")
def topo_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = layers.old_boxes(spark, sf_dir).withColumn("xmax", F.col("xmin") + 3.25)
    return topology.overlaps(shaped(wide)).select("unit_a", "unit_b", F.round("area", 9).alias("area"))


#: Nations without every seventh: holes in a grid of squares.
_HOLED = "n_nationkey NOT IN (6, 12, 18)"


@query("SELECT * FROM (VALUES (1.0, 1.0, 0.7854, 1.5, 1.5), (1.0, 1.0, 0.7854, 2.5, 2.5), (1.0, 1.0, 0.7854, 3.5, 3.5)) t(area, width, thinness, cx, cy)".replace("1.0, 1.0, 0.7854", "CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(0.7854 AS DOUBLE)").replace("1.5, 1.5", "CAST(1.5 AS DOUBLE), CAST(1.5 AS DOUBLE)").replace("2.5, 2.5", "CAST(2.5 AS DOUBLE), CAST(2.5 AS DOUBLE)").replace("3.5, 3.5", "CAST(3.5 AS DOUBLE), CAST(3.5 AS DOUBLE)"))
def topo_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology.gaps(shaped(layers.nation_boxes(spark, sf_dir)).where("fid not in (6, 12, 18)"))
    c = st("centroid", "geom")
    return rows.select(F.round("area", 6).alias("area"), F.round("width", 2).alias("width"), F.round("thinness", 4).alias("thinness"), F.round(st("x", c), 6).alias("cx"), F.round(st("y", c), 6).alias("cy"))


@query()
def topo_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = shaped(layers.nation_boxes(spark, sf_dir)).where("fid not in (6, 12, 18)").withColumn("geom", F.expr("CASE WHEN fid = 3 THEN st_makeenvelope(2.9D, 0D, 4D, 1D) ELSE geom END"))
    return topology.topo_detect(holed).drop("geom")


@query(f"WITH n AS ({layers.NATION_SQL}) SELECT count(*) AS units, CAST(25.0 AS DOUBLE) AS area, 0 AS left_over FROM n WHERE fid NOT IN (6, 12, 18)")
def topo_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = topology.topo_clean(shaped(layers.nation_boxes(spark, sf_dir)).where("fid not in (6, 12, 18)"), "all")
    left = topology.topo_detect(cleaned).count()
    return cleaned.agg(F.count("*").alias("units"), F.round(F.sum(st("area", "geom")), 6).alias("area")).withColumn("left_over", F.lit(left))


@query(f"WITH {_PAIRS} SELECT a_fid AS fid, b_fid AS overlay_fid, round(s, 9) AS area FROM best")
def edge_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = layers.customer_boxes(spark, sf_dir), layers.nation_boxes(spark, sf_dir)
    chosen = assign.assign_many(x, n).withColumnRenamed("input_fid", "fid")
    out = package.clip(shaped(x).join(chosen, "fid").select("fid", "overlay_fid", "geom"), shaped(n).select("fid", "geom"))
    return out.select("fid", "overlay_fid", F.round(st("area", "geom"), 9).alias("area"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as units of two levels: a region for each row of the grid."""
    n = shaped(layers.nation_boxes(spark, sf_dir))
    return n.select(F.concat(F.lit("R"), F.col("ymin").cast("int").cast("string")).alias("adm1_code"), F.concat(F.lit("Region "), F.col("ymin").cast("int").cast("string")).alias("adm1_name"), F.concat(F.lit("R"), F.col("ymin").cast("int").cast("string"), F.lpad(F.col("fid").cast("string"), 2, "0")).alias("adm2_code"), F.col("name").alias("adm2_name"), "geom")


_GRID_SQL = f"SELECT 'R' || CAST(CAST(ymin AS INT) AS VARCHAR) AS adm1_code, 'Region ' || CAST(CAST(ymin AS INT) AS VARCHAR) AS adm1_name, 'R' || CAST(CAST(ymin AS INT) AS VARCHAR) || lpad(CAST(fid AS VARCHAR), 2, '0') AS adm2_code, name AS adm2_name, * EXCLUDE (code, name) FROM ({layers.NATION_SQL})"


@query(f"SELECT adm1_code, adm1_name, CAST(count(*) AS DOUBLE) AS area, CAST(2.0 AS DOUBLE) * (count(*) + 1) AS perimeter FROM ({_GRID_SQL}) GROUP BY adm1_code, adm1_name")
def package_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = package.package_polygons(_grid(spark, sf_dir), Target())[1]
    return units.select("adm1_code", "adm1_name", F.round(st("area", "geom"), 6).alias("area"), F.round(st("perimeter", "geom"), 6).alias("perimeter"))


@query(f"SELECT 2 AS depth, adm2_code AS code, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM ({_GRID_SQL})")
def package_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = package.package_points(_grid(spark, sf_dir)).where("depth = 2")
    return points.select("depth", F.col("adm2_code").alias("code"), F.round(st("x", "geom"), 2).alias("x"), F.round(st("y", "geom"), 2).alias("y"))


@query(f"""WITH g AS ({_GRID_SQL}), s AS (SELECT CASE WHEN a.adm1_code <> b.adm1_code THEN 1 ELSE 2 END AS depth, a.adm2_code AS l, b.adm2_code AS r FROM g a JOIN g b ON a.adm2_code < b.adm2_code AND (a.xmax = b.xmin OR a.xmin = b.xmax) AND a.ymin = b.ymin OR a.adm2_code < b.adm2_code AND (a.ymax = b.ymin OR a.ymin = b.ymax) AND a.xmin = b.xmin)
SELECT depth, l AS "left", r AS "right", CAST(1.0 AS DOUBLE) AS length FROM s UNION ALL SELECT 0, adm2_code, NULL, CAST(4.0 AS DOUBLE) - n FROM (SELECT adm2_code, (SELECT count(*) FROM s WHERE l = adm2_code OR r = adm2_code) AS n FROM g) WHERE n < 4""")
def package_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.package_lines(_grid(spark, sf_dir)).select("depth", "left", "right", F.round(st("length", "geom"), 6).alias("length"))


@query(f"SELECT c_nationkey AS nation, round(sum({_AREA}), 6) AS at_most FROM (SELECT *, CAST(substr(code, 2) AS BIGINT) AS c_nationkey FROM ({layers.CUSTOMER_SQL})) GROUP BY c_nationkey")
def union_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions never exceed the sum of areas: the sum is what SQL has, and the query fails if a union is larger."""
    x = shaped(layers.customer_boxes(spark, sf_dir)).withColumn("nation", F.expr("cast(substr(code, 2) as long)"))
    sums = x.groupBy("nation").agg(F.sum(st("area", "geom")).alias("at_most"))
    both = sums.join(union_by(x, ["nation"]), "nation")
    return both.select("nation", F.when(st("area", "geom") <= F.col("at_most") + 1e-9, F.round("at_most", 6)).alias("at_most"))


_FAULTS = f"SELECT key, CASE WHEN key % 50 = 0 THEN 'R9' ELSE adm1_code END AS adm1_code, adm1_name, CASE WHEN key % 77 = 0 THEN NULL ELSE adm2_code END AS adm2_code, adm2_name, adm3_code, adm3_name FROM ({layers.ADMIN_SQL})"


@query(f"""WITH l AS ({_FAULTS}) SELECT 'multiple-parents' AS kind, 2 AS level, adm2_code AS code FROM l WHERE adm2_code IS NOT NULL GROUP BY adm2_code HAVING count(DISTINCT adm1_code) > 1
UNION ALL SELECT 'multiple-parents', 3, adm3_code FROM l WHERE adm2_code IS NOT NULL GROUP BY adm3_code HAVING count(DISTINCT adm2_code) > 1
UNION ALL SELECT DISTINCT 'orphan-child', 3, adm3_code FROM l WHERE adm2_code IS NULL""")
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_detect.schema_findings(layers.admin(spark, sf_dir).selectExpr("key", "CASE WHEN key % 50 = 0 THEN 'R9' ELSE adm1_code END AS adm1_code", "adm1_name", "CASE WHEN key % 77 = 0 THEN NULL ELSE adm2_code END AS adm2_code", "adm2_name", "adm3_code", "adm3_name")).select("kind", "level", "code")


@query()
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(layers.faulty(spark, sf_dir))


_COLUMNS = ["adm1_code", "adm1_name", "adm2_code", "adm2_name", "adm3_code", "adm3_name", "segment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count({c}) AS n_filled, count(*) AS n_rows FROM ({layers.ADMIN_SQL})" for c in _COLUMNS))
def probe_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_detect.distinct_counts(layers.admin(spark, sf_dir), _COLUMNS)


@query(" UNION ALL ".join(f"SELECT 'adm2_code' AS finer, '{c}' AS coarser, count(*) AS groups, CAST(sum(v) AS BIGINT) AS violators, sum(v) = 0 OR sum(v) = 1 AND count(*) > 2 AS holds, count(*) >= 10 AND sum(v) = 0 AS perfect FROM (SELECT CASE WHEN count(DISTINCT {c}) > 1 OR count({c}) < count(*) THEN 1 ELSE 0 END AS v FROM ({layers.ADMIN_SQL}) GROUP BY adm2_code)" for c in ("adm1_code", "adm1_name", "segment")))
def probe_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_detect.containment(layers.admin(spark, sf_dir), "adm2_code", ["adm1_code", "adm1_name", "segment"])


@query(f"SELECT count(*) AS rows, count(*) FILTER (WHERE NOT starts_with(adm3_code, adm2_code)) AS misses, count(DISTINCT adm3_code) FILTER (WHERE NOT starts_with(adm3_code, adm2_code)) AS culprits, true AS holds FROM ({layers.ADMIN_SQL})")
def probe_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_detect.embeds(layers.admin(spark, sf_dir), "adm3_code", "adm2_code", prefix=True)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST(regexp_matches({c}, '[0-9]') AS INT)), 9) AS share, avg(CAST(regexp_matches({c}, '[0-9]') AS INT)) > 0.5 AS code_shaped FROM ({layers.ADMIN_SQL})" for c in ("adm1_name", "adm2_code", "adm3_name", "segment")))
def probe_code_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_detect.code_shaped(layers.admin(spark, sf_dir), ["adm1_name", "adm2_code", "adm3_name", "segment"])


@query(f"""WITH b AS ({layers.CUSTOMER_SQL}), w AS (SELECT code, count(*) AS n, var_pop(xmin) + var_pop(ymin) AS v FROM b GROUP BY code), t AS (SELECT var_pop(xmin) + var_pop(ymin) AS v FROM b)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, round(1 - sum(n * w.v) / sum(n) / any_value(t.v), 9) AS share, 1 - sum(n * w.v) / sum(n) / any_value(t.v) >= 0.7 AS coherent FROM w, t""")
def probe_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_detect.coherence(layers.customer_boxes(spark, sf_dir), "code", "xmin", "ymin")


@query(f"SELECT adm2_code AS unit, adm1_code AS parent, key FROM ({layers.ADMIN_SQL})")
def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = layers.admin(spark, sf_dir)
    rows = {"adm2_code": "unit", "adm1_code": "parent", "key": "key"}
    return schema_detect.apply_crosswalk(layer, [(c, rows.get(c)) for c in layer.columns])


@query(f"""SELECT source_column, target_column, unique_count FROM (SELECT 'adm1_code' AS source_column, 'adm1_code' AS target_column, count(DISTINCT adm1_code) AS unique_count FROM ({layers.ADMIN_SQL})
UNION ALL SELECT 'adm1_name', 'adm1_name', count(DISTINCT adm1_name) FROM ({layers.ADMIN_SQL}) UNION ALL SELECT 'adm2_code', 'adm2_code', count(DISTINCT adm2_code) FROM ({layers.ADMIN_SQL}) UNION ALL SELECT 'adm2_name', 'adm2_name', count(DISTINCT adm2_name) FROM ({layers.ADMIN_SQL})
UNION ALL SELECT 'adm3_code', 'adm3_code', count(DISTINCT adm3_code) FROM ({layers.ADMIN_SQL}) UNION ALL SELECT 'segment', NULL, count(DISTINCT segment) FROM ({layers.ADMIN_SQL}))""")
def schema_map_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.operators.schema_map import schema_map

    return schema_map(layers.admin(spark, sf_dir).drop("key", "adm3_name")).select("source_column", "target_column", "unique_count")


@query(f"SELECT fid, CAST(1.0 AS DOUBLE) AS area FROM ({layers.NATION_SQL})")
def merge_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.operators.slivers import merge_micro as merge

    n = layers.nation_boxes(spark, sf_dir)
    sliver = n.where("fid = 4").withColumns({"fid": F.lit(99).cast(n.schema["fid"].dataType), "xmin": F.col("xmax"), "xmax": F.col("xmax") + 5e-9})
    out, _ = merge(shaped(n.unionByName(sliver)).select("fid", "geom"))
    return out.select("fid", F.round(st("area", "geom"), 6).alias("area"))


@query()
def edge_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.operators import edge

    grown = edge.edge_extend(shaped(layers.nation_boxes(spark, sf_dir)).select("fid", "geom"), distance=0.1, margin=0.5)
    return grown.select("fid", F.round(st("area", "geom"), 3).alias("area"))


@query(f"SELECT 7 AS overlay_fid, count(*) AS units, CAST(36.0 AS DOUBLE) AS area FROM ({layers.NATION_SQL})")
def edge_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.operators import edge

    units = shaped(layers.nation_boxes(spark, sf_dir)).select("fid", "geom")
    around = units.limit(1).select(F.lit(7).cast("long").alias("fid"), st("makeenvelope", F.lit(-0.5), F.lit(-0.5), F.lit(5.5), F.lit(5.5)).alias("geom"))
    out = edge.edge_match(units, around, "many", distance=0.1, margin=0.8)
    return out.groupBy(F.col("overlay_fid").cast("int").alias("overlay_fid")).agg(F.count("*").alias("units"), F.round(F.sum(st("area", "geom")), 4).alias("area"))


@query(f"SELECT fid, CAST(xmax - xmin AS DOUBLE) AS area FROM ({layers.NATION_SQL})")
def edge_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.operators import edge

    n = shaped(layers.nation_boxes(spark, sf_dir)).select("fid", "geom")
    out = edge.edge_stitch([n.where("fid < 12"), n.where("fid >= 12")])
    return out.select("fid", F.round(st("area", "geom"), 6).alias("area"))


@query()
def code_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrace.functions.codes import CodeFormat
    from terrace.operators import change
    from terrace.operators.code_update import code_update_level

    a, b = layers.old_boxes(spark, sf_dir), layers.new_boxes(spark, sf_dir)
    _, links = change.classify(a, b, assign.coverage_ratios(a, b), ("code",))
    old = a.select("fid", F.concat(F.lit("W."), F.lpad(F.col("fid").cast("string"), 3, "0")).alias("code"), F.lit("W").alias("parent_code"))
    return code_update_level(old, b.select("fid", F.lit("W").alias("parent_code")), links, CodeFormat("W"), 1)
