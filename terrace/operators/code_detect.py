"""Checks of codes: missing, shared, misplaced and misshapen ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.hierarchy import Target
from terrace.operators.reports import finding, mode_of, numbered, run_checks, severity
from terrace.operators.units import unit_list

# Severities and shares.
SEVERITY = {"check-failed": "error", "blank-code": "error", "name-conflict": "error", "duplicate-code": "error", "prefix-mismatch": "error", "split-unit": "warn", "format-outlier": "warn", "format-undetected": "warn"}
PREFIX_SHARE, SHAPE_SHARE, LEAST_CODES = 0.9, 0.9, 10
SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "level" else T.StringType()) for n in ("kind", "level", "column_name", "code_a", "name_a", "code_b", "name_b", "reason")])


def code_findings(units: DataFrame) -> DataFrame:
    """All findings of a unit list, unnumbered."""
    coded = units.where("code is not null")
    named = coded.where("name is not null and trim(name) <> ''")
    first = coded.where("name_index = 0")
    codes = first.groupBy("level", "code_column", "code", "parent_code").agg(F.sum("row_count").alias("row_count"))

    def blank() -> DataFrame:
        rows = units.where("code is null and name_index = 0").groupBy("level", "code_column", "parent_code")
        rows = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
        return finding(rows, SCHEMA, "blank-code", level="level", column_name="code_column", reason=F.format_string("%d units under %s have no code: %s", "n", F.coalesce("parent_code", F.lit("the root")), F.when(F.size("names") == 0, "no name either").otherwise(F.array_join("names", " / "))))

    def conflict() -> DataFrame:
        rows = named.groupBy("level", "name_column", "name_index", "code").agg(F.array_sort(F.collect_set("name")).alias("names")).where("size(names) > 1")
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("level", "code").orderBy("name_index"))).where("r = 1")
        return finding(rows, SCHEMA, "name-conflict", level="level", column_name="name_column", code_a="code", name_a=F.get("names", 0), code_b="code", name_b=F.get("names", 1), reason=F.format_string("code %s has %d names: %s", "code", F.size("names"), F.array_join("names", " / ")))

    def repeats() -> DataFrame:
        leaf = first.join(F.broadcast(units.agg(F.max("level").alias("level"))), "level")
        return leaf.groupBy("level", "code_column", "code").agg(F.sum("row_count").alias("features"), F.count_distinct(F.struct("parent_code", "name")).alias("variants")).where("features > 1")

    def duplicate() -> DataFrame:
        return finding(repeats().where("variants > 1"), SCHEMA, "duplicate-code", level="level", column_name="code_column", code_a="code", reason=F.format_string("code %s is on %d polygons with different names or parents", "code", "features"))

    def split() -> DataFrame:
        return finding(repeats().where("variants = 1"), SCHEMA, "split-unit", level="level", column_name="code_column", code_a="code", reason=F.format_string("code %s is on %d polygons with the same name and parent: one unit split across polygons", "code", "features"))

    def prefix() -> DataFrame:
        pairs = codes.where("parent_code is not null").withColumn("fits", F.col("code").startswith(F.col("parent_code")))
        usual = pairs.groupBy("level").agg(F.count("*").alias("n"), F.avg(F.col("fits").cast("int")).alias("share")).where((F.col("n") >= LEAST_CODES) & (F.col("share") >= PREFIX_SHARE))
        rows = pairs.where(~F.col("fits")).join(usual, "level", "left_semi")
        return finding(rows, SCHEMA, "prefix-mismatch", level="level", column_name="code_column", code_a="code", code_b="parent_code", reason=F.format_string("code %s does not start with its parent code %s", "code", "parent_code"))

    def shaped() -> DataFrame:
        shapes = codes.select("level", "code_column", "code", F.regexp_replace(F.regexp_replace("code", r"\p{L}", "A"), "[0-9]", "9").alias("shape")).distinct()
        return shapes.join(mode_of(shapes, ["level"], "shape", "usual").where(F.col("total") >= LEAST_CODES), "level")

    def outlier() -> DataFrame:
        rows = shaped().where((F.col("n") >= F.col("total") * SHAPE_SHARE) & (F.col("shape") != F.col("usual")))
        return finding(rows, SCHEMA, "format-outlier", level="level", column_name="code_column", code_a="code", reason=F.format_string("code %s is shaped %s, unlike %d of %d level %d codes (%s)", "code", "shape", "n", "total", "level", "usual"))

    def undetected() -> DataFrame:
        rows = shaped().where(F.col("n") < F.col("total") * SHAPE_SHARE).select("level", "code_column", "usual", "n", "total").distinct()
        return finding(rows, SCHEMA, "format-undetected", level="level", column_name="code_column", reason=F.format_string("level %d codes share no common shape: the most common, %s, covers %d of %d", "level", "usual", "n", "total"))

    checks = {"blank-code": blank, "name-conflict": conflict, "duplicate-code": duplicate, "split-unit": split, "prefix-mismatch": prefix, "format-outlier": outlier, "format-undetected": undetected}
    return run_checks(checks, SCHEMA, units.sparkSession)


def code_detect(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """The report of a layer's codes: findings with key and severity, worst first."""
    units = unit_list(layer, fields).persist()  # every check reads it; small beside the layer
    rows = numbered(code_findings(units), ("level", "column_name", "code_a", "reason")).withColumn("severity", severity(SEVERITY))
    return rows.select("key", "kind", "severity", *SCHEMA.names[1:])
