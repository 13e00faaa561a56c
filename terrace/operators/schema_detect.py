"""Checks of a hierarchy's columns, and the statistics that tell which columns form one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.hierarchy import Target, is_fractional, is_noise, is_temporal, level_of, levels_of
from terrace.operators.reports import finding, numbered, run_checks, severity

# Fixed values.
SEVERITY = {"check-failed": "error", "levels-undetected": "error", "level-skipped": "error", "multiple-parents": "error", "orphan-child": "error", "supplemental-column": "warn", "column-naming": "warn", "column-set-mismatch": "warn"}
SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "level" else T.StringType()) for n in ("kind", "level", "column_name", "code", "reason")])


def parent_pairs(layer: DataFrame, fields: Target) -> DataFrame | None:
    """(level, column_name, child, parent): each level's distinct codes with those above them."""
    levels = levels_of(layer.columns, fields)
    parts = [layer.select(F.lit(n).alias("level"), F.lit(levels[n][0]).alias("column_name"), F.col(levels[n][0]).cast("string").alias("child"), F.col(levels[n - 1][0]).cast("string").alias("parent")).distinct() for n in levels if n - 1 in levels]
    return reduce(DataFrame.unionByName, parts) if parts else None


def schema_findings(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """All findings of a layer's columns, unnumbered."""
    spark = layer.sparkSession
    try:
        levels = levels_of(layer.columns, fields)
    except ValueError as e:
        found = sorted({n for c in layer.columns if (n := level_of(c, fields.code_field)) is not None})
        skipped = [n for n in range(min(found, default=0), max(found, default=-1)) if n not in found]
        rows = [("level-skipped", n, None, None, f"level {n} has no column") for n in skipped] or [("levels-undetected", None, None, None, str(e))]
        return spark.createDataFrame(rows, SCHEMA)
    pairs = parent_pairs(layer, fields)

    def parents() -> DataFrame:
        rows = pairs.where("child is not null and parent is not null").groupBy("level", "column_name", "child").agg(F.array_sort(F.collect_set("parent")).alias("p")).where("size(p) > 1")
        return finding(rows, SCHEMA, "multiple-parents", level="level", column_name="column_name", code="child", reason=F.format_string("code %s has %d parents: %s", "child", F.size("p"), F.array_join("p", ", ")))

    def orphans() -> DataFrame:
        rows = pairs.where("child is not null and parent is null")
        return finding(rows, SCHEMA, "orphan-child", level="level", column_name="column_name", code="child", reason=F.format_string("code %s has no parent code", "child"))

    def sets() -> DataFrame:
        counts = {n: len(names) for n, (_, names) in levels.items() if n}
        usual = max(counts.values(), default=0)
        rows = [("column-set-mismatch", n, levels[n][0], None, f"level {n} has {k} name columns, others up to {usual}") for n, k in counts.items() if k < usual]
        return spark.createDataFrame(rows, SCHEMA)

    checks = {"column-set-mismatch": sets}
    if pairs is not None:
        checks |= {"multiple-parents": parents, "orphan-child": orphans}
    return run_checks(checks, SCHEMA, spark)


def schema_detect(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    rows = numbered(schema_findings(layer, fields), ("level", "column_name", "code")).withColumn("severity", severity(SEVERITY))
    return rows.select("key", "kind", "severity", *SCHEMA.names[1:])


def candidates(layer: DataFrame) -> list[str]:
    """Columns that could be part of a hierarchy: no noise, geometry, dates or fractions."""
    return [f.name for f in layer.schema if f.name not in ("fid", "geom", "source_file") and not is_noise(f.name) and not is_temporal(f.dataType) and not is_fractional(f.dataType) and not isinstance(f.dataType, T.BinaryType)]


def distinct_counts(layer: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct, n_filled, n_rows) in one pass: values stacked, made distinct with a map-side combine, and counted."""
    stacked = layer.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    per_value = stacked.groupBy("column", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_filled"), F.sum("n").alias("n_rows"))


def containment(layer: DataFrame, finer: str, coarser: list[str]) -> DataFrame:
    """(finer, coarser, groups, violators, holds, perfect): whether each value of the finer column lies in one value of each coarser one.

    A group violates if it has several coarser values or a row without one; one violator is tolerated among more than two groups; perfect: at least ten groups and none.
    All coarser columns in one grouped pass.
    """
    per_group = layer.where(F.col(finer).isNotNull()).groupBy(finer).agg(*(((F.min(c) != F.max(c)) | (F.count(c) < F.count("*"))).alias(c) for c in coarser))
    counts = per_group.agg(F.count("*").alias("groups"), *(F.count_if(F.coalesce(F.col(c), F.lit(True))).alias(c) for c in coarser))
    rows = counts.select("groups", F.explode(F.array(*(F.struct(F.lit(c).alias("coarser"), F.col(c).alias("violators")) for c in coarser))).alias("x")).select(F.lit(finer).alias("finer"), "x.coarser", "groups", "x.violators")
    return rows.withColumns({"holds": (F.col("violators") == 0) | ((F.col("violators") == 1) & (F.col("groups") > 2)), "perfect": (F.col("groups") >= 10) & (F.col("violators") == 0)})


def embeds(layer: DataFrame, child: str, parent: str, prefix: bool = False) -> DataFrame:
    """(rows, misses, culprits, holds): whether every value of child holds its row's parent value, or begins with it; one culprit value is tolerated while rows remain."""
    c, p = F.col(child).cast("string"), F.col(parent).cast("string")
    hit = c.startswith(p) if prefix else c.contains(p)
    seen = layer.where(c.isNotNull() & (F.trim(p) != "")).agg(F.count("*").alias("rows"), F.count_if(~hit).alias("misses"), F.count_distinct(F.when(~hit, c)).alias("culprits"))
    return seen.withColumn("holds", (F.col("rows") > 0) & ((F.col("culprits") == 0) | ((F.col("culprits") == 1) & (F.col("misses") < F.col("rows")))))


def coherence(layer: DataFrame, column: str, x: str, y: str) -> DataFrame:
    """(groups, rows, share): how much of the places' variance lies between the column's values; `coherent` from 0.7 on, or where there is too little to tell."""
    rows = layer.where(F.col(column).isNotNull())
    within = rows.groupBy(column).agg(F.count("*").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    inner = within.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), (F.sum(F.col("n") * (F.col("vx") + F.col("vy"))) / F.sum("n")).alias("within"))
    total = rows.agg((F.var_pop(x) + F.var_pop(y)).alias("total"))
    share = F.round(1 - F.col("within") / F.nullif(F.col("total"), F.lit(0.0)), 9)
    out = inner.crossJoin(total).withColumn("share", share)
    return out.select("groups", "rows", "share", ((F.col("groups") < 2) | (F.col("rows") < 10) | F.col("share").isNull() | (F.col("share") >= 0.7)).alias("coherent"))


def code_shaped(layer: DataFrame, columns: list[str]) -> DataFrame:
    """(column, share, code_shaped): the share of values with a digit; more than half makes a code."""
    row = layer.agg(*(F.avg(F.col(c).cast("string").rlike("[0-9]").cast("int")).alias(c) for c in columns))
    rows = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c), 9).alias("share")) for c in columns))).alias("x")).select("x.*")
    return rows.withColumn("code_shaped", F.col("share") > 0.5)


def apply_crosswalk(layer: DataFrame, rows: list[tuple[str, str | None]]) -> DataFrame:
    """layer with columns renamed and dropped by (source, target or None). Sources must be the layer's columns exactly; targets unlike and not reserved."""
    sources, targets = [s for s, _ in rows], [t for _, t in rows if t]
    if sorted(sources) != sorted(c for c in layer.columns if c not in ("fid", "geom")):
        raise ValueError("the crosswalk's source columns aren't the layer's")
    if len(set(targets)) < len(targets) or {"fid", "geom", "geometry"} & set(targets):
        raise ValueError("target columns must be unlike one another and not reserved")
    fixed = [c for c in ("fid", "geom") if c in layer.columns]
    return layer.select(*fixed, *(F.col(s).alias(t) for s, t in rows if t))
