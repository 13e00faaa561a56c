"""Findings: the rows of detectors' reports, made by checks that don't hide one another."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finding(rows: DataFrame, schema: T.StructType, kind: str, **columns: Column | str) -> DataFrame:
    """rows as findings of a kind; columns not given are null."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()} | {"kind": F.lit(kind)}
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def run_checks(checks: Mapping[str, Callable[[], DataFrame]], schema: T.StructType, spark) -> DataFrame:
    """All checks' findings; a check that can't be planned gives a check-failed row instead of an error."""
    found = []
    for kind, check in checks.items():
        try:
            rows = check()
            rows.schema  # analysed here
            found.append(rows)
        except (PySparkException, ValueError, KeyError) as e:
            failed = {"kind": "check-failed", "reason": f"{kind} check failed: {e}"}
            found.append(spark.createDataFrame([tuple(failed.get(f.name) for f in schema)], schema))
    return reduce(DataFrame.unionByName, found)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with `key`: the kind and a number, in order within the kind."""
    by = Window.partitionBy("kind").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return rows.withColumn("key", F.concat_ws("-", "kind", F.row_number().over(by).cast("string")))


def severity(kinds: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, value in kinds.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def any_of(column: str) -> Column:
    """A value of a group that doesn't depend on the order of rows."""
    return F.min(column)


def mode_of(rows: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """The most frequent value by group, the smallest of equals, with the group's `total` and its own count `n`."""
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), column)))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return ranked.where("_r = 1").select(*by, F.col(column).alias(name), "n").join(totals, list(by))
