"""Geometry functions for Spark SQL on WKB columns, run in the JVM by the geometry classes that Spark ships.

register() adds geo.jar (built from kernel/Geo.java) to the session and registers its st_ functions; it can be called again.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JAR = os.path.join(os.path.dirname(__file__), "geo.jar")
_MARK = "spark.terrace.geometry"


def register(spark: SparkSession) -> None:
    if spark.conf.get(_MARK, "") == spark.sparkContext.applicationId:
        return
    if not os.path.exists(JAR):
        raise RuntimeError(f"geometry functions need {JAR}; kernel/build.sh makes it")
    try:
        spark.sql(f"ADD JAR '{JAR}'")
        kernel = spark._jsparkSession.sharedState().jarClassLoader().loadClass("terrace.Geo")
        (method,) = [m for m in kernel.getMethods() if m.getName() == "register"]
        given = spark._sc._gateway.new_array(spark._jvm.java.lang.Object, 1)
        given[0] = spark._jsparkSession
        method.invoke(None, given)
    except Exception as e:
        raise RuntimeError(f"geometry functions could not be loaded from {JAR}: {e}") from e
    spark.conf.set(_MARK, spark.sparkContext.applicationId)


def st(name: str, *columns: Column | str | float | int) -> Column:
    """st_<name> of columns, names of columns, or numbers."""
    return F.call_function(f"st_{name}", *(F.lit(c) if isinstance(c, (int, float)) else c for c in columns))


def with_box(df: DataFrame, geometry: str = "geom") -> DataFrame:
    """df with its geometries' bounds as columns, made once before any range join."""
    return df.withColumns({c: st(c, geometry) for c in ("xmin", "ymin", "xmax", "ymax")})


def dumped(df: DataFrame, geometry: str = "geom") -> DataFrame:
    """A row for each part of each geometry."""
    return df.withColumn(geometry, F.explode(st("dump", geometry)))


def union_of(geometry: str = "geom") -> Column:
    """The union of a group's geometries. Unite large groups by tiles first (union_by)."""
    return st("union_array", F.collect_list(geometry))


def union_by(df: DataFrame, keys: list[str], geometry: str = "geom", fan: int = 64) -> DataFrame:
    """(keys, geometry): unions by key in two steps, so that no group hands more than its share of rows to one task."""
    part = df.groupBy(*keys, F.pmod(F.xxhash64(geometry), F.lit(fan)).alias("_part")).agg(union_of(geometry).alias(geometry))
    return part.groupBy(*keys).agg(union_of(geometry).alias(geometry))
