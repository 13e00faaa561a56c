"""All checks of a layer in one summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target
from terrace.operators.code_detect import code_detect
from terrace.operators.name_detect import name_detect
from terrace.operators.schema_detect import schema_detect
from terrace.operators.topology import topo_detect

STAGES = ("schema", "topo", "code", "name")
TOPO_SEVERITY = {"gap": "warn", "notch": "warn"}


def validate(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """(stage, kind, severity, count): findings of the schema, topology (with a geom column), code and name checks. Code and name checks need detected levels."""
    schema = schema_detect(layer, fields)
    found = {"schema": schema}
    if "geom" in layer.columns:
        kinds = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in TOPO_SEVERITY.items()), F.lit("error"))
        found["topo"] = topo_detect(layer).withColumn("severity", kinds)
    if schema.where("kind in ('levels-undetected', 'level-skipped')").isEmpty():
        found |= {"code": code_detect(layer, fields), "name": name_detect(layer, fields)}
    parts = [df.groupBy("kind", "severity").agg(F.count("*").alias("count")).select(F.lit(stage).alias("stage"), "kind", "severity", "count") for stage, df in found.items()]
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return reduce(DataFrame.unionByName, parts).orderBy(order, "severity", "kind")
