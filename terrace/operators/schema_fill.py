"""Rows that stop above the finest level, filled downwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target, families, levels_of


def schema_fill(layer: DataFrame, fields: Target = Target(), depth: str = "depth") -> DataFrame:
    """layer with `depth`, the deepest level that has a code, and every column of a family below it set to the value at that depth.

    A column family has one column for each of several levels; families of one column stay. A null at the depth stays null below it.
    The value comes from the deepest of the family's levels that isn't below the depth. No shuffle: one projection.
    """
    if depth in layer.columns:
        raise ValueError(f"there is a column {depth} already")
    levels = levels_of(layer.columns, fields)
    at = reduce(lambda out, n: F.when(F.col(levels[n][0]).isNotNull(), n).otherwise(out), sorted(levels), F.lit(None).cast("int"))
    new: dict[str, Column] = {}
    for by_level in families(layer.columns, (fields.name_field, fields.code_field)).values():
        if len(by_level) < 2:
            continue
        for n, c in by_level.items():
            value = F.col(c)
            for m in sorted((m for m in by_level if m < n)):
                beyond = min((k for k in by_level if k > m), default=n)
                value = F.when((F.col(depth) >= m) & (F.col(depth) < beyond) & (F.col(depth) < n), F.col(by_level[m])).otherwise(value)
            new[c] = value
    filled = layer.withColumn(depth, at)
    return filled.select(*(new.get(c, F.col(c)).alias(c) for c in filled.columns))
