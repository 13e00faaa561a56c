"""Rows of a unit made one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target, is_noise, is_numeric, level_of

_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "first": F.min}


def constant_columns(layer: DataFrame, by: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns with at most one distinct non-null value in every group: two grouped passes, one row to the driver."""
    if not columns:
        return []
    # at most one value: the smallest is the largest, which needs no distinct sets
    per_group = layer.groupBy(*by).agg(*((F.min(c).eqNullSafe(F.max(c))).alias(c) for c in columns))
    row = per_group.agg(*(F.bool_and(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] or row[c] is None]


def dissolve(layer: DataFrame, by: Sequence[str], overrides: Mapping[str, str] | None = None, fields: Target | None = None, level: int | None = None, union=None, geometry: str = "geom") -> DataFrame:
    """One row for each value of `by`, nulls a group of their own, columns in their order.

    Others: constant in every group -> that value; numeric -> sum, or what `overrides` says (sum, min, max, avg, first); else dropped,
    as are noise columns and, given `level`, columns of finer levels. union: an aggregate for the geometry column, which is dropped without.
    """
    overrides = dict(overrides or {})
    if unknown := [c for c in (*by, *overrides) if c not in layer.columns]:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    if bad := set(overrides.values()) - set(_AGGREGATES):
        raise ValueError(f"no such aggregates: {', '.join(sorted(bad))}")
    finer = lambda c: fields is not None and level is not None and any((level_of(c, t) or 0) > level for t in (fields.name_field, fields.code_field))
    rest = [c for c in layer.columns if c not in by and c != geometry and not is_noise(c) and not finer(c)]
    same = set(constant_columns(layer, by, [c for c in rest if c not in overrides]))
    aggregates = []
    for c in rest:
        if c in overrides:
            aggregates.append(_AGGREGATES[overrides[c]](c).alias(c))
        elif c in same:
            aggregates.append(F.min(c).alias(c))
        elif is_numeric(layer.schema[c].dataType):
            aggregates.append(F.sum(c).alias(c))
    if geometry in layer.columns and union is not None:
        aggregates.append(union(geometry).alias(geometry))
    if not aggregates:
        return layer.select(*by).distinct()
    out = layer.groupBy(*by).agg(*aggregates)
    return out.select(*(c for c in layer.columns if c in out.columns))
