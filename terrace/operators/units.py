"""The unit list of a layer: one row for each level, name column, code, parent code and name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target, levels_of


def unit_list(layer: DataFrame, fields: Target = Target()) -> DataFrame:
    """(level, name_column, name_index, code_column, code, parent_code, name, row_count) of every level that the templates find.

    One grouped scan per level and name column; a level without a name has its codes under a null name column.
    """
    levels, parts = levels_of(layer.columns, fields), []
    for level, (code, names) in levels.items():
        parent = F.col(levels[level - 1][0]).cast("string") if level - 1 in levels else F.lit(None).cast("string")
        for index, name in enumerate(names or (None,)):
            shown = F.col(name).cast("string") if name else F.lit(None).cast("string")
            part = layer.groupBy(F.col(code).cast("string").alias("code"), parent.alias("parent_code"), shown.alias("name")).agg(F.count("*").alias("row_count"))
            parts.append(part.select(F.lit(level).alias("level"), F.lit(name).cast("string").alias("name_column"), F.lit(index).alias("name_index"), F.lit(code).alias("code_column"), "code", "parent_code", "name", "row_count"))
    return reduce(DataFrame.unionByName, parts)
