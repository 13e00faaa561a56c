"""New hierarchical codes, numbered from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.codes import CodeFormat, built, used_number
from terrace.functions.hierarchy import Target, levels_of


def continue_codes(rows: DataFrame, order: list[str], existing: DataFrame, fmt: CodeFormat, level: int, parent: str = "parent_code") -> DataFrame:
    """rows with new_code: numbers after the largest that a live direct child of the same parent has, in order within the parent, nulls last.

    existing: (code, parent_code). Gaps are never filled; codes that aren't numbers don't count.
    """
    top = existing.select(F.col("parent_code").alias("_p"), used_number(F.col("code"), F.col("parent_code"), fmt.delimiter).alias("n")).groupBy("_p").agg(F.max("n").alias("_top"))
    by = Window.partitionBy(parent).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    out = rows.withColumn("_n", F.row_number().over(by)).join(top, rows[parent].eqNullSafe(top["_p"]), "left").withColumn("_n", F.col("_n") + F.coalesce("_top", F.lit(0)))
    width = fmt.width(level)
    if width is None:
        widest = out.agg(F.max(F.length(F.col("_n").cast("string"))).alias("_w"))
        out, width = out.crossJoin(F.broadcast(widest)), F.col("_w")
    elif not fmt.delimiter and out.where(F.col("_n") >= 10**width).limit(1).count():
        raise ValueError(f"level {level} needs more than {width} digits and codes have no delimiter")
    return out.withColumn("new_code", built(F.coalesce(F.col(parent), F.lit(fmt.root)), F.col("_n"), width, fmt.delimiter)).drop("_n", "_p", "_top", "_w")


def code_create(layer: DataFrame, fmt: CodeFormat, fields: Target = Target(), source_codes: str = "replace") -> DataFrame:
    """layer with its code columns rewritten under one root.

    replace: units of a parent, told apart by their old code, are numbered in its order. copy: old codes follow the parent's new
    code as they are. embed: what an old code adds to its parent's old code follows, numbers zero-padded; all of a level must begin with it. Each level is one
    distinct list of (old code, parent's new code), numbered within parents and joined back null-safely. A null or blank code raises.
    """
    levels = {n: x for n, x in levels_of(layer.columns, fields).items() if n > 0}
    old = {n: F.trim(F.col(c).cast("string")) for n, (c, _) in levels.items()}
    missing = layer.agg(*(F.count_if(F.coalesce(x == "", F.lit(True))).alias(str(n)) for n, x in old.items())).first()
    for n in levels:
        if missing[str(n)]:
            raise ValueError(f"{missing[str(n)]} rows have no code at level {n}")
    out = layer.withColumns({f"_old{n}": x for n, x in old.items()}).withColumn("_new0", F.lit(fmt.root))
    for i, n in enumerate(sorted(levels)):
        above = f"_new{sorted(levels)[i - 1]}" if i else "_new0"
        before = f"_old{sorted(levels)[i - 1]}" if i else None
        units = out.select(F.col(f"_old{n}").alias("raw"), F.col(above).alias("parent_code"), (F.col(before) if before else F.lit("")).alias("was")).distinct()
        if source_codes == "replace":
            none = out.sparkSession.createDataFrame([], "code string, parent_code string")
            coded = continue_codes(units, ["raw"], none, fmt, i + 1)
        else:
            coded = units.withColumn("new_code", _kept_code(source_codes, fmt, i + 1))
        coded = coded.select(F.col("raw").alias("_raw"), F.col("parent_code").alias("_parent"), F.col("new_code").alias(f"_new{n}")).distinct()
        out = out.join(coded, out[f"_old{n}"].eqNullSafe(coded["_raw"]) & out[above].eqNullSafe(coded["_parent"]), "left").drop("_raw", "_parent")
    root = {fields.code(0): F.lit(fmt.root)}
    out = out.withColumns(root | {levels[n][0]: F.col(f"_new{n}") for n in levels})
    return out.drop(*(c for c in out.columns if c.startswith(("_old", "_new"))))


def _kept_code(mode: str, fmt: CodeFormat, level: int) -> Column:
    raw, width = F.col("raw"), fmt.width(level) or 0
    if mode == "embed":
        raw = F.when(raw.startswith(F.col("was")), F.substring(raw, F.length("was") + 1, F.length(raw))).otherwise(raw)
        raw = F.when(raw.rlike("^[0-9]+$"), F.lpad(raw, F.greatest(F.lit(width), F.length(raw)).cast("int"), "0")).otherwise(raw)
    elif mode != "copy":
        raise ValueError(f"source codes can be replaced, embedded or copied, not {mode!r}")
    return F.concat("parent_code", F.lit(fmt.delimiter), raw)


def digit_overflow(layer: DataFrame, fmt: CodeFormat, fields: Target = Target()) -> DataFrame:
    """(level, parent_code, children, widest): parents with more children than the level's width has numbers, and their longest code."""
    levels, found = levels_of(layer.columns, fields), None
    for n in (n for n in levels if n - 1 in levels):
        width = fmt.width(n)
        pairs = layer.select(F.col(levels[n - 1][0]).alias("parent_code"), F.col(levels[n][0]).alias("code")).distinct()
        rows = pairs.groupBy("parent_code").agg(F.count("*").alias("children"), F.max(F.struct(F.length("code").alias("n"), "code")).getField("code").alias("widest"))
        rows = rows.where(F.lit(width is not None) & (F.col("children") > 10 ** (width or 0) - 1)).select(F.lit(n).alias("level"), "parent_code", "children", "widest")
        found = rows if found is None else found.unionByName(rows)
    return found
