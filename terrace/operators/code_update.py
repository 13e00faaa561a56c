"""Codes of a new version from those of the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.codes import CodeFormat, last_part
from terrace.operators.code_create import continue_codes

KEPT = ("unchanged", "renamed")


def code_update_level(old: DataFrame, new: DataFrame, links: DataFrame, fmt: CodeFormat, level: int) -> DataFrame:
    """(fid, code, predecessor_code, retained) of a level's new units, once their parents have their codes.

    old: fid, code, parent_code. new: fid, parent_code. links: a_fid, b_fid, change. Units that are unchanged or renamed, or modified where codes have no delimiter,
    keep their code's last part under their parent's new code; of several that would get one code the first keeps it. All others are numbered after the
    largest number of the parent's old and kept codes, in the order of the text n<level>_<fid>. predecessor_code: the old codes a unit comes from, sorted.
    """
    kept = KEPT if fmt.delimiter else (*KEPT, "modified")
    before = links.join(old.select(F.col("fid").alias("a_fid"), F.col("code").alias("old_code"), F.col("parent_code").alias("old_parent")), "a_fid")
    origins = before.groupBy("b_fid").agg(F.array_join(F.array_sort(F.collect_set("old_code")), ", ").alias("predecessor_code"))
    tails = before.where(F.col("change").isin(*kept)).select("b_fid", last_part(F.col("old_code"), F.col("old_parent"), fmt.delimiter).alias("tail"))
    units = new.join(origins, new["fid"] == origins["b_fid"], "left").drop("b_fid").join(tails, new["fid"] == tails["b_fid"], "left").drop("b_fid")
    units = units.withColumns({"key": F.concat(F.lit(f"n{level}_"), F.col("fid").cast("string")), "wish": F.concat("parent_code", F.lit(fmt.delimiter), "tail")})
    first = F.row_number().over(Window.partitionBy("wish").orderBy("key")) == 1
    units = units.withColumn("retained", F.col("wish").isNotNull() & first)
    held = units.where("retained").select("fid", F.col("wish").alias("code"), "predecessor_code", "retained", "parent_code")
    existing = old.select("code", "parent_code").unionByName(held.select("code", "parent_code"))
    fresh = continue_codes(units.where("not retained"), ["key"], existing, fmt, level)
    return held.drop("parent_code").unionByName(fresh.select("fid", F.col("new_code").alias("code"), "predecessor_code", "retained"))
