"""Layers and reports, in and out."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.kernel import register, st

RESERVED = ("fid", "OGC_FID")


def read_layer(spark: SparkSession, path: str, geometry: str | None = None, make_valid: bool = True) -> DataFrame:
    """A Parquet layer with `geom` in WKB and `fid`, numbered by content: reserved names get _orig, box structs and other geometry columns go. Empty layers and layers without a geometry raise."""
    register(spark)
    df = spark.read.parquet(path)
    binary = [n for n, t in df.dtypes if t == "binary"]
    geometry = geometry or next((n for n in binary if n in ("geometry", "geom", "wkb_geometry")), binary[0] if binary else None)
    if geometry is None:
        raise ValueError(f"{path} has no geometry column")
    keep = [n for n, t in df.dtypes if n not in binary and not (n.endswith("bbox") and t.startswith("struct"))]
    shape = st("makevalid", geometry) if make_valid else st("force2d", geometry)
    out = df.select(*(F.col(c).alias(f"{c}_orig" if c in RESERVED else c) for c in keep), shape.alias("geom"))
    if out.isEmpty():
        raise ValueError(f"{path} has no rows")
    return numbered(out)


def numbered(df: DataFrame) -> DataFrame:
    """df with fid from 1, in the order of its rows' hashes: the same for the same rows, without gathering them in one task.

    Rows are dealt out by ranges of the hash; each range counts on from those before it.
    """
    keyed = df.withColumn("_h", F.xxhash64(*df.columns)).withColumn("_r", F.pmod(F.shiftright("_h", 52), F.lit(4096)))
    before = keyed.groupBy("_r").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("_r", "_before")
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", *(c for c, t in df.dtypes if not t.startswith("map"))))
    return keyed.withColumn("_n", place).join(F.broadcast(before), "_r").select((F.col("_n") + F.col("_before")).alias("fid"), *df.columns)


def read_layers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several layers as one by column name, the widest first, with source_file and new fids."""
    frames = sorted(((p, read_layer(spark, p).drop("fid")) for p in paths), key=lambda x: -len(x[1].columns))
    out = None
    for path, df in frames:
        df = df.withColumn("source_file", F.lit(path))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return numbered(out)


def default_output(path: str, suffix: str, ending: str = ".parquet") -> str:
    """Beside the input, or in the working folder for remote ones."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    folder = "" if "://" in path else os.path.dirname(path)
    return os.path.join(folder, f"{stem}{suffix}{ending}")


def write_layer(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """geom first, named geometry, without fid: as Parquet, or as lines of GeoJSON features for .geojson paths."""
    register(df.sparkSession)
    rest = [c for c in df.columns if c not in ("geom", "fid")]
    mode = "overwrite" if overwrite else "errorifexists"
    if path.endswith(".geojson"):
        feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(st("asgeojson", "geom"), F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), F.lit("}"))
        df.select(feature.alias("value")).write.mode(mode).text(path)
        return
    if not path.endswith(".parquet"):
        raise ValueError(f"{path}: layers are written as .parquet or .geojson")
    meta = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": []}}}
    shaped = df.select(F.col("geom").alias("geometry", metadata={"geo": json.dumps(meta)}), *rest)
    shaped.write.mode(mode).option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """A report as CSV with a header, or as Parquet. One without rows is not written, and what stood there goes; whether it was written comes back."""
    if df.isEmpty():
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        return False
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)
    return True


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report with every column as text."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
