"""Reports of layers that arrive in files: each micro-batch is checked as it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.functions.hierarchy import Target
from terrace.operators.code_detect import code_findings
from terrace.operators.units import unit_list


def report_stream(layers: DataFrame, path: str, checkpoint: str, check: Callable[[DataFrame], DataFrame] | None = None, fields: Target = Target()) -> StreamingQuery:
    """Writes the findings of every micro-batch of a streaming layer to `path`, with the batch's number; `check` takes a layer, by default to its code findings.

    A batch that is run again after a failure replaces its own findings, so none comes twice.
    """
    check = check or (lambda layer: code_findings(unit_list(layer, fields)))

    def each(layer: DataFrame, number: int) -> None:
        check(layer).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return layers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unit_counts(layers: DataFrame, code: str, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, code, n): rows by code and event-time window of a streaming layer; later ones than `late` are dropped and their state with them."""
    return layers.withWatermark(time, late).groupBy(F.window(time, width), F.col(code).alias("code")).agg(F.count("*").alias("n"))
