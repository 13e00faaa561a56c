"""Axis-aligned boxes: measures in plain arithmetic, and range joins by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def area(a: str) -> Column:
    return (F.col(f"{a}.xmax") - F.col(f"{a}.xmin")) * (F.col(f"{a}.ymax") - F.col(f"{a}.ymin"))


def shared_area(a: str, b: str) -> Column:
    wide = F.least(f"{a}.xmax", f"{b}.xmax") - F.greatest(f"{a}.xmin", f"{b}.xmin")
    high = F.least(f"{a}.ymax", f"{b}.ymax") - F.greatest(f"{a}.ymin", f"{b}.ymin")
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def touching(a: str, b: str, by: float = 0.0) -> Column:
    """Whether boxes meet, or come within `by`."""
    return (F.col(f"{b}.xmax") >= F.col(f"{a}.xmin") - by) & (F.col(f"{b}.xmin") <= F.col(f"{a}.xmax") + by) & (F.col(f"{b}.ymax") >= F.col(f"{a}.ymin") - by) & (F.col(f"{b}.ymin") <= F.col(f"{a}.ymax") + by)


def cell_size(boxes: DataFrame) -> float:
    """A grid size of about the boxes' median extent."""
    row = boxes.agg(F.percentile_approx(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), 0.5).alias("m"), F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))).alias("most")).first()
    return float(row.m or row.most or 1.0) or 1.0


def _cells(boxes: DataFrame, size: float, by: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - by) / size).cast("long"), F.floor((F.col(hi) + by) / size).cast("long"))
    return boxes.withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))


def range_join(left: DataFrame, right: DataFrame, by: float = 0.0, size: float | None = None) -> DataFrame:
    """(a struct, b struct) of all pairs of rows whose boxes meet, or come within `by`; boxes are columns xmin, ymin, xmax, ymax.

    An equi-join on grid cells instead of a nested loop. A pair is kept only in the cell that holds the lower left corner of what the widened boxes
    share, so none comes twice and nothing needs to be made distinct. Boxes much larger than a cell go to many cells; give them split.
    """
    size = size or cell_size(right)
    a = _cells(left, size, by).select("_cx", "_cy", F.struct(*left.columns).alias("a"))
    b = _cells(right, size, by).select("_cx", "_cy", F.struct(*right.columns).alias("b"))
    corner = lambda lo: F.floor((F.greatest(f"a.{lo}", f"b.{lo}") - by) / size).cast("long")
    met = a.join(b, ["_cx", "_cy"]).where(touching("a", "b", by))
    return met.where((corner("xmin") == F.col("_cx")) & (corner("ymin") == F.col("_cy"))).select("a", "b")


#: Pairs that take about as long to compare as one copy of a row takes to be sent to its cell.
_COPY = 50.0


def _fitting_size(boxes: DataFrame) -> float:
    """The grid size at which self_join() has least to do, taking boxes as evenly spread: smaller cells compare fewer pairs, larger ones copy fewer rows."""
    wide, high = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    every = boxes.agg(F.count("*").alias("n"), F.avg(wide).alias("w"), F.avg(high).alias("h"), F.avg(wide * high).alias("s"), (F.max("xmax") - F.min("xmin")).alias("x"), (F.max("ymax") - F.min("ymin")).alias("y"), F.max(F.greatest(wide, high)).alias("most")).first()
    if not every.most:
        return (max(every.x or 0.0, every.y or 0.0) / max(every.n, 1) ** 0.5) or 1.0

    def work(size: float) -> float:
        cells, edges = every.s / size**2 + (every.w + every.h) / size + 1, (every.w + every.h) / size + 2
        pairs = every.n**2 * min(1.0, size**2 / (every.x * every.y) if every.x * every.y else 1.0) * (cells + (every.w / size + 1) * (every.h / size + 1))
        return _COPY * every.n * (1 + cells + edges) + pairs

    return min((every.most / 2**k for k in range(12)), key=work)


def self_join(boxes: DataFrame, size: float | None = None) -> DataFrame:
    """(a struct, b struct) of all pairs of rows of one layer whose boxes meet, a.fid < b.fid; boxes are columns xmin, ymin, xmax, ymax, as in range_join().

    Of two boxes that meet, either one's lower left corner lies in the other, or one's left edge crosses the other's lower edge. So a row goes to the cell
    of its corner, to those of its two edges and to all its own, under one role each, and a pair meets in one cell under one role: none comes twice,
    and cells much smaller than the boxes leave few pairs to compare that don't meet. Equal sides count as in order of fid.
    """
    size = size or _fitting_size(boxes)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    at = lambda c: F.array(cell(f"{c}min"))
    span = lambda c: F.sequence(cell(f"{c}min"), cell(f"{c}max"))

    def placed(corner: bool, xs: Column, ys: Column, side: str) -> DataFrame:
        cells = boxes.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
        return cells.select(F.lit(corner).alias("_corner"), "_cx", "_cy", *(F.col(c).alias(f"{side}.{c}") for c in boxes.columns))

    left = placed(True, at("x"), at("y"), "l").unionAll(placed(False, at("x"), span("y"), "l"))
    right = placed(True, span("x"), span("y"), "r").unionAll(placed(False, span("x"), at("y"), "r"))
    l, r = (lambda c: F.col(f"`l.{c}`")), (lambda c: F.col(f"`r.{c}`"))
    behind = lambda c: (l(c) > r(c)) | ((l(c) == r(c)) & (l("fid") > r("fid")))
    meet = (r("xmax") >= l("xmin")) & (r("xmin") <= l("xmax")) & (r("ymax") >= l("ymin")) & (r("ymin") <= l("ymax"))
    # dealt out by cells even where a side is small enough to be sent to all: the pairs are the work
    met = left.join(right.hint("merge"), ["_corner", "_cx", "_cy"]).where(meet & behind("xmin") & (behind("ymin") == F.col("_corner")) & (l("fid") != r("fid")))
    first = l("fid") < r("fid")
    return met.select(F.struct(*(F.when(first, l(c)).otherwise(r(c)).alias(c) for c in boxes.columns)).alias("a"), F.struct(*(F.when(first, r(c)).otherwise(l(c)).alias(c) for c in boxes.columns)).alias("b"))
