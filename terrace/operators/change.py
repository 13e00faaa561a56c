"""What became of units between two versions of a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.graph import _kept, connected_components

MATCH, SAME = 0.8, 0.98


def _unique(rows: DataFrame, value: str, side: str) -> DataFrame:
    """Values that one unit of a side has alone."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min("fid").alias(f"{side}_fid")).where("n = 1").drop("n")


def identity_pairs(a: DataFrame, b: DataFrame, by: tuple[str, ...], mode: str) -> DataFrame:
    """(a_fid, b_fid) with equal values, unique on their sides, in one of the columns ('either') or in all ('both')."""
    found = None
    for column in by:
        one = _unique(a, column, "a").join(_unique(b, column, "b"), "value").select("a_fid", "b_fid")
        found = one if found is None else (found.union(one).distinct() if mode == "either" else found.join(one, ["a_fid", "b_fid"]))
    return found


def _greedy(pairs: DataFrame) -> DataFrame:
    """Pairs taken in the order (a_fid, b_fid), each unless a taken one shares a side: in rounds, a pair is taken once it is first on both of its sides."""
    taken, left = None, _kept(pairs)
    while not left.isEmpty():
        first_a = left.groupBy("a_fid").agg(F.min("b_fid").alias("x"))
        first_b = left.groupBy("b_fid").agg(F.min("a_fid").alias("y"))
        now = _kept(left.join(first_a, "a_fid").join(first_b, "b_fid").where("b_fid = x and a_fid = y").select("a_fid", "b_fid"))
        taken = now if taken is None else taken.unionByName(now)
        left = _kept(left.join(now.select("a_fid"), "a_fid", "left_anti").join(now.select("b_fid"), "b_fid", "left_anti"))
    return pairs.limit(0) if taken is None else taken


def classify(a: DataFrame, b: DataFrame, pairs: DataFrame, link_by: tuple[str, ...] = (), link_mode: str = "either", match: float = MATCH, same: float = SAME) -> tuple[DataFrame, DataFrame]:
    """(units, links): each unit's side, fid, cluster and change class; and the pairs that made the clusters.

    a, b: fid and the columns of link_by. pairs: (a_fid, b_fid, coverage_a, coverage_b, iou). First, units that overlap and share an identity are paired
    if every other unit that either covers in a share of `match` is itself paired by identity; then what is left is joined by coverage. Clusters are connected
    components, classed by their sizes: removed, created, split, merge, complex; and one to one: relocated if identity alone joins them, else by iou
    unchanged, renamed (a linked column changed) or modified.
    """
    near = F.greatest("coverage_a", "coverage_b") >= match
    pairs = _kept(pairs.withColumn("near", F.coalesce(near, F.lit(False))))
    if link_by:
        ident = _kept(pairs.join(identity_pairs(a, b, link_by, link_mode), ["a_fid", "b_fid"], "left_semi").select("a_fid", "b_fid"))
        in_a, in_b = ident.select("a_fid").distinct().withColumn("ia", F.lit(True)), ident.select("b_fid").distinct().withColumn("ib", F.lit(True))
        spatial = pairs.where("near").select("a_fid", "b_fid").join(in_a, "a_fid", "left").join(in_b, "b_fid", "left")
        # units that a neighbour without an identity ties down: unless that neighbour is the pair's own other side, which has one
        held_a = spatial.where("ib is null").select("a_fid").distinct()
        held_b = spatial.where("ia is null").select("b_fid").distinct()
        claimed = _kept(_greedy(ident.join(held_a, "a_fid", "left_anti").join(held_b, "b_fid", "left_anti")))
        rescued = pairs.join(claimed, ["a_fid", "b_fid"]).withColumn("rescued", ~F.col("near"))
        rest = pairs.where("near").join(claimed.select("a_fid"), "a_fid", "left_anti").join(claimed.select("b_fid"), "b_fid", "left_anti").withColumn("rescued", F.lit(False))
        passing = _kept(rescued.unionByName(rest))
    else:
        passing = _kept(pairs.where("near").withColumn("rescued", F.lit(False)))
    changed: Column = F.lit(False)
    attrs = passing
    if link_by:
        attrs = passing.join(a.select(F.col("fid").alias("a_fid"), *(F.col(c).alias(f"a_{c}") for c in link_by)), "a_fid").join(b.select(F.col("fid").alias("b_fid"), *(F.col(c).alias(f"b_{c}") for c in link_by)), "b_fid")
        for c in link_by:
            changed = changed | F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))
    attrs = attrs.withColumn("changed", changed)
    node = lambda df, fid, side: df.select((F.col(fid) * 2 + side).alias("node"))
    nodes = node(a, "fid", 0).union(node(b, "fid", 1))
    roots = connected_components(nodes, passing.select((F.col("a_fid") * 2).alias("a"), (F.col("b_fid") * 2 + 1).alias("b")))
    links = attrs.join(roots, F.col("a_fid") * 2 == F.col("node")).select("root", "a_fid", "b_fid", "coverage_a", "coverage_b", "iou", "rescued", "changed")
    facts = links.groupBy("root").agg(F.max("iou").alias("iou"), F.bool_and("rescued").alias("rescued"), F.bool_or("changed").alias("changed"))
    sizes = roots.groupBy("root").agg(F.count_if(F.col("node") % 2 == 0).alias("na"), F.count_if(F.col("node") % 2 == 1).alias("nb"))
    one = F.when(F.coalesce("rescued", F.lit(False)), "relocated").when(F.coalesce("iou", F.lit(0.0)) < same, "modified").when(F.coalesce("changed", F.lit(False)), "renamed").otherwise("unchanged")
    kind = F.when((F.col("na") == 1) & (F.col("nb") == 1), one).when(F.col("nb") == 0, "removed").when(F.col("na") == 0, "created").when(F.col("na") == 1, "split").when(F.col("nb") == 1, "merge").otherwise("complex")
    classes = sizes.join(facts, "root", "left").select("root", kind.alias("change"))
    units = roots.join(classes, "root").select(F.when(F.col("node") % 2 == 0, "a").otherwise("b").alias("side"), F.expr("node div 2").alias("fid"), F.col("root").alias("cluster"), "change")
    return units, links.join(classes, "root").withColumnRenamed("root", "cluster")


def changelog(a: DataFrame, b: DataFrame, units: DataFrame, links: DataFrame, code: str, match: float = MATCH, same: float = SAME) -> DataFrame:
    """One row for each link, and for each unit without one: change, both codes, ratios to three places, and the thresholds."""
    ca, cb = a.select(F.col("fid").alias("a_fid"), F.col(code).alias("code_a")), b.select(F.col("fid").alias("b_fid"), F.col(code).alias("code_b"))
    rows = links.join(ca, "a_fid").join(cb, "b_fid").select("change", "code_a", "code_b", *(F.round(c, 3).alias(c) for c in ("coverage_a", "coverage_b", "iou")))
    gone = units.where("change = 'removed'").join(ca, units["fid"] == ca["a_fid"]).select("change", "code_a")
    new = units.where("change = 'created'").join(cb, units["fid"] == cb["b_fid"]).select("change", "code_b")
    rows = rows.unionByName(gone, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    return rows.withColumns({"tau_match": F.lit(match), "tau_same": F.lit(same)})


def changed_layer(a: DataFrame, b: DataFrame, units: DataFrame) -> DataFrame:
    """All new units and the old ones that are gone, each with its change."""
    side = lambda df, s, where: df.join(units.where(f"side = '{s}' and ({where})").select(F.col("fid").alias("_f"), "change"), df["fid"] == F.col("_f")).drop("_f")
    return side(b, "b", "true").unionByName(side(a, "a", "change = 'removed'"), allowMissingColumns=True)
