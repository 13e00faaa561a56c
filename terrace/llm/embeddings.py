"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm._common import cut, discard
from terrace.llm.bitslice import finite
from terrace.llm.graph import components

#: Members of a component that are counted at once: blocks of the first size while a component has up to SPLIT of them, else of the second.
COUNT_ROWS, SPLIT, COUNT_ROWS_LARGE = 128, 16_384, 4_096


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosine(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one cosine that decides: the same number for a pair wherever it is met, and whichever comes first."""
    return np.einsum("ij,ij->i", unit[a], unit[b])


def signatures(unit: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """For each pass the vectors' concatenated random hashes, each the side of a random plane; as unsigned numbers, the first hash on top."""
    planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], passes * bits))
    sides = (unit @ planes > 0).reshape(len(unit), passes, bits)
    return (sides << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the given pairs join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _near(run: np.ndarray, ids: np.ndarray, unit: np.ndarray, window: int, least: float, beyond: int = 0) -> np.ndarray:
    """Pairs at most `window` apart in order, in one run, with cosine at least `least`; beyond: only pairs across this place."""
    out = []
    for w in range(1, min(window, len(ids) - 1) + 1):
        i = np.flatnonzero(run[:-w] == run[w:])
        if beyond:
            i = i[(i < beyond) & (i + w >= beyond)]
        i = i[_cosine(unit, i, i + w) >= least]
        out.append(np.stack([ids[i], ids[i + w]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def links(classes: DataFrame, least: float, passes: int, bits: int, window: int, seed: int) -> tuple[DataFrame, str]:
    """(a, b): verified pairs of classes (cls, label, dim, v, centre) that stand near each other in some pass's order; and the table they are read from.

    All passes are one table in one global order, dealt out by ranges; each task slides the window over its rows. The first and
    last rows of each range meet those of the next in a second, small step.
    """
    spark = classes.sparkSession

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for _, g in x.groupby("dim"):
                s = signatures(_units(g["v"]) - np.stack(g["centre"].to_numpy()), passes, bits, seed)
                for p in range(passes):
                    yield pd.DataFrame({"pass": p, "dim": g["dim"], "label": g["label"], "sign": (s[:, p] >> np.uint64(1)).astype(np.int64), "cls": g["cls"], "v": g["v"]})

    kind = classes.schema["v"].dataType.simpleString()
    signed, at = cut(classes.mapInPandas(sign, f"pass int, dim int, label string, sign long, cls long, v {kind}"), "signed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("pass", "dim", "label", "sign", "cls")
    ranged = signed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    out = f"a long, b long, edge int, side int, place int, pass int, dim int, label string, cls long, v {kind}"

    def slide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, number, first = None, 0, 0
        part = -1
        for x in frames:
            part = int(x["part"].iloc[0])
            head = x.iloc[: max(0, window - first)]
            if len(head):
                yield pd.DataFrame({"edge": part - 1, "side": 1, "place": np.arange(first, first + len(head)), **{c: head[c].to_numpy() for c in ("pass", "dim", "label", "cls", "v")}}).reindex(columns=names).astype({"a": "Int64", "b": "Int64"})
                first += len(head)
            both = x if tail is None else pd.concat([tail, x], ignore_index=True)
            found = []
            for _, g in both.groupby("dim", sort=False):
                run = g.groupby(["pass", "label"], sort=False).ngroup().to_numpy()
                found.append(_near(run, g["cls"].to_numpy(), _units(g["v"]), window, least))
            found = _forest(np.concatenate(found))
            if found:
                pairs = pd.DataFrame(found, columns=["a", "b"]).reindex(columns=names).astype({c: "Int32" for c in ("edge", "side", "place", "pass", "dim")} | {"cls": "Int64"})
                yield pairs.assign(**{c: pd.Series([None] * len(pairs), dtype=object) for c in ("label", "v")})
            tail = both.iloc[-window:]
            number += len(x)
        if tail is not None:
            yield pd.DataFrame({"edge": part, "side": 0, "place": np.arange(len(tail)), **{c: tail[c].to_numpy() for c in ("pass", "dim", "label", "cls", "v")}}).reindex(columns=names).astype({"a": "Int64", "b": "Int64"})

    names = [c.split()[0] for c in out.split(", ")]
    slid, slid_at = cut(ranged.mapInPandas(slide, out), "slid")
    discard(spark, at)

    def across(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["side", "place"], kind="stable")
        found = []
        for _, g in x.groupby("dim", sort=False):
            run = g.groupby(["pass", "label"], sort=False).ngroup().to_numpy()
            found.append(_near(run, g["cls"].to_numpy(), _units(g["v"]), window, least, beyond=int((g["side"] == 0).sum())) if g["side"].nunique() == 2 else np.zeros((0, 2), np.int64))
        return pd.DataFrame(_forest(np.concatenate(found)), columns=["a", "b"], dtype="int64")

    edges = slid.where("edge is not null").drop("a", "b").groupBy("edge").applyInPandas(across, "a long, b long")
    found = cut(slid.where("a is not null").select("a", "b").unionAll(edges), "links")
    discard(spark, slid_at)
    return found


def _centres(classes: DataFrame) -> DataFrame:
    """(label, dim, centre): the mean of the vectors' directions. Random planes through it part what is dense around it."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for (label, dim), g in x.groupby(["label", "dim"]):
                yield pd.DataFrame({"label": label, "dim": dim, "place": np.arange(dim), "total": _units(g["v"]).sum(axis=0), "n": len(g)})

    parts = classes.mapInPandas(sums, "label string, dim int, place int, total double, n long")
    means = parts.groupBy("label", "dim", "place").agg((F.sum("total") / F.sum("n")).alias("mean"))
    pairs = F.array_sort(F.collect_list(F.struct("place", "mean")))
    return means.groupBy("label", "dim").agg(F.transform(pairs, lambda x: x["mean"]).alias("centre"))


def _counts(members: DataFrame, least: float) -> DataFrame:
    """(cls, linked): how many vectors each class's are linked to in its component, counted exactly by blocks. members: root, cls, n, dim, v."""
    sizes = members.groupBy("root").agg(F.count("*").alias("m"))
    sizes, at = cut(sizes.withColumn("blocks", F.when(F.col("m") <= SPLIT, F.ceil(F.col("m") / COUNT_ROWS)).otherwise(F.ceil(F.col("m") / COUNT_ROWS_LARGE)).cast("int")), "sizes")
    few = F.greatest(F.lit(1), F.ceil(F.sum("m") / 64)).cast("long")
    groups = sizes.agg(F.coalesce(few, F.lit(1)).alias("g")).first().g
    x = members.join(sizes.select(F.col("root"), "blocks"), "root")
    x = x.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.col("root")))
    x = x.select("root", "cls", "n", "v", "own", "group", (F.col("blocks") > 1).alias("split"), F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def count(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in x.groupby("root", sort=False):
            unit, n, cls = _units(g["v"]), g["n"].to_numpy(), g["cls"].to_numpy()
            one, two = (np.flatnonzero(g["own"] == g[c]) for c in ("one", "two"))
            same = g["one"].iloc[0] == g["two"].iloc[0]
            product = unit[one] @ unit[two].T
            alike = product >= least
            i, j = np.nonzero(np.abs(product - least) < 1e-9)  # where rounding may decide
            alike[i, j] = _cosine(unit, one[i], two[j]) >= least
            if same:
                np.fill_diagonal(alike, False)
            out.append(pd.DataFrame({"cls": cls[one], "linked": alike @ n[two]}))
            if not same:
                out.append(pd.DataFrame({"cls": cls[two], "linked": n[one] @ alike}))
        return pd.concat(out)

    counted, _ = cut(x.groupBy("group", "split", "one", "two").applyInPandas(count, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked")), "counted")
    discard(members.sparkSession, at)
    return counted


def near_duplicates(vectors: DataFrame, least: float = 0.93, passes: int = 24, bits: int = 63, window: int = 48, seed: int = 11, round_passes: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of equal, non-null label whose cosine, in double precision, is at least `least`.

    A pass orders the distinct vectors by concatenated random hashes, sides of planes through their label's mean direction, and compares each with the `window` next
    ones. Passes go in rounds of `round_passes`: `passes` of them at least, and then until a whole round joins no two
    components any more, so dense labels get as many as they need. Verified pairs of all passes are united into components. Within a component all links
    are then counted exactly, by blocks, so the window bounds no vector's links; a link is missed only if no pass and no path of other links
    joins its ends (the recall that tests measure). No link is below `least`.
    n_links: other vectors linked directly, copies included; component_id: the smallest vec_id reachable, the vector's own included;
    kept: vec_id = component_id. Equal vectors are one class and aren't expanded into pairs. Vectors that are null, empty or zero, or hold
    null or non-finite components, and those with a null label or vec_id, link with nothing; so do vectors of unlike lengths. Rows that repeat a
    vec_id count as vectors of their own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), usable.alias("usable"))
    key = [F.col("label"), F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    keyed = rows.where("usable").select("vec_id", *key, "v")
    names = ("label", "dim", "k1", "k2")
    grouped = keyed.groupBy(*names).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("v").alias("v"))
    # a number of its own for each class, fixed as it is written
    classes, classes_at = cut(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    centred, centred_at = cut(classes.join(_centres(classes), ["label", "dim"]).select("cls", "label", "dim", "v", "centre"), "centred")
    edges, done, paths = None, 0, [classes_at, centred_at]
    while True:
        found, at = links(centred, least, round_passes, bits, window, seed + done)
        paths.append(at)
        done += round_passes
        if done > passes:
            a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
            apart = found.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
            if apart.isEmpty():
                break
        edges = found if edges is None else edges.unionAll(found)
        if done >= passes:
            roots, at = cut(components(edges), "roots")
            paths.append(at)
    roots = roots.select(F.col("node").alias("cls"), "root")
    members = classes.join(roots, "cls")
    counted = _counts(members.select("root", "cls", "n", "dim", "v"), least)
    smallest = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = roots.join(smallest, "root").select("cls", "component_id")
    result = classes.select(*names, "cls", "n", "least_id").join(of, "cls", "left").join(counted, "cls", "left")
    result, _ = cut(result.select(*names, (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "classes")
    discard(spark, *paths)
    linked = keyed.drop("v").join(result, list(names)).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
