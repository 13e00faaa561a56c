"""SimHash near-duplicates, exact within a Hamming radius, through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm._common import cut, over_batches, small_batches
from terrace.llm.graph import components

#: Shingles whose bits are counted at once: a byte holds each count.
_AT_ONCE = 255


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 values (seed 42) of the text's word shingles, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than a shingle has: the whole sequence
    is one shingle. No words, or a null text: 0.
    """
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _AT_ONCE):
        bits = np.unpackbits(h[k : k + _AT_ONCE].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): every document's fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def f(b: dict[str, list]) -> dict[str, list]:
        fp = np.array([fingerprint(t, words) for t in b["text"]], np.uint64).view(np.int64)
        return {"doc_id": b["doc_id"], "fp": fp}

    return over_batches(docs.select("doc_id", "text"), f, "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree that deals fingerprints to shards.

    A node has a point and a distance: nearer fingerprints go in, others out. Two fingerprints within `radius` that a node
    parts differ by at most `radius` in their distance to its point, by the triangle bound. So copying only the inner side's
    outermost band outwards keeps every such pair together in some shard; branches beyond the bound are pruned.
    """

    def __init__(self, sample: np.ndarray, shards: int, radius: int) -> None:
        self.radius, self.nodes, self.leaves = radius, {}, 0
        self._grow(sample, 0, shards)

    def _grow(self, points: np.ndarray, node: int, shards: int) -> None:
        point, cut_at = vantage(points) if shards > 1 else (None, None)
        if point is None:
            self.nodes[node] = self.leaves
            self.leaves += 1
            return
        self.nodes[node] = (point, cut_at)
        near = _distance(points, point) <= cut_at
        self._grow(points[near], 2 * node + 1, shards // 2)
        self._grow(points[~near], 2 * node + 2, shards - shards // 2)

    def deal(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places in fp) of all shards that get some."""
        todo = [(0, np.arange(len(fp)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(self.nodes[node], int):
                yield self.nodes[node], at
                continue
            point, cut_at = self.nodes[node]
            d = _distance(fp[at], point)
            todo += [(2 * node + 1, at[d <= cut_at]), (2 * node + 2, at[d > cut_at - self.radius])]


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | tuple[None, None]:
    """A point and a distance that part the points best of a few tried: halves of like size, few in the band that is copied. None if nothing parts them."""
    best, found = 0.0, (None, None)
    for point in points[np.linspace(0, len(points) - 1, min(len(points), 8)).astype(int)]:
        seen = np.bincount(_distance(points, point), minlength=65).cumsum()
        inner = seen[:64]
        worth = np.minimum(inner, len(points) - inner) / np.maximum(1, len(points) + inner - np.concatenate([np.zeros(2, int), inner[:-2]]))
        k = int(worth.argmax())
        if worth[k] > best:
            best, found = worth[k], (np.uint64(point), k)
    return found


def near_links(fp: np.ndarray, radius: int, leaf: int = 384) -> list[tuple[int, int]]:
    """Links that join all of a shard's fingerprints within radius, found in a vantage-point tree: a spanning forest, not all pairs."""
    parent = np.arange(len(fp))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, todo = [], [np.arange(len(fp))]
    while todo:
        at = todo.pop()
        if len(at) > leaf:
            point, cut_at = vantage(fp[at])
            if point is not None:
                d = _distance(fp[at], point)
                inner, outer = at[d <= cut_at], at[d > cut_at - radius]
                if max(len(inner), len(outer)) <= 0.95 * len(at):
                    todo += [inner, outer]
                    continue
        for k in range(0, len(at), 512):
            rows = at[k : k + 512]
            i, j = np.nonzero(_distance(fp[rows][:, None], fp[at[k:]][None, :]) <= radius)
            for x, y in zip(rows[i[i < j]].tolist(), at[k:][j[i < j]].tolist()):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((x, y))
    return links


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, shard_rows: int = 4096, sample_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): classes of documents linked by fingerprints at most `radius` bits apart.

    Exact: every pair of distinct fingerprints within the radius meets in a shard and is compared or pruned by a triangle
    bound. Copies share a fingerprint and are pre-aggregated; the tree is fitted on at most `sample_rows` distinct
    fingerprints (that sets balance only). component_id is the smallest doc_id reachable, the document's own included.
    Null and empty texts have fingerprint 0 and link like any other; long texts are hashed in blocks. Rows that repeat a doc_id give a row each; a null
    doc_id is a member that gives no component_id, which is null where a class has no other. Other
    columns are ignored. An empty table gives an empty result.
    """
    each, _ = cut(fingerprints(docs, words), "fp")
    distinct, _ = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    n = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("fp").collect()], np.int64).view(np.uint64)
    tree = Tree(sample, max(1, -(-n // shard_rows)), radius) if len(sample) else None

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            fp = x["fp"].to_numpy(np.int64)
            for shard, at in tree.deal(fp.view(np.uint64)):
                yield pd.DataFrame({"shard": shard, "fp": fp[at]})

    def link(x: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(x["fp"].to_numpy(np.int64))
        return pd.DataFrame([(fp[a], fp[b]) for a, b in near_links(fp.view(np.uint64), radius)], columns=["a", "b"], dtype="int64")

    if tree is None:
        return each.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    edges = distinct.select("fp").mapInPandas(deal, "shard int, fp long").groupBy("shard").applyInPandas(link, "a long, b long")
    roots = components(edges).select(F.col("node").alias("fp"), "root")
    classes, _ = cut(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "fp")
    firsts, _ = cut(classes.groupBy("root").agg(F.min("first").alias("component_id")), "fp")
    classes, _ = cut(classes.join(firsts, "root").select("fp", "component_id"), "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
