"""Exact top-k inner products through a bit-sliced index."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the index, queries of a block of queries, and the least number of pairs of blocks.
BLOCK_ROWS, QUERY_ROWS, PAIRS = 8_192, 16_384, 16
#: Vectors with a component of this size or more are scored by whole numbers of any length, not by slices.
MOST = 1 << 27
_LEAST_LONG, _MOST_LONG = -(1 << 63), (1 << 63) - 1


def finite(v: Column) -> Column:
    """Whether a vector is there, has components, and all of them are numbers."""
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Index:
    """Bitmaps over a block's rows: one for each component's each bit, from the least value up."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.n = rows, len(rows)
        self.words = -(-self.n // 64)
        self.low = int(rows.min())
        up = (rows - self.low).astype(np.uint64)
        self.bits = max(1, int(up.max()).bit_length())
        self.valid = self._bitmap(np.ones((1, self.n), bool))[0]
        planes = np.concatenate([((up >> np.uint64(b)) & np.uint64(1)).astype(bool).T[:, None] for b in range(self.bits)], axis=1)
        own = self._bitmap(planes.reshape(-1, self.n)).reshape(rows.shape[1], self.bits, self.words)
        self.slices = np.stack([own, ~own & self.valid])  # of the value, and of what is left to the largest

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.words * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices, least bit first, of the inner products less a constant: components' slices, shifted by the query's bits, added by carry-save steps on whole bitmaps."""
        size, sign = np.abs(query), (query < 0).astype(int)
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            at = np.flatnonzero(size >> j & 1)
            for b in range(self.bits if len(at) else 0):
                columns.setdefault(j + b, []).append(self.slices[sign[at], at, b])
        out, w = [], 0
        while columns and w <= max(columns):
            x = np.concatenate(columns[w]) if w in columns else np.zeros((1, self.words), np.uint64)
            carried = columns.setdefault(w + 1, []) if len(x) > 1 else []
            while len(x) > 1:
                k = len(x) // 3
                if k:
                    a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                    half = a ^ b
                    carried.append((a & b) | (c & half))
                    x = np.concatenate([half ^ c, x[3 * k :]])
                else:
                    carried.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            out.append(x[0])
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, but: np.ndarray | tuple[int, ...] = ()) -> np.ndarray:
        """Places of the k rows with the largest inner products, of equal ones the first; `but`: places that are left out.

        From the most significant slice down, rows are certain once those with the bit set fit in; what remains open after the last
        slice has one score, and its first rows fill up.
        """
        sure, open_ = np.zeros(self.words, np.uint64), self.valid.copy()
        for place in but:
            open_[place // 64] &= ~np.uint64(1 << (int(place) % 64))
        have = 0
        for s in reversed(self.sums(query)):
            more = open_ & s
            n = int(np.bitwise_count(more).sum())
            if have + n > k:
                open_ = more
            else:
                sure, open_, have = sure | more, open_ & ~s, have + n
                if have == k:
                    break
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        return np.concatenate([places(sure), places(open_)[: k - have]])


def _rows(x: pd.DataFrame, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of whole numbers as doubles), by id."""
    x = x.sort_values("vec_id", kind="stable")
    with np.errstate(over="ignore"):
        return x["vec_id"].to_numpy(np.int64), np.floor(scale * np.stack(x["v"].to_numpy()).astype(np.float64))


def _whole(x: np.ndarray) -> list[list[int]]:
    """Whole numbers of any length; an infinite one, of a component that overflows when scaled, counts as the largest double."""
    return [[int(c) for c in row] for row in np.nan_to_num(x).tolist()]


def _best(queries: np.ndarray, w: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[np.ndarray]:
    """(query_id, vec_id, score) columns of each query's k best rows, by whole numbers of any length."""
    out, rows = [], _whole(v)
    for query_id, query in zip(queries.tolist(), _whole(w)):
        scores = [(-sum(a * b for a, b in zip(query, row)), i) for i, row in zip(ids.tolist(), rows) if i != query_id]
        out += [np.array([[query_id], [i], [min(max(-s, _LEAST_LONG), _MOST_LONG)]], np.int64) for s, i in heapq.nsmallest(k, scores)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest inner products of floor(scale * x), ties to the smaller vec_id.

    vectors: vec_id, embedding. Candidates are all rows with another vec_id; fewer give fewer. Exact: every block of rows is indexed
    and asked by every block of queries, and the blocks' best are ranked together; no block pair needs more than its bounded rows.
    Vectors that are null or empty, or hold null or non-finite components, take no part. Those with a component of MOST or more after scaling
    are scored apart by whole numbers of any length; a score beyond a long's range is given as its end. Vectors of unlike
    lengths aren't compared. Each row that repeats a vec_id is a candidate of its own; the rows of a repeated query id give its k best together.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).withColumn("dim", F.size("v"))
    n, q = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-n // BLOCK_ROWS))
    parts = max(1, -(-q // QUERY_ROWS), -(-PAIRS // blocks))
    block, part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
    held = rows.select("vec_id", "v", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = rows.where("asks").select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"))

    def answer(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            (ids, v), (queries, w) = _rows(held, scale), _rows(asked, scale)
            few, plain = np.abs(v).max(axis=1) < MOST, np.abs(w).max(axis=1) < MOST
            out += _best(queries[~plain], w[~plain], ids, v, k)
            if not few.all():
                out += _best(queries[plain], w[plain], ids[~few], v[~few], k)
            ids, v, queries, w = ids[few], v[few].astype(np.int64), queries[plain], w[plain].astype(np.int64)
            index = Index(v) if len(v) else None
            for query_id, query in zip(queries.tolist(), w) if index else ():
                own = range(*np.searchsorted(ids, [query_id, query_id + 1]).tolist())
                best = index.top(query, k, own)
                out.append(np.stack([np.full(len(best), query_id), ids[best], v[best] @ query]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ("block", "part", "dim")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
