import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import bitslice, embeddings

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [0.0, 0.0], 1), (9003, [NAN, 1.0], 1), (9004, [1.0, INF], 1), (9005, [1.0, None], 1), (9006, [], 1), (9007, [1.0, 0.0], None), (9008, [1.0, 0.0], None)]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, cls int")


def _clusters(seed, dim=16):
    rng, rows = np.random.default_rng(seed), []
    for c in range(40):
        center = rng.standard_normal(dim)
        for _ in range(1 + c % 9):
            rows.append((center + rng.standard_normal(dim) * 0.15).tolist())
    rows += rows[:5] * 3
    return [(i, [float(np.float32(x)) for x in r], i % 2) for i, r in enumerate(rows)]


def test_near_vectors_against_all_pairs(frame):
    rows = _clusters(7)
    v = np.array([r[1] for r in rows])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    alike = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(alike, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame(rows + ODD)).collect()}
    found = np.array([got[r[0]].n_links for r in rows])
    assert (found <= alike.sum(1)).all() and found.sum() >= 0.9 * alike.sum()
    root = {i: i for i in range(len(rows))}
    for i in range(len(rows)):
        for j in np.flatnonzero(alike[i]):
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    for i in range(len(rows)):
        a = i
        while root[a] != a:
            a = root[a]
        assert got[i].component_id == a and got[i].kept == (a == i)
    for vec_id, *_ in ODD:
        assert (got[vec_id].n_links, got[vec_id].component_id, got[vec_id].kept) == (0, vec_id, True)


def test_near_vectors_without_links_or_rows(frame):
    assert embeddings.near_duplicates(frame([])).count() == 0
    rows = embeddings.near_duplicates(frame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(1, 1, 1), (2, 0, 2), (2, 1, 1), (3, 0, 3)]


def test_many_near_copies_are_counted_in_blocks(frame):
    rng = np.random.default_rng(1)
    rows = [(i, (np.array([3.0, 4.0, 0.0]) + rng.standard_normal(3) * 0.01).tolist(), 0) for i in range(300)]
    got = embeddings.near_duplicates(frame(rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def _plain_top(rows, k):
    q = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v, _ in rows}
    out = set()
    for i in q:
        if i % 20 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k_against_all_pairs(frame):
    for rows, k in ((_clusters(3), 20), (_clusters(4, dim=3), 5), (_clusters(5)[:4], 20), ([(i, [1.0, -0.5], 0) for i in range(60)], 7)):
        got = bitslice.top_k(frame(rows + [o for o in ODD if o[0] < 9007]), F.col("vec_id") % 20 == 0, k=k)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == _plain_top(rows, k)


def test_top_k_without_rows_and_with_repeats(frame):
    assert bitslice.top_k(frame([]), F.col("vec_id") % 20 == 0).count() == 0
    asked = lambda rows, **k: [tuple(r) for r in bitslice.top_k(frame(rows), F.col("vec_id") % 20 == 0, **k).orderBy("query_id", "rank").collect()]
    rows = [(0, [1.0], 0), (1, [0.5], 0), (1, [0.9], 0), (1, [0.9], 0)]
    assert asked(rows) == [(0, 1, 1, 57 * 64), (0, 2, 1, 57 * 64), (0, 3, 1, 2048)]
    # each row of a repeated query id asks, none is its own candidate
    assert asked([(0, [1.0], 0), (0, [2.0], 0), (1, [0.5], 0)]) == [(0, 1, 1, 4096), (0, 2, 1, 2048)]


def test_top_k_of_large_components(frame):
    rows = [(0, [1.0, 0.0], 0), (1, [1e9, 1.0], 0), (2, [-1e9, 1.0], 0), (3, [2.0, 0.0], 0), (20, [1e9, -3e38], 0)]
    big = int(np.floor(64 * float(np.float32(1e9))))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bitslice.top_k(frame(rows), F.col("vec_id") % 20 == 0, k=3).collect()}
    assert [got[0, r] for r in (1, 2, 3)] == [(1, 64 * big), (20, 64 * big), (3, 64 * 128)]
    assert [got[20, r] for r in (1, 2, 3)] == [(3, 128 * big), (0, 64 * big), (1, -(1 << 63))]


def test_a_repeated_id_has_links_of_each_row_alone(frame):
    a, b = [1.0, 0.0], [0.0, 1.0]
    got = embeddings.near_duplicates(frame([(5, a, 1), (5, b, 1), (7, [1.0, 0.1], 1), (8, [0.1, 1.0], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5)]


def test_isolated_pairs_in_a_dense_label_are_found(frame):
    rng = np.random.default_rng(5)
    dim, n, pairs = 32, 3000, 60
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    draw = lambda n: rng.standard_normal((n, dim)) / np.sqrt(dim)
    own = draw(n)
    own[:pairs] = own[pairs : 2 * pairs] + 0.55 * draw(pairs)
    x = (np.sqrt(0.8) * centre + np.sqrt(0.2) * own).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    alike = unit @ unit.T >= 0.93
    np.fill_diagonal(alike, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame([(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    assert pairs <= alike.sum() and sum(got.values()) >= 0.9 * alike.sum()
    assert all(got[i] <= alike[i].sum() for i in range(n))
