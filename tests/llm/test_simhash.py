import random
import re

import numpy as np
import xxhash

from terrace.llm import simhash
from terrace.llm.graph import components
from tests.llm.conftest import ODD_TEXTS


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    first = {}
    for i, f in zip(ids, fps):
        first[find(f)] = min(i, first.get(find(f), i))
    return {i: first[find(f)] for i, f in zip(ids, fps)}


def test_fingerprints_and_classes_against_all_pairs(docs):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = list(ODD_TEXTS)
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 400))]
        texts += [" ".join(t), " ".join(t + [rng.choice(words)]), " ".join(t)]
    got = simhash.near_duplicates(docs(texts)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in got} == classes(range(len(texts)), fps, 2)


def test_trees_lose_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (4, 2))]))
    tree = simhash.Tree(fp[::3], 16, 2)
    shards = list(tree.deal(fp))
    near = [(a, b) for a in range(len(fp)) for b in range(a) if bin(int(fp[a] ^ fp[b])).count("1") <= 2]
    for a, b in near:
        assert any(a in s and b in s for s in (set(at.tolist()) for _, at in shards))
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.near_links(fp, 2, leaf=16):
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in near)


def test_repeated_and_no_rows(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    rows = simhash.near_duplicates(docs(["a b c", "a b c", "A B C"], ids=[7, 7, 9])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(7, 7), (7, 7), (9, 7)]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 90, 95: 90, 90: 90}
    assert components(edges.where("a = 5 and b = 5")).count() == 0
