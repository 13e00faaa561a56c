import random

import numpy as np

from terrace.llm import substring
from tests.llm.conftest import ODD_TEXTS


def test_compact_windows_against_plain_search():
    rng = np.random.default_rng(1)
    for n, width, kinds in ((1, 1, 5), (60, 5, 10**6), (300, 20, 10**6), (50, 4, 7), (3, 5, 9)):
        x = (rng.integers(0, kinds, n).astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        want = {}
        for a in range(n - width + 1):
            place = a + int(x[a : a + width].argmin())
            first, _ = want.get(place, (a, a))
            want[place] = (first, a + width - 1)
        got = substring.compact_windows(x, width)
        assert sorted(zip(*(v.tolist() for v in got))) == sorted((p, a, b) for p, (a, b) in want.items())
        # each is a node of the Cartesian tree: nothing less inside, and its span is cut at a lesser value, at the border or at width - 1
        for p, a, b in zip(*(v.tolist() for v in got)):
            assert x[a : b + 1].min() == x[p]
            assert a in (0, p - width + 1) or x[a - 1] < x[p]
            assert b in (n - 1, p + width - 1) or x[b + 1] < x[p]


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    texts = ["One two  THREE four five six", "", None, "x one two three four five", "four\tfive", "a\x00 a \u00e9 " * 40]
    monkeypatch.setattr(substring, "_BYTES", 1 << 20)
    whole, begin, n = substring.sequence(texts, 2)
    assert n.tolist() == [5, 0, 0, 5, 1, 119]
    monkeypatch.setattr(substring, "_BYTES", 16)
    cut, begin2, n2 = substring.sequence(texts, 2)
    assert n2.tolist() == n.tolist() and begin2.tolist() == begin.tolist()
    kinds = {}
    for k, text in enumerate(texts):
        words = substring.words_of(text)
        for i in range(n[k]):
            assert whole[begin[k] + i] == cut[begin[k] + i]
            assert kinds.setdefault(tuple(words[i : i + 2]), whole[begin[k] + i]) == whole[begin[k] + i]
    assert len(set(kinds.values())) == len(kinds)


def _texts(rng):
    word = lambda: f"w{rng.randrange(100000)}"
    fresh = lambda n: [word() for _ in range(n)]
    shared = fresh(70)
    texts, repeats = [], {}
    for k in range(60):
        t = fresh(rng.randrange(20, 300))
        if k % 3 == 0:
            at = rng.randrange(len(t) + 1)
            own = list(shared)
            if k % 2:
                own[35] = "changed"  # 65 of 71 shingles stay
            t[at:at] = own
            repeats[k] = (at, at + 70)
        texts.append(" ".join(t))
    return texts, repeats


def test_finds_planted_passages_alone(docs):
    texts, repeats = _texts(random.Random(5))
    got = substring.near_passages(docs(texts + ODD_TEXTS)).collect()
    found = {k: (min(r.begin for r in got if r.doc_id == k), max(r.end for r in got if r.doc_id == k)) for k in {r.doc_id for r in got} if k < 60}  # rows with one earlier document may hold a part
    assert set(found) == set(repeats) - {0}
    for k, (begin, end) in found.items():
        assert abs(begin - repeats[k][0]) <= 5 and abs(end - repeats[k][1]) <= 5
    assert all(r.first_id in repeats and r.first_id < r.doc_id and r.similarity >= 0.8 for r in got if r.doc_id < 60)


def test_drop_repeats_keeps_the_first_and_all_else(docs):
    texts, repeats = _texts(random.Random(6))
    frame = docs(texts + [None, ""])
    got = {r.doc_id: r for r in substring.drop_repeats(frame).collect()}
    assert len(got) == 62 and set(got[0].asDict()) == set(frame.columns)
    for k, text in enumerate(texts):
        if k in repeats and k > 0:
            assert len(got[k].text.split()) <= len(text.split()) - 65
        else:
            assert got[k].text == text
    assert got[60].text is None and got[61].text == ""


def test_whole_copies_and_no_rows(docs):
    text = " ".join(f"v{k}" for k in range(120))
    got = substring.near_passages(docs([text, "short one", text, text], ids=[3, 4, 5, 5])).collect()
    assert {(r.doc_id, r.begin, r.end, r.first_id) for r in got} == {(5, 0, 120, 3)}
    assert [r.doc_id for r in substring.drop_repeats(docs([text, text])).collect()] == [0]
    assert substring.near_passages(docs([])).count() == 0


def test_partly_matching_earlier_documents_hide_no_repeat(docs):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, want = [], set()
    for k in range(40):
        p = fresh(60)
        at = rng.randrange(25)
        # holds 35 words of the passage, and twice: an earlier place of one document is no match either
        texts.append(" ".join(fresh(60) + p[at : at + 35] + fresh(60) + p[at : at + 35] + fresh(60)))
        texts += [" ".join(fresh(80) + p + fresh(80)) for _ in range(3)]
        want |= {4 * k + 2, 4 * k + 3}
    got = substring.near_passages(docs(texts)).collect()
    assert {r.doc_id for r in got} == want
    assert all(abs(r.begin - 80) <= 1 and abs(r.end - 140) <= 1 for r in got if r.first_id == r.doc_id // 4 * 4 + 1)
    assert all(r.begin >= 79 and r.end <= 141 for r in got)  # with another document that repeats it, a part may show
    assert want == {r.doc_id for r in got if r.first_id == r.doc_id // 4 * 4 + 1}


def test_exact_links_against_plain_search():
    rng = np.random.default_rng(3)
    width, n = 6, 40
    context = rng.integers(1, 3, (n, 2 * width - 1)).astype(np.uint64)
    context[:, width - 1] = 1
    context[::7, : width // 2] = 0
    group = np.repeat([0, 1], n // 2)
    want = set()
    for i in range(n):
        for k in range(width):
            run = context[i, k : k + width]
            same = [j for j in range(i) if run.all() and group[j] == group[i] and (context[j, k : k + width] == run).all()]
            want |= {(i, same[0])} if same else set()
    got = substring.exact_links(group, context, width)
    assert set(zip((got // n).tolist(), (got % n).tolist())) == want


def test_near_links_find_like_runs_and_only_those():
    rng = np.random.default_rng(11)
    width, n = 46, 400
    context = rng.integers(1, 1 << 32, (n, 2 * width - 1)).astype(np.uint64)
    for k in range(1, n, 2):  # a window and a like one: five shingles of one changed word
        context[k] = context[k - 1]
        at = int(rng.integers(0, 80))
        at += 8 * (at <= width - 1 < at + 5)
        context[k, at : at + 5] = rng.integers(1, 1 << 32, 5)
    context[:, width - 1] = 7
    got = substring.near_links(np.zeros(n, np.int64), context, width, 0.8)
    want = {k * n + k - 1 for k in range(1, n, 2)}
    assert set(got.tolist()) <= want and len(got) >= 0.95 * len(want)


def test_a_line_that_stands_before_the_passage_too():
    rng = np.random.default_rng(4)
    wide = 91
    x, y = (rng.integers(1, 1 << 32, (1, wide)).astype(np.uint64) for _ in range(2))
    y[0, 20:76] = x[0, 20:76]
    y[0, 12] = x[0, 22]
    assert [v.tolist() for v in substring.verified(x, y, 46, 0.8)] == [[0], [20], [76], [20], [76], [1.0]]


def _brute(texts, width=46, size=5, similarity=0.8):
    """(later, earlier) documents with a 50-word stretch each whose sets of shingles are alike; and each document's places of 50 words that an earlier one has too."""
    runs = []
    for t in texts:
        w = t.split()
        s = [hash(tuple(w[i : i + size])) for i in range(len(w) - size + 1)]
        runs.append([frozenset(s[i : i + width]) for i in range(len(s) - width + 1)])
    like, same, seen = set(), set(), {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), k) < k:
                same.add((k, i))
        for j in range(k):
            if any(a & b and len(a & b) / len(a | b) >= similarity for a in runs[k] for b in runs[j]):
                like.add((k, j))
    return like, same


def test_against_plain_search(docs):
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = [fresh(56) for _ in range(6)], []
    for k in range(48):
        p = list(shared[k % 6])
        if k >= 12 and k % 3:
            at = rng.randrange(5, 51)
            p[at : at + 1] = fresh(k % 3)
        texts.append(" ".join(fresh(rng.randrange(20)) + p + fresh(rng.randrange(20))))
    period = fresh(17)
    texts += [" ".join(period * 6), " ".join(fresh(9) + period * 7)]
    like, same = _brute(texts)
    got = substring.near_passages(docs(texts)).collect()
    for k, i in same:  # exact repeats are never missed, also of a text that repeats itself
        assert any(r.doc_id == k and r.begin <= i and i + 50 <= r.end for r in got)
    later = {k for k, _ in like}
    found = {r.doc_id for r in got}
    assert found <= later and len(found) >= 0.95 * len(later)
    assert all((r.doc_id, r.first_id) in like for r in got)


def test_overlapping_passages_of_two_documents_are_both_reported(docs):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text = fresh(110)
    texts = [fresh(30) + text[:70] + fresh(30), fresh(40) + text[40:] + fresh(40), text]
    got = substring.near_passages(docs([" ".join(t) for t in texts])).collect()
    rows = {(r.doc_id, r.first_id): r for r in got}
    assert set(rows) == {(2, 0), (2, 1)} and len(got) == 2
    for first, begin, end, at in ((0, 0, 70, 30), (1, 40, 110, 40)):
        r = rows[2, first]
        assert max(abs(x - y) for x, y in ((r.begin, begin), (r.end, end), (r.first_begin, at), (r.first_end, at + 70))) <= 2 and r.similarity >= 0.8


def test_rows_that_share_a_doc_id_but_no_text_stay(docs):
    rng = random.Random(31)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    text, other = fresh(80), fresh(80)
    frame = docs([text, other, text, text, text], ids=[1, 4, 4, 5, None])
    got = sorted((r.doc_id or 0, r.text) for r in substring.drop_repeats(frame).collect())
    assert got == sorted([(1, text), (4, other), (4, text), (0, text)])


def test_without():
    assert substring.without("a  b\nc d", [(1, 3)]) == "a  d"
    assert substring.without("a b", [(0, 2)]) == ""


def test_keys_of_many_windows_lose_no_row(docs, monkeypatch):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(100):
        p = fresh(52)
        q = p[: 10 + k % 30] + fresh(1) + p[11 + k % 30 :]
        texts += [" ".join(fresh(60) + x + fresh(60)) for x in (p, q)]
    found = []
    for hot in (10**9, 1):
        monkeypatch.setattr(substring, "_HOT", hot)
        rows, _ = substring._passage_rows(docs(texts), 5, 46, 0.8, 3)
        found.append({tuple(r) for r in rows.collect()})
    assert found[0] and found[0] <= found[1]


def test_windows_that_are_dealt_out_are_compared_by_their_group():
    rng = np.random.default_rng(12)
    width, n = 6, 60
    context = rng.integers(1, 1 << 32, (n, 2 * width - 1)).astype(np.uint64)
    context[1::2] = context[::2]
    context[1::2, 0] = 9
    group = np.repeat(np.arange(n // 2), 2)
    want = {k * n + k - 1 for k in range(1, n, 2)}
    for dealt in (np.ones(n, bool), np.arange(n) < 30, np.zeros(n, bool)):
        got = substring.near_links(group, context, width, 0.8, dealt)
        assert set(got.tolist()) == want
    assert not len(substring.near_links(np.arange(n), context, width, 0.8, np.ones(n, bool)))
