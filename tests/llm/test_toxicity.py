import math
import random
import zlib
from collections import Counter

from terrace.llm import toxicity
from tests.llm.conftest import ODD_TEXTS


def _corpus(n, seed):
    rng = random.Random(seed)
    parts = "ba do ki lu me no pa ri so tu ve".split()
    bad = ["grumpflax", "zwiekolt", "zwiekant"]
    texts, marks = [], []
    for k in range(n):
        t = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 200))]
        toxic = int(k % 4 == 0)
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t))
        marks.append(toxic)
    return texts, marks


def test_separates_held_out_rows_and_never_reads_labels(spark, docs):
    texts, marks = _corpus(900, 4)
    labels = spark.createDataFrame([(k, m, None) for k, m in enumerate(marks)] + [(5000, None, 1)], "doc_id long, toxic int, key string")
    frame = docs(texts + ODD_TEXTS)
    model = toxicity.fit(frame, labels)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(texts) + len(ODD_TEXTS)
    held = [r for r in rows if r.doc_id < 900 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    hit = sum(r.predicted for r in held if marks[r.doc_id])
    assert hit >= 0.9 * sum(marks[r.doc_id] for r in held)
    assert sum(r.predicted for r in held if not marks[r.doc_id]) <= 0.02 * len(held)
    kept = {r.doc_id for r in toxicity.drop_toxic(frame, model).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    assert toxicity.drop_toxic(frame, model).columns == frame.columns


def test_few_or_no_labels(spark, docs):
    frame = docs(["a", None])
    for marks, want in (([], 0), ([(0, 0)], 0), ([(0, 1)], None)):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        rows = toxicity.score(frame, toxicity.fit(frame, labels)).collect()
        assert len(rows) == 2
        assert want is None or all(r.predicted == want for r in rows)
    assert toxicity.score(docs([]), toxicity.fit(frame, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def _plain(counts, order=6, shared=3, discount=0.75):
    """Interpolated Kneser-Ney of letters by dictionaries: word -> log P(word | toxic) - log P(word | ordinary). counts: word -> (toxic, ordinary)."""
    levels = {}
    top = [Counter(), Counter()]
    for word, n in counts.items():
        marked = "\x02" * (order - 1) + word + "\x03"
        for i in range(len(word) + 1):
            for c in (0, 1):
                top[c][marked[i : i + order]] += n[c]
    levels[order] = [+c for c in top]
    for n in range(order - 1, 0, -1):
        lower = [Counter(g[1:] for g in c) for c in levels[n + 1]]
        if n == shared:
            lower = [lower[0] + lower[1]] * 2
        levels[n] = lower
    totals = {n: [(Counter(), Counter()) for _ in (0, 1)] for n in levels}
    for n, both in levels.items():
        for c in (0, 1):
            for g, k in both[c].items():
                totals[n][c][0][g[:-1]] += k
                totals[n][c][1][g[:-1]] += 1

    def chance(c, gram):
        p = 1e-5
        for n in range(1, order + 1):
            g = gram[order - n :]
            total, kinds = (x[g[:-1]] for x in totals[n][c])
            k = levels[n][c][g]
            p = (k - discount * (k > 0)) / max(total, 1) + (discount * kinds / total if total else 1) * p
        return p

    def ratio(word):
        marked = "\x02" * (order - 1) + word + "\x03"
        return sum(math.log(chance(0, marked[i : i + order]) / chance(1, marked[i : i + order])) for i in range(len(word) + 1))

    return ratio


def test_ratios_against_plain_kneser_ney(spark, docs):
    texts, marks = _corpus(200, 9)
    texts[0] += " \u00fcnter \u65e5\u672c"
    counts = {}
    for text, toxic in zip(texts, marks):
        for w in toxicity.words_of(text):
            n = counts.setdefault(w, [0, 0])
            n[1 - toxic] += 1
    model = toxicity.fit_counts(spark.createDataFrame([(w, t, o) for w, (t, o) in counts.items()], "word string, toxic long, ordinary long"))
    plain = _plain(counts)
    asked = [*list(counts)[:200], "grumpflax", "grump", "unseen", "\u65e5", "x"]
    for word, got in zip(asked, model.ratios(asked)):
        assert abs(got - plain(word)) < 1e-3 * max(1, abs(plain(word))), word
    assert model.ratios(["grumpflax"])[0] > 3 > model.ratios(["bado"])[0]


def test_every_labelled_row_gives_counts(spark, docs):
    texts, marks = _corpus(900, 4)
    # a word of one toxic row alone, whichever part it falls into, is known afterwards
    texts = [t + f" zoq{k}zoq" * 3 if m else t for k, (t, m) in enumerate(zip(texts, marks))]
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    model = toxicity.fit(docs(texts), labels)
    seen = [f"zoq{k}zoq" for k, m in enumerate(marks) if m and zlib.crc32(str(k).encode()) % 3 != 1]
    assert (model.ratios(seen) > 3).all()


def test_very_long_texts_ties_and_an_empty_table(spark, docs):
    texts, marks = _corpus(300, 6)
    model = toxicity.fit(docs(texts), spark.createDataFrame(list(enumerate(marks)) + list(enumerate(marks)), "doc_id long, toxic int"))
    frame = docs(["bado " * 300_000, "bado " * 10, "bado " * 10, texts[1] + " grumpflax" * 40], ids=[1, 2, 2, None])
    got = sorted(toxicity.score(frame, model).collect(), key=lambda r: r.doc_id or 0)
    assert [r.predicted for r in got] == [1, 0, 0, 0] and got[2].score == got[3].score
    assert toxicity.drop_toxic(docs([]), model).count() == 0
