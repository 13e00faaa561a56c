from collections import Counter, defaultdict

from terrace.llm import mixing

DOMAINS = {"web": ("s0", "s1"), "books": ("s2",)}
WEIGHTS = {"domain": {"web": 3, "books": 1, "other": 0}, "lang": {"en": 2}}


def fill(given, children):
    """[(weight, cap)] -> what each gets, by plain repeated division."""
    got, open_ = [0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0]
    while open_:
        left, total = given - sum(got[i] for i in range(len(children)) if i not in open_), sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] * total <= children[i][0] * left]
        if not full:
            for i in open_:
                got[i] = children[i][0] * left // total
            break
        i = min(full, key=lambda i: children[i][1] / children[i][0])
        got[i] = children[i][1]
        open_.remove(i)
    return got


def _docs(docs):
    texts, langs, sources = [], [], []
    for k in range(300):
        texts.append(" ".join("w" for _ in range(1 + k % 13)))
        langs.append(["en", "de", None][k % 3] if k % 5 else "en")
        sources.append(["s0", "s0", "s0", "s1", "s2", "zz", None][k % 7])
    return docs(texts + [None, ""], lang=[*langs, "en", "en"], source=[*sources, "s0", "s1"]), texts, langs, sources


def test_budgets_and_prefixes_follow_the_tree(docs):
    frame, texts, langs, sources = _docs(docs)
    got = mixing.mix(frame, DOMAINS, WEIGHTS, share_percent=80, max_epochs=2, seed=1).collect()
    domain = lambda s: next((d for d, x in DOMAINS.items() if s in x), "other")
    held = defaultdict(int)
    for t, lang, s in zip(texts, langs, sources):
        held[domain(s), lang or "und", s or "unknown"] += len(t.split())
    cap = {leaf: 2 * n * (WEIGHTS["domain"].get(leaf[0], 1) > 0) for leaf, n in held.items()}
    budget = min(sum(held.values()) * 80 // 100, sum(cap.values()))

    def down(given, leaves, level):
        if level == 3:
            return {leaves[0]: given}
        names = sorted({x[level] for x in leaves})
        kind = ("domain", "lang", "source")[level]
        parts = [[x for x in leaves if x[level] == n] for n in names]
        shares = fill(given, [(WEIGHTS.get(kind, {}).get(n, 1), sum(cap[x] for x in p)) for n, p in zip(names, parts)])
        return {k: v for g, p in zip(shares, parts) for k, v in down(g, p, level + 1).items()}

    want = down(budget, sorted(held), 0)
    taken, copies = Counter(), Counter()
    for r in got:
        taken[r._domain, r.lang or "und", r.source or "unknown"] += r._tokens
        copies[r.doc_id] += 1
    for leaf, given in want.items():
        assert given <= taken[leaf] < given + 14 if given else taken[leaf] == 0
    for leaf in want:
        n = {copies[i] for i, (lang, s) in enumerate(zip(langs, sources)) if (domain(s), lang or "und", s or "unknown") == leaf}
        assert max(n) - min(n) <= 1  # whole epochs and a prefix of one more


def test_repeats_nulls_and_no_rows(docs):
    frame, *_ = _docs(docs)
    assert mixing.mix(frame.limit(0), DOMAINS, WEIGHTS).count() == 0
    one = docs(["a b", "a b"], ids=[1, 1], lang=[None, None], source=[None, None])
    assert mixing.mix(one, DOMAINS, {}, share_percent=100, max_epochs=1).count() == 2
    empty = docs([None, ""], lang=["en", "en"], source=["s0", "s0"])
    assert mixing.mix(empty, DOMAINS, {}).count() == 0
