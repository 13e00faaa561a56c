import random
import zlib

from terrace.llm import language
from tests.llm.conftest import ODD_TEXTS

PARTS = {"aa": "ka mi no to shi ra".split(), "bb": "sch ei ung lich ver gen".split(), "cc": "eau oui que tion ment les".split()}


def test_held_out_accuracy_and_odd_texts(docs):
    rng = random.Random(1)
    texts, langs = [], []
    for k in range(450):
        lang = sorted(PARTS)[k % 3]
        texts.append(" ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 40))))
        langs.append(lang if k % 10 else None)
    odd = [*ODD_TEXTS, "123 456", "½ ² _"]
    frame = docs(texts + odd, lang=langs + [None] * len(odd), source=["x"] * (len(texts) + len(odd)))
    model = language.fit(frame)
    got = {r.doc_id: r for r in language.predict(frame, model).collect()}
    assert len(got) == len(texts) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in range(450) if got[i].held_out and len(texts[i].split()) > 2]
    assert sum(got[i].lang_pred == sorted(PARTS)[i % 3] for i in held) >= 0.97 * len(held)
    blank = {450 + i for i, t in enumerate(odd) if not any(c.isalpha() for c in t or "")}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == blank
    assert all(r.rejected == (r.lang_pred == "und" or r.score < model.least) for r in got.values())


def test_no_rows_and_nothing_to_learn(docs):
    none = docs(["abc", None], lang=[None, None], source=["x", "x"])
    model = language.fit(none)
    assert [r.lang_pred for r in language.predict(none, model).collect()] == ["und", "und"]
    assert language.predict(docs([]), model).count() == 0
