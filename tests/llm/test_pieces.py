import hashlib
import random

import sentencepiece

from terrace.llm import pieces
from tests.llm.conftest import ODD_TEXTS


def test_encodes_and_decodes_as_the_library(piece_model):
    own, library = pieces.Pieces(piece_model), sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rng = random.Random(1)
    letters = list(" \n\t▁▁  aabcdeefghionrst.,;:!?()[]{}éèüß日本語한국ﬁ½\x00\x07😀é\r") + ["  ", "    ", "the", "ing", "\r\n", "ation"]
    for text in [t for t in ODD_TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2, 0, 28705]) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_digests_of_every_row(spark, docs, piece_model):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    got = {r.doc_id: r for r in pieces.encode_digests(docs(ODD_TEXTS), piece_model).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    rows = pieces.encode_decode(docs(["a b", "a b"], ids=[1, 1]), piece_model).collect()
    assert [r.ids for r in rows] == [library.encode("a b")] * 2 and rows[0].decoded == "a b"
    assert pieces.encode_digests(docs([]), piece_model).count() == 0


def test_segments_that_come_again_and_again_are_spelt_once(piece_model, monkeypatch):
    own, library = pieces.Pieces(piece_model), sentencepiece.SentencePieceProcessor(model_file=piece_model)
    monkeypatch.setattr(pieces, "_KEPT", 50)
    spelt, segment = [], own.segment
    own.segment = lambda text: spelt.append(text) or segment(text)
    for k in range(40):  # 400 segments of one time, and two that every text has
        text = "always here " + " ".join(f"rare{k}x{j}" for j in range(10))
        assert own.encode(text) == library.encode(text)
    assert spelt.count("▁always") == spelt.count("▁here") == 1 and len(own.kept) + len(own.before) <= 100
