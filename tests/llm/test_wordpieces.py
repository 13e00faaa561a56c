import random

from tokenizers import Tokenizer, models, pre_tokenizers

from terrace.llm import wordpieces
from tests.llm.conftest import ODD_TEXTS


def test_counts_as_greedy_word_pieces(spark, docs, piece_model):
    rng = random.Random(3)
    begins = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {"a"}
    continues = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(25)} | {"b"}
    vocabulary = {t: i for i, t in enumerate(sorted(begins) + ["##" + c for c in sorted(continues)] + ["[UNK]"])}
    library = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", continuing_subword_prefix="##", max_input_chars_per_word=10**6))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own = wordpieces.Counter(begins, continues)
    for _ in range(3000):
        text = " ".join("".join(rng.choice("abcd" if rng.random() < 0.05 else "abc") for _ in range(rng.randrange(1, 12))) for _ in range(3))
        assert own.text(text)[1] == len(library.encode(text).ids)
    got = {r.doc_id: r for r in wordpieces.token_counts(docs(ODD_TEXTS), piece_model).collect()}
    assert (got[0].n_words, got[0].n_tokens) == (0, 0) == (got[1].n_words, got[1].n_tokens)
    assert got[5].n_words == 3 and got[8].n_words == 3000
    assert wordpieces.token_counts(docs([]), piece_model).count() == 0
    assert wordpieces.token_counts(docs(["a", "a"], ids=[1, 1]), piece_model).count() == 2
