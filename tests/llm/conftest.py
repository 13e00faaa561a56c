import public_tokenizers
import pytest

ODD_TEXTS = [None, "", " ", "\n\t", "a", "the the the", "Ünïcödé ﬁ 日本語 😀\x00", "x" * 5000, "word " * 3000]


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text), with extra columns whose names the operators use inside."""

    def make(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        names = list(columns)
        rows = [(i, t, *(columns[n][k] for n in names), "x", 1, 2) for k, (i, t) in enumerate(zip(ids, texts))]
        schema = ", ".join(["doc_id long", "text string", *(f"{n} {'int' if n == 'toxic' else 'string'}" for n in names), "key string", "spans int", "epochs int"])
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def piece_model():
    return public_tokenizers.path("piece_bpe_32k.model")
