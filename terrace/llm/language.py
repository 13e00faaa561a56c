"""Language identification by averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm._common import over_batches, small_batches

#: Buckets of the hashed subwords, their embeddings' size, and the subwords' lengths with a word's begin and end marks.
BUCKETS, DIM, SIZES = 1 << 16, 16, (1, 2, 3, 4)
#: What a text without a letter, or none, is called.
UNKNOWN = "und"
#: Words whose sums a worker keeps; a bound on memory alone.
_KEPT = 400_000

_WORD = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all the words' subwords, and the number of each one's word."""
    own = [np.frombuffer(f"<{w}>".encode("utf-32-le", "replace"), np.uint32) for w in words]
    codes = np.concatenate(own).astype(np.uint64) if own else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(own)), [len(x) for x in own])
    buckets, owner = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = word[:m] == word[n - 1 :]
        buckets.append((h[whole] >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owner.append(word[:m][whole])
    return (np.concatenate(buckets), np.concatenate(owner)) if buckets else (np.zeros(0, np.int64),) * 2


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """A text's distinct buckets and their shares; None without a letter."""
    counts = Counter(words_of(text))
    if not has_letter(list(counts)):
        return None
    buckets, owner = subwords(list(counts))
    weight = np.bincount(buckets, np.array(list(counts.values()), float)[owner], minlength=BUCKETS)
    at = np.flatnonzero(weight)
    return at, weight[at] / weight.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """languages; a score of each bucket for each language (embedding times softmax weights); the bias; the calibrated temperature; the least score that isn't rejected."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def chances(self, logits: np.ndarray) -> np.ndarray:
        return _softmax((logits + self.bias) / self.temperature)


def train(texts: list[str], languages: list[str], epochs: int = 4, rate: float = 2.0, seed: int = 5, accuracy: float = 0.99) -> Model:
    """A model by stochastic gradient descent, a text a step, the rate falling to nothing.

    Every fifth text trains nothing: on those the temperature is chosen by likelihood, and then the least score at which what scores as
    much or more has the wanted share of right answers.
    """
    names = sorted(set(languages))
    data = [(b, names.index(lang)) for t, lang in zip(texts, languages) if (b := bag(t)) is not None]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    aside, used = order[::5], np.delete(order, np.arange(0, len(order), 5))
    e = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    w, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    steps, done = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for k in rng.permutation(used):
            (at, share), y = data[k]
            step = rate * (1 - done / steps)
            mean = share @ e[at]
            g = _softmax(mean @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= step * np.outer(mean, g)
            bias -= step * 0.1 * g
            # shares are small: the rate is of the text, not of each subword
            e[at] -= step * share[:, None] / share.max() * back * 0.1
            done += 1
    model = Model(names, (e @ w).astype(np.float32), bias)
    held = aside if len(aside) else order
    if len(held):
        logits = np.array([data[k][0][1] @ model.scores[data[k][0][0]] for k in held])
        y = np.array([data[k][1] for k in held])
        losses = {}
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            losses[float(t)] = -np.log(np.maximum(model.chances(logits)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = min(losses, key=losses.get)
        p = model.chances(logits)
        by_score = np.argsort(-p.max(axis=1), kind="stable")
        right = (p.argmax(axis=1) == y)[by_score].cumsum() / np.arange(1, len(y) + 1)
        enough = np.flatnonzero(right >= accuracy)
        model.least = float(p.max(axis=1)[by_score][enough[-1]]) if len(enough) else 1.0
    return model


def fit(docs: DataFrame, train_rows: int = 3_000) -> Model:
    """A model from at most `train_rows` documents (the first by a hash of doc_id) with a language and a text, whose crc32(doc_id as text) mod 5 isn't 0.

    Whole texts count. Of rows that repeat a doc_id the one with the least language and text counts. The driver holds train_rows texts. With no such rows, as of an empty table, the model knows no language.
    """
    rows = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    few = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(train_rows).select("doc_id")
    one = rows.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    got = one.orderBy("doc_id").select("row.*").toArrow()  # bounded by train_rows
    return train(got["text"].to_pylist(), got["lang"].to_pylist())


_by_model: dict[str, "_Sums"] = {}


class _Sums(dict):
    """Each word's summed scores and number of subwords, row by row of one array."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.rows = model, np.zeros((1024, len(model.languages) + 1))

    def add(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            buckets, owner = subwords(part)
            n, c = len(part), len(self.model.languages)
            rows = np.column_stack([np.bincount(owner, self.model.scores[buckets, j], minlength=n) for j in range(c)] + [np.bincount(owner, minlength=n)])
            begin = len(self)
            while begin + n > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[begin : begin + n] = rows
            self.update(zip(part, range(begin, begin + n)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, by its whole text alone.

    score: the calibrated chance of the language; rejected: it is below the model's least score. A null text, and one without a letter, is 'und' with score 0,
    rejected; so is every text where nothing could be learned. Repeated rows repeat; other columns are ignored; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: dict[str, list]) -> dict[str, list]:
        m = shared.value
        if m.name not in _by_model or len(_by_model[m.name]) > _KEPT:
            _by_model.clear()
            _by_model[m.name] = _Sums(m)
        sums, out = _by_model[m.name], {"doc_id": b["doc_id"], "lang_pred": [], "score": [], "rejected": []}
        for text in b["text"]:
            words = words_of(text)
            lang, score = UNKNOWN, 0.0
            if m.languages and has_letter(words):
                sums.add(words)
                total = sums.rows[np.fromiter(map(sums.__getitem__, words), np.int64, len(words))].sum(axis=0)
                p = m.chances(total[:-1] / total[-1])
                k = int(p.argmax())
                lang, score = m.languages[k], float(p[k])
            out["lang_pred"].append(lang)
            out["score"].append(score)
            out["rejected"].append(lang == UNKNOWN or score < m.least)
        return out

    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    found = over_batches(docs.select("doc_id", "text"), f, "doc_id long, lang_pred string, score double, rejected boolean", arrow)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score", "rejected")


def forget() -> None:
    _by_model.clear()
