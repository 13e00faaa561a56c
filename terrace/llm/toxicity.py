"""Toxicity by class-conditional Kneser-Ney models of words' letters."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm._common import cut, discard, over_batches, settle, small_batches

#: The models' order in letters, and the highest order at which the two classes share their counts.
ORDER, SHARED = 6, 3
#: Kneser-Ney's discount.
DISCOUNT = 0.75
#: What a text is judged by. mean: the ratio a word; peak: of the most toxic passage; over1 to over3: logarithms of how far words exceed ratios of 1 to 3, a word.
FEATURES = ("mean", "peak", "over1", "over2", "over3")
#: Words in a passage; passages overlap by half.
PASSAGE = 24
#: Letters of text whose words are judged at once.
_AT_ONCE = 1 << 20
#: Words whose ratios a worker keeps; a bound on memory alone.
_KEPT = 150_000

_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(r"\w+").findall
_START, _END = 2, 3


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words' letters, each word between ORDER - 1 start marks and an end mark, one after the other; and each place's word."""
    own = [np.frombuffer(w.encode("utf-32-le", "replace"), np.uint32) for w in words]
    sizes = np.array([len(x) for x in own]) + ORDER
    codes = np.full(int(sizes.sum()), _START, np.uint64)
    ends = sizes.cumsum()
    starts = ends - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(codes)) - starts[word] >= ORDER - 1
    inside[ends - 1] = False
    codes[inside] = np.concatenate(own) if own else []
    codes[ends - 1] = _END
    return codes, word


def _grams(words: list[str]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, hashes of the grams that end at each letter and of their contexts; and each one's word."""
    codes, word = _letters(words)
    place = np.arange(len(codes)) - np.searchsorted(word, word)
    ends = np.flatnonzero(place >= ORDER - 1)
    letters = np.stack([codes[ends - k] for k in range(ORDER - 1, -1, -1)], axis=1)
    return {n: _hashes(letters[:, ORDER - n :]) for n in range(1, ORDER + 1)}, word[ends]


def _hashes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of grams, a row of letters each, and of their contexts: all letters but the last."""
    mixed = (letters + np.uint64(0x51ED27)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    n = letters.shape[1]
    context = np.zeros(len(letters), np.uint64)
    for k in range(n - 1):
        context = context * np.uint64(_BASE) + mixed[:, k]
    return context * np.uint64(_BASE) + mixed[:, -1], context * np.uint64(0x94D049BB133111EB) + np.uint64(n)


class Table:
    """Values by 64-bit hash. Every key has a place of its own, so a table grows with what is counted and no gram takes another's counts."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, unknown: tuple[float, ...]) -> None:
        mixed = self._mixed(hashes)
        order = np.argsort(mixed)
        self.keys = mixed[order]
        # a row for each key, the last that of unknown keys
        self.values = np.concatenate([values[:, order].T, [unknown]]).astype(np.float32)
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length()))
        slots = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.starts = np.searchsorted(self.keys >> self.shift, slots).astype(np.int32)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        """A row of values for each hash."""
        h = self._mixed(hashes)
        slot = (h >> self.shift).view(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        found = np.full(len(h), len(self.keys))
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        while len(open_):
            hit = self.keys[at] == h
            found[open_[hit]] = at[hit]
            at += 1
            on = ~hit & (at < end)
            open_, at, end, h = open_[on], at[on], end[on], h[on]
        return self.values.take(found, axis=0)


@dataclass
class Model:
    """Tables for each order: the grams' discounted shares, and their contexts' leftover mass and counts, of the toxic and the ordinary class; the scale of scores."""

    gram: dict[int, Table]
    left: dict[int, Table]
    scale: tuple[float, ...] = (0.0,) * (len(FEATURES) + 1)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    shared: Broadcast | None = None

    def share(self, spark: SparkSession) -> Broadcast:
        """The model on every executor, sent once."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None}

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary), by interpolated Kneser-Ney; orders up to SHARED are the same for both."""
        grams, word = _grams(words)
        p, known = np.full((len(word), 2), 1e-5), np.arange(len(word))
        for n in range(1, ORDER + 1):
            left = self.left[n][grams[n][1][known]]
            # a context that neither class knows leaves all to the lower order, and is in no longer one
            seen = left[:, 2:].any(axis=1)
            known, left = known[seen], left[seen]
            p[known] = self.gram[n][grams[n][0][known]] / np.maximum(left[:, 2:], 1) + left[:, :2] * p[known]
        return np.bincount(word, np.log(p[:, 0] / p[:, 1]), minlength=len(words))


def _counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, toxic_aside, ordinary_aside): in how many places each word stands, by class, in all rows and in those put aside. docs: text, toxic, aside."""
    names = ("ordinary", "toxic", "ordinary_aside", "toxic_aside")

    def f(b: dict[str, list]) -> dict[str, list]:
        seen = [Counter() for _ in names]
        for text, toxic, aside in zip(b["text"], b["toxic"], b["aside"]):
            words = words_of(text)
            seen[toxic].update(words)
            if aside:
                seen[2 + toxic].update(words)
        words = list(seen[0] | seen[1])
        return {"word": words} | {n: [x[w] for w in words] for n, x in zip(names, seen)}

    arrow = pa.schema([("word", pa.string()), *((n, pa.int64()) for n in names)])
    return over_batches(docs, f, "word string" + "".join(f", {n} long" for n in names), arrow).groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def _gram_counts(words: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): the distinct grams of the highest order, and how often each stands in either class."""

    def f(b: dict[str, list]) -> dict[str, list]:
        codes, word = _letters(b["word"])
        ends = np.flatnonzero(np.arange(len(codes)) - np.searchsorted(word, word) >= ORDER - 1)
        letters = np.stack([codes[ends - k] for k in range(ORDER - 1, -1, -1)], axis=1)
        _, first, place = np.unique(_hashes(letters)[0], return_index=True, return_inverse=True)
        toxic, ordinary = (np.bincount(place, np.array(b[k], np.float64)[word[ends]]).astype(np.int64) for k in ("toxic", "ordinary"))
        grams = [x.tobytes().decode("utf-32-le", "replace") for x in letters[first].astype("<u4")]
        return {"gram": grams, "toxic": toxic, "ordinary": ordinary}

    arrow = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())])
    return over_batches(words, f, "gram string, toxic long, ordinary long", arrow).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _hash_counts(level: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the grams of order n and for their contexts: hashes, and for each the classes' counts and numbers of distinct grams."""
    names = ("toxic", "ordinary", "toxic_kinds", "ordinary_kinds")

    def f(b: dict[str, list]) -> dict[str, np.ndarray]:
        letters = np.frombuffer("".join(b["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
        t, o = (np.array(b[k], np.float64) for k in ("toxic", "ordinary"))
        out: dict[str, list] = {k: [] for k in ("kind", "hash", *names)}
        for kind, h in enumerate(_hashes(letters)):
            hashes, place = np.unique(h.view(np.int64), return_inverse=True)
            for k, v in zip(("kind", "hash", *names), (np.full(len(hashes), kind), hashes, *(np.bincount(place, x).astype(np.int64) for x in (t, o, t > 0, o > 0)))):
                out[k].append(v)
        return {k: np.concatenate(v) for k, v in out.items()}

    columns = ("kind", "hash", *names)
    rows = over_batches(level, f, ", ".join(f"{c} long" for c in columns), pa.schema([(c, pa.int64()) for c in columns]))
    got = rows.groupBy("kind", "hash").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    kind = got["kind"].to_numpy()
    return [(got["hash"].to_numpy()[kind == k].view(np.uint64), np.stack([got[c].to_numpy()[kind == k] for c in names]).astype(np.float64)) for k in (0, 1)]


def fit_counts(words: DataFrame) -> Model:
    """The two models from words' counts (word, toxic, ordinary). Counts are distributed; the driver gets tables with a row of some dozens of bytes for each distinct gram of the labelled texts, and sends them to the executors."""
    spark = words.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20_000)
    gram, left = {}, {}
    level, path = cut(_gram_counts(words), "grams")
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # below the highest order a gram counts once for each distinct longer one that it ends
            shorter = level.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"), F.sum((F.col("ordinary") > 0).cast("long")).alias("ordinary"))
            if n <= SHARED:
                both = F.col("toxic") + F.col("ordinary") if n == SHARED else F.greatest("toxic", "ordinary")
                shorter = shorter.select("gram", both.alias("toxic"), both.alias("ordinary"))
            longer = path
            level, path = cut(shorter, "grams")
            discard(spark, longer)
        (g, x), (c, y) = _hash_counts(level, n)
        gram[n] = Table(g, x[:2] - DISCOUNT * x[2:], (0, 0))
        # the mass that discounts leave to the next lower order; all of it where a context is unknown
        left[n] = Table(c, np.concatenate([np.where(y[:2] > 0, DISCOUNT * y[2:] / np.maximum(y[:2], 1), 1), y[:2]]), (1, 1, 0, 0))
    discard(spark, path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return Model(gram, left)


def features(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' `keep` columns with FEATURES, all normalised by length, of each whole text."""
    shared = model.share(docs.sparkSession)

    def f(b: dict[str, list]) -> dict[str, list]:
        found = _features(b["text"], shared.value)
        return {**{k: b[k] for k in keep}, **{n: [x[i] for x in found] for i, n in enumerate(FEATURES)}}

    kinds = {k: t for k, t in docs.dtypes}
    arrow = pa.schema([(k, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[kinds[k]]) for k in keep] + [(n, pa.float64()) for n in FEATURES])
    return over_batches(docs.select("text", *keep), f, ", ".join([f"{k} {kinds[k]}" for k in keep] + [f"{n} double" for n in FEATURES]), arrow)


_NONE = float(np.log(1e-4))
_by_model: dict[str, dict[str, float]] = {}


def _known(name: str) -> dict[str, float]:
    """The ratios that this worker knows already, for the model in use."""
    if name not in _by_model:
        _by_model.clear()
        _by_model[name] = {}
    if len(_by_model[name]) > _KEPT:
        _by_model[name].clear()
    return _by_model[name]


def _features(texts: Iterable[str | None], model: Model) -> list[tuple[float, ...]]:
    """FEATURES of each text; words that the worker doesn't know yet are judged at once."""
    texts, out = [t or "" for t in texts], []
    begin, room = 0, 0
    for i, t in enumerate(texts):
        room += len(t)
        if room >= _AT_ONCE or i == len(texts) - 1:
            known, each = _known(model.name), [words_of(t) for t in texts[begin : i + 1]]
            new = list({w for words in each for w in words if w not in known})
            for k in range(0, len(new), 8_000):
                known.update(zip(new[k : k + 8_000], model.ratios(new[k : k + 8_000]).tolist()))
            out += [_of_ratios(np.fromiter(map(known.__getitem__, words), np.float64, len(words))) for words in each]
            begin, room = i + 1, 0
    return out


def forget() -> None:
    _by_model.clear()


def _of_ratios(r: np.ndarray) -> tuple[float, ...]:
    if not len(r):
        return 0.0, 0.0, _NONE, _NONE, _NONE
    total = np.concatenate([[0.0], r.cumsum()])
    begin = np.arange(0, max(1, len(r) - PASSAGE // 2), PASSAGE // 2)
    sums = total[np.minimum(begin + PASSAGE, len(r))] - total[begin]
    return float(r.mean()), float(sums.max() / PASSAGE), *(float(np.log(np.maximum(r - k, 0).mean() + 1e-4)) for k in (1, 2, 3))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression with a ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - np.array([0.0] + [ridge] * (x.shape[1] - 1)) * w), -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, calibrate_rows: int = 20_000) -> Model:
    """A model from docs whose crc32(doc_id as text) mod 3 is not 1 and that `labels` marks toxic 0 or 1.

    Up to a quarter of these rows (by a hash of doc_id), at most `calibrate_rows`, fix the scale of scores, judged by counts of all others; then
    every row gives counts. Null labels and texts are left out; of labels that repeat a doc_id the largest counts, and texts that repeat one all have its label.
    With one class only, every score is that class's; with none, or an empty table, 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.where("crc32(cast(doc_id as string)) % 3 <> 1")
    texts = docs.select("doc_id", "text").where("text is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    order = F.xxhash64("doc_id", F.lit(8))
    n = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = float(n.get(1, 0) > 0)
        return Model({}, {}, (30.0 * (2 * share - 1),))
    few, at = cut(marks.where(F.pmod(order, F.lit(4)) == 0).withColumn("order", order).orderBy("order", "doc_id").limit(calibrate_rows), "few")
    last = few.agg(F.max("order")).first()[0]
    aside = (F.pmod(order, F.lit(4)) == 0) & (order <= (F.lit(last) if last is not None else F.lit(-(1 << 63))))
    # one way of joining at every size: neither side is bounded
    words, words_at = cut(_counts(texts.join(marks.hint("merge"), "doc_id").select("text", "toxic", aside.alias("aside"))), "words")
    rest = words.select("word", (F.col("toxic") - F.col("toxic_aside")).alias("toxic"), (F.col("ordinary") - F.col("ordinary_aside")).alias("ordinary"))
    part = fit_counts(rest.where("toxic + ordinary > 0"))
    one = few.select("doc_id", "toxic")  # so few that each executor can have them
    # one row an id, so that ids that stand on many rows send no more than calibrate_rows to the driver
    judged = features(texts.where(aside).join(F.broadcast(one), "doc_id"), part, ("doc_id", "toxic"))
    seen = judged.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), *(F.min(n).alias(n) for n in FEATURES)).toPandas()
    if part.shared is not None:
        part.shared.unpersist()
    model = fit_counts(words.select("word", "toxic", "ordinary"))
    discard(spark, at, words_at)
    if seen["toxic"].nunique() == 2:
        w = _logistic(seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(float))
    else:
        w = np.array([-1.0, 4.0, 4.0, 0.0, 0.0, 0.0])  # rows enough for counts alone
    model.scale = tuple(w.tolist())
    return model


def _chance(model: Model) -> Column:
    """The calibrated chance from the columns of FEATURES."""
    total = F.lit(float(model.scale[0]))
    for name, weight in zip(FEATURES, model.scale[1:]):
        total = total + F.lit(float(weight)) * F.col(name)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by its whole text alone.

    score: the calibrated chance that the text is toxic; predicted: 1 from `threshold` on. Null and empty texts, and texts without
    a word, get the chance of a text without any toxic word. Repeated rows repeat; other columns are ignored; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    if model.gram:
        found = features(docs, model, ("doc_id",))
    else:
        found = docs.select("doc_id")
    chance = _chance(model)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), chance.alias("score"), (chance >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text score() would mark. Their columns pass unchanged; only texts go to Python."""
    small_batches(docs.sparkSession)
    if not model.gram:
        return docs if _chance_at_rest(model) < threshold else docs.where("false")
    shared, module = model.share(docs.sparkSession), __name__

    @F.pandas_udf(", ".join(f"{n} double" for n in FEATURES))
    def judged(text: pd.Series) -> pd.DataFrame:
        settle(module)
        return pd.DataFrame(_features(text, shared.value), columns=list(FEATURES))

    names = [F.col("_own").getField(c).alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own"), judged("text").alias("_judged"))
    return rows.select("_own", "_judged.*").where(_chance(model) < threshold).select(*names)


def _chance_at_rest(model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.scale[0], -30, 30))))
