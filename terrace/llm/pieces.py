"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking."""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from terrace.llm._common import over_batches, small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Segments in each of the two tables of ids that a worker keeps, and the longest that it keeps: bounds on memory alone.
_KEPT, _KEPT_CHARS = 150_000, 48
#: Stands for a control piece until bytes are joined: it has no text, but bytes on its two sides don't join.
_BREAK = "\ud800"


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            out.append((tag >> 3, varint()))
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        out.append((tag >> 3, data[at : at + size]))
        at += size
    return out


def _one_byte_on(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("terrace-byte", _one_byte_on)


class Pieces:
    """A merge-type SentencePiece model: encode() and decode() as the library does, without begin or end ids and without sampling.

    encode() works on segments that no merge can cross. In each, an Aho-Corasick automaton over the reversed vocabulary
    gives the pieces that begin at each place, longest first; a piece may follow another only if merging their joined
    characters gives the same two pieces again; places from which nothing can follow are kept in a bitfield, so each fails once.
    """

    def __init__(self, path: str, spell: bool = True) -> None:
        """spell: also prepare encode() and decode(); without it the model has its pieces alone."""
        with open(path, "rb") as f:
            model = _fields(f.read())
        self.pieces, self.scores, self.kinds = [], [], []
        for number, value in model:
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
        rules = dict(_fields(dict(model).get(3, b"")))
        trained = dict(_fields(dict(model).get(2, b"")))
        if trained.get(3, 1) != 2:
            raise ValueError(f"{path} is not a merge-type model")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError(f"{path} needs a text normalisation or piece types that are not supported")
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == BYTE}
        self.ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == NORMAL}
        if not spell:
            return
        self.fits = lru_cache(1 << 17)(self._fits)
        self.chars = {p for p in self.ids if len(p) == 1}
        self.auto = ahocorasick.Automaton()
        for p, k in self.ids.items():
            if self.merged(p) == [p]:
                self.auto.add_word(p[::-1], (len(p), k))
        self.auto.make_automaton()
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        alone = "" if "\n" in "".join(self.ids) else "\n"
        self.segments = (lambda s: [s] if s else []) if crossing else re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else "")).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(k) for k in range(len(self.pieces))]
        # bytes become lone surrogates or ASCII until they are joined
        self.surface = [_BREAK if kind == CONTROL else " ⁇ " if kind == UNKNOWN else (lambda b: chr(b) if b < 128 else chr(0xDC00 + b))(int(p[3:5], 16)) if kind == BYTE else p.replace(SPACE, " ") for p, kind in zip(self.pieces, self.kinds)]

    def merged(self, text: str) -> list[str]:
        """The pieces after all merges, the best score first and the leftmost of equals; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: int, b: int) -> bool:
        x, y = self.pieces[a], self.pieces[b]
        return self.merged(x + y) == [x, y]

    def _known(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        n = len(text)
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.auto.iter(text[::-1]):
            begins[n - 1 - end].append(found)
        failed, stack, at, k, fits = bytearray(n // 8 + 1), [], 0, 0, self.fits
        while at < n:
            last = stack[-1][2] if stack else -1
            options = begins[at]
            while k < len(options):
                size, piece = options[k]
                k += 1
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or fits(last, piece)):
                    stack.append((at, k, piece))
                    at, k = end, 0
                    break
            else:
                if not stack:
                    raise ValueError(f"no encoding of {text!r}")
                failed[at >> 3] |= 1 << (at & 7)
                at, k, _ = stack.pop()
        return [x[2] for x in stack]

    def segment(self, text: str) -> tuple[int, ...]:
        out, begin, chars = [], 0, self.chars
        for i, c in enumerate(text):
            if c not in chars:
                if begin < i:
                    out += self._known(text[begin:i])
                out += [self.byte[b] for b in c.encode("utf-8", "replace")] if self.byte else [self.unknown]
                begin = i + 1
        if begin < len(text):
            out += self._known(text[begin:])
        return tuple(out)

    def _of(self, text: str) -> tuple[int, ...]:
        found = self.kept.get(text)
        if found is None:
            found = self.before.get(text)
            if found is None:
                found = self.segment(text)
            if len(text) <= _KEPT_CHARS:
                # what was used since the tables last changed places stays, the rest goes
                if len(self.kept) >= _KEPT:
                    self.before, self.kept = self.kept, {}
                self.kept[text] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Null counts as empty; an empty text has no ids."""
        if not text:
            return []
        return list(chain.from_iterable(map(self._of, self.segments(self.prefix + text.replace(" ", SPACE)))))

    def decode(self, ids: list[int]) -> str:
        """One space goes from the front if the model adds one; bytes that are no UTF-8 become U+FFFD each; ids without text are dropped."""
        text = "".join(map(self.surface.__getitem__, ids))
        if self.prefix and text.lstrip(_BREAK)[:1] == " " and self._spaced(ids):
            text = text.replace(" ", "", 1)
        try:
            text.encode()
        except UnicodeEncodeError:
            text = "".join(x.encode("utf-8", "surrogateescape").decode("utf-8", "terrace-byte") for x in text.split(_BREAK))
        return text

    def _spaced(self, ids: list[int]) -> bool:
        """Whether the first id with text is a piece that begins with the space mark."""
        first = next(i for i in ids if self.kinds[i] != CONTROL)
        return self.kinds[first] == NORMAL


@lru_cache(2)
def load(path: str) -> Pieces:
    """The model, once for each Python worker."""
    return Pieces(path)


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded): every whole text's ids, and those ids decoded again. `model`: the model file's place on every executor.

    Null and empty texts give no ids and an empty text. Each row stands for itself: repeated rows repeat, order is free, other
    columns are ignored, and nothing is shuffled. Very long texts are encoded in linear time, in one batch row.
    """
    small_batches(docs.sparkSession)

    def f(b: dict[str, list]) -> dict[str, list]:
        m = load(model)
        ids = [m.encode(t) for t in b["text"]]
        return {"doc_id": b["doc_id"], "ids": ids, "decoded": [m.decode(x) for x in ids]}

    return over_batches(docs.select("doc_id", "text"), f, "doc_id long, ids array<int>, decoded string", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode_decode() with its results digested where they are made."""
    small_batches(docs.sparkSession)

    def f(b: dict[str, list]) -> dict[str, list]:
        m, out = load(model), {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in b["text"]:
            ids = m.encode(t)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(m.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        return out

    text = pa.string()
    return over_batches(docs.select("doc_id", "text"), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", text), ("decoded_sha256", text)]))


def forget() -> None:
    load.cache_clear()
