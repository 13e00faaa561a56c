"""Word-piece token counts by a longest-match automaton, in time linear in the text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from terrace.llm._common import over_batches, small_batches
from terrace.llm.pieces import SPACE, Pieces

#: Words whose counts a worker keeps, and the longest that it keeps: bounds on memory alone.
_KEPT, _KEPT_CHARS = 800_000, 48


class Counter:
    """How many pieces greedy longest-match-first gives a word, from a trie with failure links.

    The trie holds the vocabulary's word beginnings under one root and its continuations under another. Each node knows its failure
    node, where matching goes on once pieces are popped, and how many are popped on the way; no piece is built and no character is read twice.
    """

    def __init__(self, begins: Iterable[str], continues: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # 0: at a word's begin, 1: inside it
        final = {self._add(0, w) for w in begins if w} | {self._add(1, w) for w in continues if w}
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                if v in final:
                    self.fail[v], self.pops[v] = 1, 1
                elif u > 1:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], popped
                todo.append(v)
        self.kept: dict[str, int] = {}

    def _add(self, root: int, word: str) -> int:
        at = root
        for c in word:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
            at = self.next[at][c]
        return at

    def word(self, word: str) -> int:
        """Pieces in a word; 0 if the vocabulary can't make it up, which word-piece tokenizers give as one unknown token."""
        at, count, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while c not in step[at]:
                if fail[at] < 0:
                    return 0
                count += pops[at]
                at = fail[at]
            at = step[at][c]
        while at != 1:
            if fail[at] < 0:
                return 0
            count += pops[at]
            at = fail[at]
        return count

    def of(self, word: str) -> int:
        found = self.kept.get(word)
        if found is None:
            found = self.word(word)
            if len(word) <= _KEPT_CHARS:
                if len(self.kept) >= _KEPT:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words)."""
        sizes = [self.of(w.decode()) for w in text.encode("utf-8", "replace").split()] if text else []
        unknown = sizes.count(0)
        return len(sizes), sum(sizes) + unknown, unknown


@lru_cache(2)
def load(path: str) -> Counter:
    """A counter with a SentencePiece model's pieces: those that begin with its space mark begin words, the others continue them."""
    own = Pieces(path, spell=False).ids
    return Counter((p[1:] for p in own if p[0] == SPACE and SPACE not in p[1:]), (p for p in own if SPACE not in p))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown): greedy longest-match word pieces of every whole text, as counts alone.

    Words are runs without ASCII white space, in their own letter case; a word that the vocabulary can't make up counts as one token
    and as unknown, however long it is. Null and empty texts have none. Repeated rows repeat; other columns are ignored; nothing is shuffled.
    `vocabulary`: the file's place on every executor.
    """
    small_batches(docs.sparkSession)

    def f(b: dict[str, list]) -> dict[str, list]:
        found = [load(vocabulary).text(t) for t in b["text"]]
        return {"doc_id": b["doc_id"], **{n: [x[i] for x in found] for i, n in enumerate(("n_words", "n_tokens", "n_unknown"))}}

    names = ("doc_id", "n_words", "n_tokens", "n_unknown")
    return over_batches(docs.select("doc_id", "text"), f, ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))


def forget() -> None:
    load.cache_clear()
