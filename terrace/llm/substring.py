"""Near-duplicate passages across documents, by compact windows of token min-hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm._common import cut, discard, in_worker, over_batches, settle, small_batches

#: Bits of a packed value that hold a place in a batch's sequence of words; the others order the hashes.
_PLACE = np.uint64((1 << 32) - 1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_64 = (1 << 64) - 1
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are hashed at once.
_BYTES = 2 << 20
#: Windows with different surroundings under one key beyond which they are dealt out by the further min-hashes that near_links() compares them by. No row is lost by that.
_HOT = 2_000
#: Windows that are compared at once, but for those of one key, which stay together.
_AT_ONCE = 8_000
#: Pairs of windows that are compared at once.
_PAIRS_AT_ONCE = 4_000
#: Places by which words that were put in or left out may shift the rest of a passage.
_SLIDE = 8
#: Further hash functions of which two must agree with the window's own on a common run.
_FURTHER = 4


def words_of(text: str | None) -> list[bytes]:
    """The text's words: runs without ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


class _Tables:
    """Powers of the base and of its inverse, as many as were needed so far."""

    power = inverse = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.power) < n:
            cls.power, cls.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.power[:n], cls.inverse[:n]


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts in a row, and how many words each text has. The texts hold A-Z in lower case."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edge[::2], edge[1::2]
    power, inverse = _Tables.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[:-1])])
    h = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(_STEP))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(begin, starts))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at white space into pieces of about _BYTES."""
    at = 0
    while len(text) - at > _BYTES:
        blank = max(text.rfind(c, at + 1, at + _BYTES) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if blank < 0:
            found = _BLANK.search(text, at + _BYTES)
            blank = found.start() if found else len(text)
        yield text[at:blank]
        at = blank
    yield text[at:]


def sequence(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, begin, n): a 64-bit hash for each run of `size` words of all texts, one text behind the other, where each text's begin and how many it has.

    Between two texts stand `size` places that belong to none; their values mean nothing.
    """
    h, n = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    held, of, room = [], [], 0
    for i, text in enumerate([*texts, None]):
        for t in _pieces(text.encode("utf-8", "replace").lower() if text else b""):
            if held and (room + len(t) > _BYTES or i == len(texts)):
                found, counts = _word_hashes(held)
                h.append(found)
                np.add.at(n, of, counts)
                held, of, room = [], [], 0
            held.append(t)
            of.append(i)
            room += len(t) + 1
    h = np.concatenate(h)
    # one place more after each text, and `size` at the end, so that no shingle that counts crosses a border
    begin = np.cumsum(n + 1) - n - 1
    spaced = np.zeros(len(h) + len(n) + size, np.uint64)
    spaced[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    out = np.zeros(len(h) + len(n), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + spaced[k : k + len(out)]
    return _mix(out), begin, np.maximum(n - size + 1, 0)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words."""
    h, begin, n = sequence([b" ".join(words).decode("utf-8", "replace")], size)
    return h[: n[0]]


def _least(packed: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    n = len(packed)
    rows = -(-n // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = packed
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def compact_windows(packed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last) of every compact window at least `width` wide, cut to what runs of `width` reach.

    `packed` holds hashes in its upper bits and each value's number in the lower ones. Of all runs of `width` values inside
    [first, last] the least value is at `place`. These are the nodes of the values' Cartesian tree whose subtrees
    span `width` or more: in a run's range the node nearest to the root is its least value, so a node's runs are one stretch
    of neighbouring runs. [first, last] is the node's span, no more than width - 1 to each side of its place.
    """
    if len(packed) < width:
        return (np.zeros(0, np.int64),) * 3
    least = _least(packed, width)
    first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
    return (least[first] & _PLACE).astype(np.int64), first, np.append(first[1:], len(least)) + width - 2


_W = ("key", "doc_id", "place", "left", "right", "other")


def windows(ids: list[int], texts: list[str | None], size: int, width: int, hashes: int) -> np.ndarray:
    """Rows (key, doc, place, left, right, context) of the texts' compact windows, as int64 columns; texts come in order of ids.

    Windows of equal keys and contexts hold equal shingles from `left` before their place to `right` behind it.
    """
    values, begin, n = sequence(texts, size)
    if not (n >= width).any():
        return np.zeros((6, 0), np.int64)
    numbers = np.arange(len(values), dtype=np.uint64)
    # a value less than any other at all places that are no shingle of a text long enough
    long = n >= width
    border = np.zeros(len(values) + 1, np.int8)
    border[begin[long]] = 1
    border[(begin + n)[long]] = -1
    wall = np.cumsum(border[:-1]) == 0
    power, inverse = _Tables.upto(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1])])
    ids, parts = np.array(ids, np.int64), []
    for j in range(hashes):
        v = _mix(values + np.uint64((j + 1) * _STEP & _64))
        packed = np.where(wall, numbers, (v & ~_PLACE) | numbers)
        place, first, last = compact_windows(packed, width)
        own = ~wall[place]
        place, first, last = place[own], first[own], last[own]
        text = np.searchsorted(begin, place, side="right") - 1
        context = _mix((sums[last + 1] - sums[first]) * inverse[first] + ((last - first) * width + place - first).astype(np.uint64))
        parts.append(np.stack([v[place].view(np.int64), ids[text], place - begin[text], place - first, last - place, context.view(np.int64)]))
    return np.concatenate(parts, axis=1)


def _passages(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (doc, first, shift, begin, end) of windows that hold the same shingles as others; none of one document."""
    ok = w[1] != first[1]
    w, first = w[:, ok], first[:, ok]
    swap = w[1] < first[1]
    a, b = np.where(swap, first, w), np.where(swap, w, first)
    return _united(np.stack([a[1], b[1], a[2] - b[2], a[2] - a[3], a[2] + a[4] + 1]))


def _united(p: np.ndarray) -> np.ndarray:
    """Passages of the same documents and shift that overlap become one."""
    if not p.shape[1]:
        return p
    p = p[:, np.lexsort((p[3], p[2], p[1], p[0]))]
    new = np.ones(p.shape[1], bool)
    new[1:] = (p[:3, 1:] != p[:3, :-1]).any(axis=0)
    # ends grow from left to right inside a group and never reach the next group's
    group = np.cumsum(new) - 1
    stride = int(p[4].max()) + 1
    reach = np.maximum.accumulate(p[4] + group * stride) - group * stride
    new[1:] |= p[3, 1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([*p[:4, at], np.maximum.reduceat(p[4], at)])


def _alike(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the first document with their key and context, and the passages that other documents' windows share with the first of them."""
    tag = _mix(w[0].view(np.uint64) ^ _mix(w[5].view(np.uint64)))
    order = np.argsort(tag, kind="stable")
    new = np.diff(tag[order], prepend=~tag[order[:1]]) != 0
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    own = w[1, order] == w[1, first]
    return w[:, order[own]], _passages(w[:, order[~own]], w[:, first[~own]])


def _as_rows(w: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Windows and passages as one table's columns. A window has its context in `other`; a passage has the other document there, a key that spreads it, its shift in `right` and its length, below 0, in `left`."""
    key = _mix((p[0] ^ p[1] << 20).view(np.uint64)).view(np.int64)
    return dict(zip(_W, (np.concatenate(x) for x in zip(w, (key, p[0], p[3], p[3] - p[4], p[2], p[1])))))


def _of_rows(w: np.ndarray) -> np.ndarray:
    """Passages out of the columns that _as_rows() gives them."""
    return np.stack([w[1], w[5], w[4], w[2], w[2] - w[3]])


def _runs(cumulated: np.ndarray, width: int) -> np.ndarray:
    return cumulated[:, width:] - cumulated[:, :-width]


def _sums(x: np.ndarray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros((len(x), 1), kind), np.cumsum(x, axis=1, dtype=kind)], axis=1)


def _firsts(tag: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, first): each member of a tag's group but the first, and the first."""
    order = np.argsort(tag, kind="stable")
    new = np.diff(tag[order], prepend=~tag[order[:1]]) != 0
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return of[order[~new]], of[first[~new]]


def exact_links(group: np.ndarray, context: np.ndarray, width: int) -> np.ndarray:
    """later * n + earlier: every window beside the first of its group that holds a run of `width` shingles around the place that it holds, for every such run."""
    n = len(group)
    sums = _sums(context * _powers(_BASE, context.shape[1]), np.uint64)
    whole = _runs(_sums(context > 0, np.int32), width) == width
    salt, pairs = _mix(group.astype(np.uint64)), [np.zeros(0, np.int64)]
    for k in range(whole.shape[1]):
        own = np.flatnonzero(whole[:, k])
        later, first = _firsts(_mix((sums[own, k + width] - sums[own, k]) ^ salt[own]), own)
        pairs.append(np.unique(later * n + first))
    return np.unique(np.concatenate(pairs))


def signed_runs(group: np.ndarray, context: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, sign): the intervals of a window's runs of `width` on which two further min-hashes stay the same, joined with each other: sign is their group and both min-hashes.

    Windows with a common sign agree under their own hash function and under two of _FURTHER others on a run around the place.
    """
    whole = _runs(_sums(context > 0, np.int32), width) == width
    least = []
    for j in range(_FURTHER):
        v = np.where(context > 0, _mix(context + np.uint64((j + 29) * _STEP & _64)), np.iinfo(np.uint64).max)
        before = np.minimum.accumulate(v[:, width - 1 :: -1], axis=1)[:, ::-1]  # from a run's begin to the place
        behind = np.minimum.accumulate(v[:, width - 1 :], axis=1)
        least.append(np.minimum(before, behind))
    salt, found = _mix(group.astype(np.uint64)), []
    for i in range(_FURTHER):
        for j in range(i + 1, _FURTHER):
            sign = _mix((least[i] * np.uint64(_BASE) + least[j]) ^ salt[:, None]) + np.uint64(i * _FURTHER + j)
            new = whole.copy()
            new[:, 1:] &= (sign[:, 1:] != sign[:, :-1]) | ~whole[:, :-1]
            at = np.nonzero(new)
            found.append((at[0], sign[at]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def likeness(context: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """For each pair of windows the most shingles in a run of `width` of the one that the other holds within _SLIDE places."""
    out = np.empty(len(a), np.int32)
    padded = np.pad(context, ((0, 0), (_SLIDE, _SLIDE)))
    for lo in range(0, len(a), _PAIRS_AT_ONCE):
        x, y = context[a[lo : lo + _PAIRS_AT_ONCE]], padded[b[lo : lo + _PAIRS_AT_ONCE]]
        hit = np.zeros(x.shape, bool)
        for d in range(2 * _SLIDE + 1):
            hit |= x == y[:, d : d + x.shape[1]]
        hit &= x > 0
        out[lo : lo + _PAIRS_AT_ONCE] = _runs(_sums(hit, np.int32), width).max(axis=1)
    return out


def near_links(group: np.ndarray, context: np.ndarray, width: int, similarity: float, dealt: np.ndarray | None = None) -> np.ndarray:
    """later * n + earlier: windows of a group worth verifying, as they agree on enough min-hashes and hold most of a run of `width` in common.

    Of the windows with a common sign the first is a representative, and so is each next one that is like none of the representatives before
    it; all windows of the sign are compared with each representative. Windows that are `dealt` out have their group for their sign.
    """
    n = len(group)
    dealt = np.zeros(n, bool) if dealt is None else dealt
    own, rest = np.flatnonzero(~dealt), np.flatnonzero(dealt)
    window, sign = signed_runs(group[own], context[own], width)
    window, sign = np.concatenate([own[window], rest]), np.concatenate([sign, _mix(group[rest].astype(np.uint64))])
    order = np.lexsort((window, sign))
    window, sign = window[order], sign[order]
    new = np.diff(sign, prepend=~sign[:1]) != 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(sign)))
    several = size > 1
    start, size = start[several], size[several]
    least, enough = int(similarity * width), 2 * similarity / (1 + similarity) * width
    free = np.ones(len(sign), bool)
    at, found = start.copy(), [np.zeros(0, np.int64)]
    while len(start):
        # each sign's next window that no representative is like
        left = np.concatenate([np.zeros(1, np.int64), np.cumsum(free)])
        ahead = np.searchsorted(left, left[at] + 1)
        more = ahead <= start + size
        start, size, at = start[more], size[more], ahead[more] - 1
        if not len(start):
            break
        row = np.repeat(at, size)
        every = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        later, earlier = np.maximum(window[row], window[every]), np.minimum(window[row], window[every])
        pair, back = np.unique(later * n + earlier, return_inverse=True)
        like = likeness(context, pair // n, pair % n, width)
        found.append(pair[(like >= least) & (pair // n != pair % n)])
        free[every[like[back] >= enough]] = False
        free[at] = False
    return np.unique(np.concatenate(found))


def verified(x: np.ndarray, y: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, ...]:
    """(pair, begin, end, other_begin, other_end, similarity): where rows of x and y, the surroundings of two windows each, hold a common passage.

    A passage is a stretch of runs of `width` that have enough shingles in common for the similarity, without what the other side lacks at
    its ends; it counts if its set of shingles and that of the other side's stretch, each with as many beside it as it lacks to `width`, have that
    Jaccard similarity. An exact run at the same places always counts.
    """
    n, wide = x.shape
    hit, shift = np.zeros(x.shape, bool), np.zeros(x.shape, np.int64)
    padded = np.pad(y, ((0, 0), (_SLIDE, _SLIDE)))
    for d in sorted(range(-_SLIDE, _SLIDE + 1), key=abs):
        now = ~hit & (x > 0) & (x == padded[:, _SLIDE + d : _SLIDE + d + wide])
        hit |= now
        shift[now] = d
    same = hit & (shift == 0)
    number = np.arange(wide)

    def around(ok: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last of neighbouring places that are all ok, around the best."""
        bad = np.where(ok, -1, np.arange(ok.shape[1]))
        first = np.where(np.arange(ok.shape[1]) <= best[:, None], bad, -1).max(axis=1) + 1
        last = np.where((np.arange(ok.shape[1]) >= best[:, None]) & ~ok, np.arange(ok.shape[1]), ok.shape[1]).min(axis=1) - 1
        return first, last

    shared = _runs(_sums(hit, np.int32), width)
    enough = shared >= 2 * similarity / (1 + similarity) * width - 1e-9
    best = shared.argmax(axis=1)
    lo, hi = around(enough, best)
    inside = hit & (number >= lo[:, None]) & (number < hi[:, None] + width)
    begin, end = inside.argmax(axis=1), wide - inside[:, ::-1].argmax(axis=1)
    there = number + shift
    other_begin = np.where(inside, there, wide).min(axis=1)
    other_end = np.where(inside, there, -1).max(axis=1) + 1
    ok = enough[np.arange(n), best]

    def kinds(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Each row's shingles once, in order, zeros ahead."""
        v = np.sort(np.where((number >= lo[:, None]) & (number < hi[:, None]), v, 0), axis=1)
        v[:, 1:][v[:, 1:] == v[:, :-1]] = 0
        return v

    a, b = kinds(x, begin, end), kinds(y, other_begin, other_end)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(axis=1)
    # what a stretch lacks to `width` stands beside it, where the other side has something else
    lack, other_lack = np.maximum(width - (end - begin), 0), np.maximum(width - (other_end - other_begin), 0)
    alike = common / np.maximum((a > 0).sum(axis=1) + lack + (b > 0).sum(axis=1) + other_lack - common, 1)
    ok &= alike >= similarity
    runs = _runs(_sums(same, np.int32), width) == width
    first, last = around(runs, runs.argmax(axis=1))
    exact = ~ok & runs.any(axis=1)
    begin, end = np.where(exact, first, begin), np.where(exact, last + width, end)
    other_begin, other_end, alike = np.where(exact, begin, other_begin), np.where(exact, end, other_end), np.where(exact, 1.0, alike)
    at = np.flatnonzero(ok | exact)
    return at, begin[at], end[at], other_begin[at], other_end[at], alike[at]


def _spread(data: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """A row of 2 * width - 1 shingles for each window, its place in the middle, 0 where it doesn't reach."""
    n = left + right + 1
    out = np.zeros((len(n), 2 * width - 1), np.uint64)
    begin = np.arange(len(n)) * (2 * width - 1) + width - 1 - left
    out.ravel()[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())] = data
    return out


_FOUND = "doc_id long, first_id long, begin int, end int, first_begin int, first_end int, similarity double"


def near_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, size: int = 5, hashes: int = 3) -> DataFrame:
    """(doc_id, begin, end, first_id, first_begin, first_end, similarity): stretches of passages that repeat one in a document with a smaller doc_id.

    Places count words; `end` is one past the last. Passages have at least `min_words` words, over whole texts; their sets of
    `size`-word shingles have at least the Jaccard similarity. There is a row for each earlier document that a passage was compared with and
    repeats; passages that overlap in both documents are one stretch, with the lowest of their similarities. A stretch reaches as far as the compared windows
    show it, so of a passage that is alike only it may be a part, and it ends with words that both have; all exact runs of min_words lie in stretches.

    Subsequences are grouped by the compact windows that they lie in: a window's key is the min-hash of all its runs of `width`
    (min_words - size + 1) shingles under one of `hashes` functions. Windows of a key whose surroundings are equal share a passage with the first of them.
    The others are fetched from the texts and joined on the intervals of runs on which two further min-hashes agree as well, then each is verified
    with the representatives of its interval, in one task for a whole key, or for each interval's min-hashes where a key has many windows. An exact repeat is always found: every run of `width` shingles is compared with
    the first window of its key that holds it. A passage of similarity s is missed as a candidate with a chance below (1 - s) ** hashes
    plus that of two of four further min-hashes not agreeing, 3 % at 0.8. Shingles are compared as hashes of 64 bits where
    surroundings are equal, else of 32 bits. Passages alike only to a window that is no representative are linked through the representative.

    The first occurrence is never reported as a repeat; repeats inside one document are not reported. Null, empty and short texts
    hold no passage, nor do rows with a null doc_id. Rows that repeat a doc_id are taken as one document's copies and not linked. A worker
    holds about a hundred bytes for each word of a batch or of a longer text. Other columns are ignored; an empty table gives an empty result.
    """
    width = min_words - size + 1
    pairs, paths = _passage_rows(docs, size, width, similarity, hashes)
    found, _ = cut(_stretches(pairs.select("doc_id", "first_id", "begin", (F.col("end") + size - 1).alias("end"), "first_begin", (F.col("first_end") + size - 1).alias("first_end"), "similarity")), "passages")
    discard(docs.sparkSession, *paths)
    return found


def _passage_rows(docs: DataFrame, size: int, width: int, similarity: float, hashes: int) -> tuple[DataFrame, list[str]]:
    """Passages in shingles as rows of _FOUND, and the tables that they are read from."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = "key long, doc_id long, place int, left int, right int, other long"
    arrow = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("other", pa.int64())])
    signs = pa.schema([*list(arrow)[:-1], ("sign", pa.int64())])
    around = pa.schema([*list(arrow)[:-1], ("dealt", pa.int32()), ("context", pa.binary())])
    found = pa.schema([("doc_id", pa.int64()), ("first_id", pa.int64()), *((c, pa.int32()) for c in ("begin", "end", "first_begin", "first_end")), ("similarity", pa.float64())])

    def local(b: dict[str, list]) -> dict | None:
        order = sorted(range(len(b["doc_id"])), key=b["doc_id"].__getitem__)
        w = windows([b["doc_id"][i] for i in order], [b["text"][i] for i in order], size, width, hashes)
        return _as_rows(*_alike(w)) if w.shape[1] else None

    def over_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, then context. Of a key that goes on in the next batch only its first window and the last context's are held."""
        held, sent = np.zeros((6, 0), np.int64), np.zeros(0, bool)
        for b in batches:
            if not b.num_rows:
                continue
            w = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _W])
            p = _of_rows(w[:, w[3] < 0])
            w = np.concatenate([held, w[:, w[3] >= 0]], axis=1)
            if not w.shape[1]:
                yield pa.RecordBatch.from_pydict(_as_rows(w, p), schema=arrow)
                continue
            sent = np.concatenate([sent, np.zeros(w.shape[1] - len(sent), bool)])
            new_key = np.diff(w[0], prepend=~w[0][:1]) != 0
            new = new_key | (np.diff(w[5], prepend=~w[5][:1]) != 0)
            first = np.maximum.accumulate(np.where(new, np.arange(w.shape[1]), 0))
            own = w[1] == w[1, first]
            same = _passages(w[:, ~own], w[:, first[~own]])
            kept = np.flatnonzero(own)
            begin = np.flatnonzero(new_key[kept])
            n = np.diff(np.append(begin, len(kept)))
            lo, hi = np.minimum.reduceat(w[1, kept], begin), np.maximum.reduceat(w[1, kept], begin)
            many = (n > 1) & (lo != hi)
            many[-1] = n[-1] > 1  # documents that come yet may differ
            many = np.repeat(many, n)
            now = kept[many & ~sent[kept]]
            sent[now] = True
            p = _united(np.concatenate([p, same], axis=1))
            yield pa.RecordBatch.from_pydict(_as_rows(w[:, now], p), schema=arrow)
            hold = np.unique([kept[begin[-1]], kept[-1]])
            held, sent = w[:, hold], sent[hold]

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc, windows, length, shingles): windows that are asked for, as rows (key, place, left, right, dealt), some at once, and what stands around them, one behind the other."""
        for b in batches:
            if not b.num_rows:
                continue
            h, begin, n = sequence(b.column("text").to_pylist(), size)
            h = h.astype(np.uint32) | np.uint32(1)
            lists = b.column("windows")
            which = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            w = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten()])
            ok = w[1] + w[3] < n[which]  # else of another row with this doc_id
            which, w = which[ok], w[:, ok]
            doc = b.column("doc_id").to_numpy()[which]
            for lo in range(0, len(which), _PAIRS_AT_ONCE):
                s = slice(lo, lo + _PAIRS_AT_ONCE)
                _, place, left, right, _ = w[:, s]
                long = left + right + 1
                yield doc[s], w[:, s], long, h[np.repeat(begin[which[s]] + place - left - (np.cumsum(long) - long), long) + np.arange(long.sum())]

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, (key, place, left, right, _), _, data in surroundings(batches):
            window, sign = signed_runs(key, _spread(data, left, right, width), width)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((key[window], doc[window], place[window], left[window], right[window], sign.view(np.int64)), signs)], schema=signs)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, (key, place, left, right, dealt), long, data in surroundings(batches):
            offsets = np.concatenate([[0], np.cumsum(long * 4)]).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip((key, doc, place, left, right, dealt), around)), context], schema=around)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key. Whole keys are compared, some at once."""

        def passages(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, doc, place, left, right, dealt = (t.column(c).to_numpy().astype(np.int64) for c in around.names[:-1])
            group = np.cumsum(np.diff(key, prepend=~key[:1]) != 0)
            context = _spread(np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint32), left, right, width)
            n = len(group)
            links = np.union1d(exact_links(group, context, width), near_links(group, context, width, similarity, dealt > 0))
            later, earlier = links // n, links % n
            apart = doc[later] != doc[earlier]
            later, earlier = later[apart], earlier[apart]
            for lo in range(0, len(later), _PAIRS_AT_ONCE):
                a, b = later[lo : lo + _PAIRS_AT_ONCE], earlier[lo : lo + _PAIRS_AT_ONCE]
                at, begin, end, other_begin, other_end, alike = verified(context[a], context[b], width, similarity)
                a, b = a[at], b[at]
                at_a, at_b = place[a] - width + 1, place[b] - width + 1
                rows = np.stack([doc[a], doc[b], begin + at_a, end + at_a, other_begin + at_b, other_end + at_b])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*rows, np.round(alike, 6)], found)], schema=found)

        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < _AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield from passages(t.slice(0, whole))
                t = t.slice(whole).combine_chunks()
                held, rows = t.to_batches(), t.num_rows
        if rows:
            yield from passages(pa.Table.from_batches(held))

    long = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * (width + size - 1) - 1)).select("doc_id", "text")
    rows = over_batches(long, local, columns, arrow)
    rows, path = cut(rows.repartition("key").sortWithinPartitions("key", "other", "doc_id", "place").mapInArrow(in_worker(over_all), columns), "windows")
    plain = rows.where("left < 0").select(
        "doc_id", F.col("other").alias("first_id"), F.col("place").alias("begin"), F.expr("place - left").alias("end"), F.expr("place - right").alias("first_begin"), F.expr("place - left - right").alias("first_end"), F.lit(1.0).alias("similarity")
    )
    asked, paths = rows.where("left >= 0").select("key", "doc_id", "place", "left", "right", F.lit(0).alias("dealt")), [path]
    hot, path = cut(asked.groupBy("key").count().where(F.col("count") > _HOT).select("key"), "hot")
    paths.append(path)

    def with_texts(asked: DataFrame) -> DataFrame:
        asked = asked.groupBy("doc_id").agg(F.collect_set(F.struct("key", "place", "left", "right", "dealt")).alias("windows"))
        return asked.join(long.hint("merge"), "doc_id").select("doc_id", "text", "windows")

    if not hot.isEmpty():
        signed = with_texts(asked.join(hot, "key", "left_semi")).mapInArrow(in_worker(dealt_out), "key long, doc_id long, place int, left int, right int, sign long")
        # signs of the same windows are one: whatever is compared under one of them would be under the others
        one, each = Window.partitionBy("sign"), F.xxhash64("key", "doc_id", "place")
        members = {"kinds": F.bit_xor(each).over(one), "sum": F.sum(each.bitwiseAND(0xFFFFFFFF)).over(one), "n": F.count("*").over(one), "low": F.min("doc_id").over(one), "high": F.max("doc_id").over(one)}
        signed = signed.withColumns(members).where("low < high").select(F.xxhash64("kinds", "sum", "n").alias("key"), "doc_id", "place", "left", "right", F.lit(1).alias("dealt"))
        signed, path = cut(signed, "signs")
        paths.append(path)
        asked = asked.join(hot, "key", "left_anti").unionAll(signed)
    near = with_texts(asked).mapInArrow(in_worker(fetched), "key long, doc_id long, place int, left int, right int, dealt int, context binary")
    near = near.repartition("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(in_worker(among), _FOUND)
    return plain.unionAll(near), paths


def _stretches(found: DataFrame) -> DataFrame:
    """Passages of two documents that overlap in both as one row."""
    one = Window.partitionBy("doc_id", "first_id").orderBy("begin", "end", "first_begin", "first_end")
    before, upto = one.rowsBetween(Window.unboundedPreceding, -1), one.rowsBetween(Window.unboundedPreceding, 0)
    apart = (F.col("begin") >= F.max("end").over(before)) | (F.col("first_begin") >= F.lag("first_end").over(one)) | (F.col("first_end") <= F.lag("first_begin").over(one))
    found = found.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("stretch", F.sum("apart").over(upto))
    ends = (F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("first_begin").alias("first_begin"), F.max("first_end").alias("first_end"))
    out = found.groupBy("doc_id", "first_id", "stretch").agg(*ends, F.min("similarity").alias("similarity"))
    return out.select("doc_id", "begin", "end", "first_id", "first_begin", "first_end", "similarity")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after them."""
    data = text.encode("utf-8", "replace")
    places = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for begin, end in sorted(spans):
        begin, end = places[min(begin, len(places) - 1)], places[min(end, len(places) - 1)]
        out.append(data[at : max(at, begin)])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode()


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without the passages that near_passages() finds to repeat an earlier one.

    Its columns, and every row but those of which nothing but white space is left, stay; texts without a repeat stay as they are, as do null and
    empty texts and rows with a null doc_id. n_chars follows the text. Rows that share a doc_id and a text are cut alike; where a
    doc_id stands for different texts, places can't be told to be one text's, and its rows stay as they are. A very long text is cut in one piece of a worker's memory.
    """
    spans = near_passages(docs, **options).groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"))
    spans = spans.join(texts.where("least <> most"), "doc_id", "left_anti")
    spans, _ = cut(spans, "spans")
    small_batches(docs.sparkSession)

    module = __name__

    @F.pandas_udf("string")
    def cut_out(text, spans):
        settle(module)
        return text.__class__([None if t is None else without(t, [(int(x["begin"]), int(x["end"])) for x in s]) for t, s in zip(text, spans)], dtype=object)

    # the rows' own columns travel in one, so that none clashes with the spans'
    both = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")).join(spans.hint("merge"), "doc_id", "left")
    # one join for all rows, the same at every size as neither side is bounded; only texts with spans go to Python
    both = both.withColumn("less", cut_out(F.when(F.col("spans").isNotNull(), F.col("own").getField("text")), "spans"))
    both = both.where(F.col("spans").isNull() | (F.trim("less") != ""))
    changed = F.col("less").isNotNull()
    new = {"text": F.col("less")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("less").cast(docs.schema["n_chars"].dataType)
    return both.select(*((F.when(changed, new[c]).otherwise(F.col("own").getField(c)) if c in new else F.col("own").getField(c)).alias(c) for c in docs.columns))


def forget() -> None:
    _Tables.power = _Tables.inverse = np.ones(1, np.uint64)
