"""Hierarchical codes: how they are built, taken apart and continued."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeFormat:
    """root code, delimiter between levels ('' for none), and the least width of a level's number: one for all, one for each, or 'auto'."""

    root: str
    delimiter: str = "."
    min_width: int | tuple[int, ...] | str = 3

    def width(self, level: int) -> int | None:
        """The least width at a level from 1; None where it follows from the numbers."""
        if self.min_width == "auto":
            return None
        if isinstance(self.min_width, tuple):
            if level > len(self.min_width):
                raise ValueError(f"no width for level {level}")
            return self.min_width[level - 1]
        return int(self.min_width)


def parse_min_width(text: str) -> int | tuple[int, ...] | str:
    if text == "auto":
        return text
    if not re.fullmatch(r"\d+(,\d+)*", text):
        raise ValueError(f"{text!r} is no width, list of widths or 'auto'")
    widths = tuple(int(x) for x in text.split(","))
    return widths[0] if len(widths) == 1 else widths


def built(parent: Column, number: Column, width: Column | int, delimiter: str) -> Column:
    """A child's code: never cut, zeros before it up to the width."""
    digits = number.cast("string")
    wide = F.greatest(F.lit(width) if isinstance(width, int) else width, F.length(digits)).cast("int")
    return F.concat(parent, F.lit(delimiter), F.lpad(digits, wide, "0"))


def last_part(code: Column, parent: Column, delimiter: str) -> Column:
    """What a code adds to its parent's; null if it doesn't begin with it."""
    head = F.concat(parent, F.lit(delimiter))
    return F.when(code.startswith(head), F.substring(code, F.length(head) + 1, F.length(code)))


def used_number(code: Column, parent: Column, delimiter: str) -> Column:
    """A direct child's number; null for others and for what is no number."""
    tail = last_part(code, parent, delimiter)
    return F.when(tail.rlike("^[0-9]+$"), tail.try_cast("long"))


def detected(values: Sequence[tuple[int, str]]) -> CodeFormat:
    """The format of (level, code) values: one shared non-alphanumeric delimiter or none, one root, the usual width of each level."""
    marks = {m for _, v in values for m in re.findall(r"[^A-Za-z0-9]", v)}
    if len(marks) > 1:
        raise ValueError(f"codes hold several delimiters: {', '.join(sorted(marks))}")
    mark = next(iter(marks), "")
    if mark:
        roots = {v.split(mark)[0] for _, v in values}
        widths: dict[int, Counter] = {}
        for level, v in values:
            if level:
                widths.setdefault(level, Counter())[len(v.split(mark)[-1])] += 1
    else:
        roots = {re.match(r"\D*", v)[0] for _, v in values}
        lengths: dict[int, set[int]] = {}
        for level, v in values:
            lengths.setdefault(level, set()).add(len(v))
        if any(len(x) > 1 for x in lengths.values()):
            raise ValueError("codes without a delimiter need one length for each level")
        root = len(next(iter(roots)))
        at, widths = root, {}
        for level in sorted(n for n in lengths if n):
            size = next(iter(lengths[level]))
            widths[level] = Counter({size - at: 1})
            at = size
    if len(roots) != 1:
        raise ValueError(f"codes have several roots: {', '.join(sorted(roots)[:5])}")
    usual = tuple(min(w for w, n in c.items() if n == max(c.values())) for _, c in sorted(widths.items()))
    return CodeFormat(next(iter(roots)), mark, usual[0] if len(set(usual)) == 1 else usual)
