"""Expressions on names: patterns, canonical spellings and repairs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a placeholder, odd or damaged text.
PLACEHOLDERS = ("n/a", "n_a", "n.a.", "null", "none", "unknown", "undefined")
INVISIBLE = r"[\p{Cf}&&[^\x{200C}\x{200D}]]|\p{Cc}"
ODD_SPACE = r"[\p{Zs}&&[^ ]]|[\t\n\r]"
SCRIPTS = ("Latin", "Cyrillic", "Greek")
ROMAN = r"^[IVXLCDM]+$"
_TAIL = "[\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"
MOJIBAKE = f"[Â-ß]{_TAIL}|[à-ï]{_TAIL}{_TAIL}"
STRONG_MOJIBAKE = f"[ÂÃ]{_TAIL}|â€|ï¿½|[\u0080-\u009f]"
IMPLAUSIBLE = "[^ -~ -ɏḀ-ỿ‘-”–—€]|[¡-¿×÷]"

#: The byte of each character that code page 1252 gives to 0x80-0x9F; other characters below 256 are their own byte.
_BYTES = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def repaired(name: str | None) -> str | None:
    """A name that was UTF-8 and read as code page 1252, read again; None unless it looks so, every character has a byte, the bytes are UTF-8 and what they say is plausible."""
    if name is None or not re.search(MOJIBAKE, name):
        return None
    data = [_BYTES.get(c, ord(c) if ord(c) < 256 else None) for c in name]
    if None in data:
        return None
    try:
        out = bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if re.search(IMPLAUSIBLE, out) else out


@F.pandas_udf(T.StringType())
def repair(names: pd.Series) -> pd.Series:
    return names.map(repaired, na_action="ignore").astype(object).where(lambda x: x.notna(), None)


@F.pandas_udf(T.StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Canonical composition."""
    return names.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def unaccented(names: pd.Series) -> pd.Series:
    """Without combining marks."""
    return names.map(lambda s: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))), na_action="ignore")


def cleaned(name: Column) -> Column:
    """Repaired, with plain spaces, without invisible characters, composed, single-spaced and trimmed."""
    out = F.regexp_replace(F.coalesce(repair(name), name), ODD_SPACE, " ")
    return F.trim(F.regexp_replace(nfc(F.regexp_replace(out, INVISIBLE, "")), " {2,}", " "))


def squashed(text: Column) -> Column:
    """Separators between letters dropped, other punctuation one space."""
    other = r"[^\p{L}\p{M}\p{N}]+"
    joined = F.regexp_replace(text, rf"([\p{{L}}\p{{M}}]){other}(\p{{L}})", "$1$2")
    return F.trim(F.regexp_replace(joined, other, " "))


def tokens(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def letters_only_of(text: Column, scripts: tuple[str, ...]) -> Column:
    allowed = "".join(rf"\p{{Is{s}}}" for s in scripts)
    return ~text.rlike(rf"[\p{{L}}&&[^{allowed}]]")
