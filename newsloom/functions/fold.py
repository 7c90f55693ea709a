"""Accent folding inside the JVM, from tables derived from the Unicode character database.

``fold_accents`` equals compatibility decomposition (NFKD) without U+0300..U+036F. Spark has no
function for it and a Python function would take every title, description, URL and entity list
out of the JVM, so the decomposition is expressed with ``translate`` (characters that fold to one
character), a lookup for the few that fold to several, and arithmetic for Hangul syllables.
ASCII rows skip all of it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL = range(0xAC00, 0xD7A4)
_PAIR, _KEY = "\u0001", "\u0002"
_USUAL_BLOCKS = (range(0, 0x530), range(0x2010, 0x203C))


def _folded(c: str) -> str:
    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", c))


@cache
def _tables() -> tuple[str, str, str, str, str]:
    """``(from, to)`` for translate; exact and coarse pattern of several-character folds; their table.

    The coarse pattern is "anything but these few blocks without such characters" (Latin, Greek,
    Cyrillic, typographic punctuation). ASCII characters are passed over before its many ranges are asked, so the usual
    text is cleared at a test per character.
    """
    single, several, dropped = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or cp in _HANGUL:
            continue
        c = chr(cp)
        f = _folded(c)
        if f == c:
            continue
        (single if len(f) == 1 else several if f else dropped).append((c, f))
    matching = "".join(c for c, _ in single) + "".join(c for c, _ in dropped)
    replacing = "".join(f for _, f in single)
    points = [ord(c) for c, _ in several]
    pattern = "[" + "".join(_ranges(points)) + "]"
    held = set(points)
    harmless = [cp for block in _USUAL_BLOCKS for cp in block if cp not in held]
    coarse = r"(?![\x00-\x7f])[^" + "".join(_ranges(harmless)) + "]"
    table = _PAIR.join(f"{c}{_KEY}{f}" for c, f in several)
    return matching, replacing, pattern, coarse, table


def _ranges(points: list[int]) -> list[str]:
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\x{{{start:x}}}" + (f"-\\x{{{p:x}}}" if p > start else ""))
            start = None
    return out


def code_point(number: Column) -> Column:
    """The character of a code point."""
    # Decode "A" + code point and drop the "A", so U+FEFF is not taken for a byte order mark.
    raw = F.unhex(F.concat(F.lit("00000041"), F.lpad(F.hex(number), 8, "0")))
    return F.substring(F.decode(raw, "UTF-32"), 2, 2)


def _jamo(c: Column) -> Column:
    s = F.ascii(c) - 0xAC00
    tail = s % 28
    return F.concat(
        code_point(F.lit(0x1100) + F.floor(s / 588)),
        code_point(F.lit(0x1161) + F.floor(s % 588 / 28)),
        F.when(tail > 0, code_point(F.lit(0x11A7) + tail)).otherwise(""),
    )


def fold_accents(text: Column) -> Column:
    matching, replacing, pattern, coarse, table = _tables()
    lookup = F.str_to_map(F.lit(table), F.lit(_PAIR), F.lit(_KEY))

    def several(c: Column) -> Column:
        return F.when(c.rlike(pattern), F.try_element_at(lookup, c)).when(c.between("가", "힣"), _jamo(c)).otherwise(c)

    # Each distinct character that folds to several is looked up and replaced once, in rows that may hold any: a text costs
    # its kinds of such characters, not its length. No fold holds a character that has a fold itself, so the order is free.
    kinds = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern}|[가-힣])"), F.lit(1)))
    spelled = F.when(text.rlike(coarse), F.aggregate(kinds, text, lambda done, c: F.replace(done, c, several(c)))).otherwise(text)
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(F.translate(spelled, matching, replacing))
