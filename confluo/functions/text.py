"""Text normalisation (NFKD, ASCII only, lower case, single blanks) and tokens.

Spark has no Unicode normalisation function, so the NFKD→ASCII step is a
``translate`` table built at import time *from a rule* (the Unicode database
of this Python), plus a branch for characters whose ASCII form
is more than one letter (``ﬁ`` → ``fi``).  Everything stays JVM-side.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/strip() whitespace within ASCII is
# \t \n \x0b \x0c \r \x1c \x1d \x1e \x1f and the blank.
_ASCII_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]+"
_NON_ASCII = "[^\\x00-\\x7F]"
# Word characters of Python's (?u)\w: letters, numbers, underscore.
_NON_WORD = "[^\\p{L}\\p{N}_]+"
_SEP = "\x01"  # ASCII control character; never part of an expansion
_TO = "\x02"  # likewise
_SENTINEL = "\ue000"  # private use; marks a character with a multi-letter ASCII form


@functools.lru_cache(maxsize=1)
def _nfkd_ascii_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) for one-letter ASCII forms and the multi-letter expansions.

    Derived per code point: NFKD of a string is the concatenation of the
    per-character decompositions up to reordering of combining marks, which
    are not ASCII and are dropped anyway, so per-character mapping is exact.
    """
    src, dst, multi = [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if not unicodedata.decomposition(ch):   # no decomposition: not ASCII, dropped
            continue
        out = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif len(out) > 1:
            multi.append((ch, out))
    return "".join(src), "".join(dst), tuple(multi)


def normalize_text(c: Column) -> Column:
    """NFKD → drop non-ASCII → lower → trim → collapse whitespace; null → null.

    One ``translate`` maps every character with a one-letter ASCII form and
    marks the multi-letter ones with a sentinel; only values holding a marked
    character (``…``, ``™``, ``½``) take the expansion branch, which replaces
    the marked characters they hold.  A character
    class test (``rlike``) would cost ~40× more: Java checks the class
    members one by one.
    """
    src, dst, multi = _nfkd_ascii_tables()
    s = F.translate(c, src, dst)
    if multi:
        msrc = "".join(ch for ch, _ in multi)
        marked = F.translate(c, src + msrc, dst + _SENTINEL * len(msrc))
        # a constant map from one literal (folded once by the optimizer); only the
        # marked characters that a value holds are looked up and replaced
        forms = F.str_to_map(F.lit(_SEP.join(a + _TO + b for a, b in multi)), F.lit(_SEP), F.lit(_TO))
        held = F.array_distinct(F.regexp_extract_all(c, F.lit(_NON_ASCII), F.lit(0)))
        here = F.filter(held, lambda ch: F.map_contains_key(forms, ch))
        expanded = F.aggregate(here, s, lambda acc, ch: F.replace(acc, ch, F.element_at(forms, ch)))
        s = F.when(F.instr(marked, _SENTINEL) > 0, expanded).otherwise(marked)
    s = F.regexp_replace(s, _NON_ASCII, "")
    s = F.lower(s)
    s = F.regexp_replace(s, _ASCII_WS, " ")
    return F.trim(s)


def split_words(c: Column, lowercase: bool = True) -> Column:
    """The value lower-cased and split at every run of non-word characters
    (pieces may be empty or one character long)."""
    return F.split(F.lower(c) if lowercase else c, _NON_WORD)
