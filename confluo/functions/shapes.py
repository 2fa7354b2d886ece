"""Value shapes: letters → ``[a-zA-Z]``, digits → ``[0-9]``, the rest verbatim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two class tokens a shape is written with.
ALPHA_TOKEN = "[a-zA-Z]"
DIGIT_TOKEN = "[0-9]"


def value_shape(c: Column) -> Column:
    """Each maximal run of letters becomes ``[a-zA-Z]``, each run of numeric
    characters ``[0-9]``; other characters are kept.  Null stays null."""
    s = F.regexp_replace(c, "\\p{L}+", ALPHA_TOKEN)
    # the letters inserted above are not numeric, so the second pass is safe
    return F.regexp_replace(s, "\\p{N}+", DIGIT_TOKEN)


def _quote(lit: str) -> str:
    return "\\Q" + lit.replace("\\E", "\\E\\\\E\\Q") + "\\E" if lit else ""


def shape_to_regex(shape: str) -> str:
    """An anchored Java regex matching exactly the values of this shape."""
    out, lit, i = [], [], 0
    while i < len(shape):
        for tok, klass in ((ALPHA_TOKEN, "\\p{L}+"), (DIGIT_TOKEN, "\\p{N}+")):
            if shape.startswith(tok, i):
                out.append(_quote("".join(lit)))
                lit = []
                out.append(klass)
                i += len(tok)
                break
        else:
            lit.append(shape[i])
            i += 1
    out.append(_quote("".join(lit)))
    return "^" + "".join(out) + "\\z"  # Java's $ also matches before a last newline
