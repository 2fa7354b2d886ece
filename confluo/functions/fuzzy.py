"""Token-sort name score: 100 · 2·LCS / (len a + len b), rounded half to even.

The LCS is a native higher-order SQL expression (no Python UDF): the
bit-parallel algorithm of Crochemore et al. (2001) in one 64-bit word for the
shorter string up to 62 characters, and the classic dynamic programme above.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The library's ASCII step removes the Latin-1 range U+0080–U+00FF;
# word characters are letters, numbers and the underscore.
_LATIN1 = "[\\x{80}-\\x{FF}]"
_NON_WORD_CHAR = "[^\\p{L}\\p{N}_]"
_WORD_BITS = 62  # keeps w_ + u_ below 2^63 (ANSI overflow checks)


def name_key(c: Column) -> Column:
    """Processed, token-sorted form of a name: drop U+0080–U+00FF, every
    non-word character → blank, lower, split, sort, join with one blank."""
    s = F.regexp_replace(c, _LATIN1, "")
    s = F.regexp_replace(s, _NON_WORD_CHAR, " ")
    s = F.trim(F.lower(s))
    toks = F.filter(F.split(s, " +"), lambda t: t != F.lit(""))
    return F.array_join(F.array_sort(toks), " ")


def _lcs_short_long(s: str, l: str) -> str:
    """SQL for LCS(s, l) where length(s) <= length(l)."""
    n = f"length({s})"
    mask = f"(shiftleft(1L, {n}) - 1L)"
    bits = (
        f"({n} - bit_count(aggregate(split({l}, ''), {mask}, (v_, ch_) -> "
        f"aggregate(array(v_ & aggregate(sequence(1, {n}), 0L, "
        f"(m_, i_) -> if(substr({s}, i_, 1) = ch_, m_ | shiftleft(1L, i_ - 1), m_))), v_, "
        f"(w_, u_) -> ((w_ + u_) | (w_ - u_)) & {mask}))))"
    )
    dp = (
        f"element_at(aggregate(split({l}, ''), array_repeat(0, {n} + 1), (p_, ch_) -> "
        f"aggregate(sequence(1, {n}), array(0), (c_, i_) -> concat(c_, array("
        f"if(substr({s}, i_, 1) = ch_, element_at(p_, i_) + 1, "
        f"greatest(element_at(p_, i_ + 1), element_at(c_, i_))))))), -1)"
    )
    return f"(CASE WHEN {n} = 0 THEN 0 WHEN {n} <= {_WORD_BITS} THEN {bits} ELSE {dp} END)"


def lcs_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) <= length({b}) THEN {_lcs_short_long(a, b)} "
            f"ELSE {_lcs_short_long(b, a)} END)")


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two string columns (names)."""
    return F.expr(lcs_sql(_q(a), _q(b)))


def ratio_sql(a: str, b: str) -> str:
    lcs = lcs_sql(a, b)
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL "
            f"WHEN {a} = {b} THEN 100 "
            f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
            f"ELSE CAST(bround(100D * (CAST(2 * {lcs} AS DOUBLE) / "
            f"(length({a}) + length({b}))), 0) AS INT) END)")


def name_ratio(key_a: str, key_b: str) -> Column:
    """Score 0–100 of two *processed* name keys (see :func:`name_key`)."""
    return F.expr(ratio_sql(_q(key_a), _q(key_b)))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
