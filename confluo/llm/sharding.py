"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone: no ring, no
table.  When a shard is appended, a key either stays or goes to the new shard.
Only DataFrame expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import number_within

#: The paper's 64-bit linear congruential multiplier, in two 32-bit halves.
JUMP_MULTIPLIER = 2862933555777941757
_HIGH, _LOW = JUMP_MULTIPLIER >> 32, JUMP_MULTIPLIER & 0xFFFFFFFF
_MASK = 0xFFFFFFFF


def key_digest(key: Column) -> Column:
    """md5 of the key as text (null: the empty text), in hex.  Its first 64
    bits are the jump hash's key."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, hi * 2**32 + lo times the multiplier plus 1
    mod 2**64, in products that stay below 2**63."""
    part = lo * F.lit(_LOW & 0xFFFF) + F.lit(1)
    upper = lo * F.lit(_LOW >> 16)
    low = part + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    cross = (hi * F.lit(_LOW & 0xFFFF)
             + F.shiftleft((hi * F.lit(_LOW >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))
    high = carry + (lo * F.lit(_HIGH)).bitwiseAND(F.lit(_MASK)) + cross.bitwiseAND(F.lit(_MASK))
    return high.bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))


def _jump(state: Column, shards: int) -> Column:
    """One jump: the state (hi, lo, b, j) moves while j < shards; b is the last
    shard reached below ``shards``."""
    hi, lo = _next_key(state["hi"], state["lo"])
    # (b + 1) * 2**31 / ((key >> 33) + 1), in doubles as in the paper
    step = F.struct(
        hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), F.lit(0).cast("long").alias("j"))
    moved = F.struct(
        step["hi"].alias("hi"), step["lo"].alias("lo"), state["j"].alias("b"),
        F.floor((state["j"] + F.lit(1)).cast("double")
                * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")))
        .cast("long").alias("j"))
    return F.when(state["j"] < F.lit(shards), moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, 0 .. shards-1) of a key of any type.

    Most keys end within a few jumps (about ln(shards)); a fixed number of
    rounds serves them, and the rare key that needs more runs on to its end
    (a key jumps at most ``shards`` times).
    """
    digest = key_digest(key)
    begin = F.struct(
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("hi"),
        F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    most = shards + 1
    few = min(most, 12 + 4 * math.ceil(math.log(shards + 1)))
    run = lambda start, n: F.aggregate(
        F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: _jump(s, shards))
    state = run(begin, few)
    if few == most:
        return state["b"].cast("int")
    end = F.when(state["j"] >= F.lit(shards), state["b"]).otherwise(run(state, most)["b"])
    return end.cast("int")


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               grown: int | None = None, place: tuple[Column, Column] | None = None) -> DataFrame:
    """Every row's shard and its place there.

    Returns ``(id, size, text_crc32, law, shard, slot, grown_shard)``.  The law
    is ``key``: the id and the shard count decide, so rows of equal texts and
    different ids may part, while rows repeating an id stay together.  ``size``
    is the text's UTF-8 bytes plus 16; a null text has none and crc32 0; a null
    id counts as the empty text.  ``slot`` runs from 0 without gaps in each
    shard, in a hash order; ``grown_shard`` is the shard among ``grown``
    (default one more).  Rows are numbered in 4096 hash buckets of each shard,
    so no task holds a shard; only id, size and crc32 are shuffled.  With
    ``place``, slots follow an order of the rows instead: ``(part, within)``, a
    part of limited size and the rows' order in it.  Columns of ``df`` other
    than those named are not read.  An empty table gives an empty result.
    """
    grown = shards + 1 if grown is None else grown
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    bucket, within = place or (
        F.substring(F.md5(F.concat_ws(":", key_digest(key), F.crc32(text.cast("binary")))), 1, 3), F.lit(0))
    rows = df.select(
        key, (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, grown).alias("grown_shard"),
        bucket.alias("__bucket"), within.alias("__within"))
    out = number_within(rows, "shard", "__bucket", ["__within", id_col, "text_crc32", "size"], "slot")
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
