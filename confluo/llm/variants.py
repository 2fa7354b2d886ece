"""Spelling variants: each word's near words, the form it stands for, its root.

Two words are near if they differ by one inserted, deleted or replaced
character.  A word's edits are generated and probed against a Bloom filter of
the vocabulary, which is broadcast in shards by word length: a word of m
characters looks for its replacements in shard m and for its deletions in shard
m - 1 (an insertion is the other word's deletion).  Only what the filter lets
through is shuffled, to an exact join with the vocabulary that removes the
false positives.

The filter is blocked (Putze et al., 2007): a word sets one bit in each of the
eight 32-bit lanes of a single block.  Its size never exceeds ``most_filter_bytes``;
a vocabulary too large for 16 bits a word gets fewer, so that more false
positives reach the join and the result stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from confluo.llm.common import BYTE_VALUES, lower_ascii, mix, powers, written

#: The characters of words, as a class of a regular expression: Latin letters
#: up to U+00FF (with the two signs among them), one byte each in Latin-1.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: The characters that words can have once A-Z is lower-cased.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)
#: Fixed odd multipliers, one for each lane of a block (those of Parquet's split block filter).
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31],
                 np.uint32)
BLOCK_BYTES = 32
#: Words of this length and longer share one shard.
LONGEST = 255
#: Blocks that one row of the filter holds while it is built.
SEGMENT = 256


def words_of(text: Column, doc_id: Column, least_length: int, damage: int | None) -> Column:
    """The words of a text as an array: maximal runs of :data:`LETTERS` of at
    least ``least_length`` characters, A-Z lower-cased.

    ``damage``: with h the unsigned CRC-32 of ``<doc_id>:<run>``, runs whose h
    it divides lose their character h % length.
    """
    # a shorter run has no match; a longer one matches whole
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0)), lower_ascii)
    if damage is None:
        return runs

    def damaged(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % damage == 0, F.concat(F.substring(run, F.lit(1), at),
                                                F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return F.transform(runs, damaged)


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
               least_count: int = 5, damage: int | None = None) -> DataFrame:
    """``(word, n)``: the words of at least ``least_length`` characters that
    occur at least ``least_count`` times in all texts.  Null texts have none."""
    words = df.select(F.explode(words_of(F.col(text_col), F.col(id_col), least_length, damage)).alias("word"))
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' characters end to end, one byte each, and their offsets."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


@arrow_udf(LongType())
def word_hash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The words' 64-bit hashes: a polynomial in their characters, mixed."""
    for batch in batches:
        codes, offsets = _codes(batch)
        up, _ = powers(int(np.diff(offsets).max(initial=0)))
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[codes] * up[place], out=sums[1:])
        yield pa.array(mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """The bit that each hash sets in each of the eight lanes."""
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return (low[:, None] * SALTS[None, :]) >> np.uint32(27)


def bloom_filter(words: DataFrame, most_filter_bytes: int, bits: int = 16) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """The blocked filter of ``words (word)`` as rows of eight lanes, and each
    length's ``(first block, blocks)``.

    Built in segments on the executors; what reaches the driver is the filter,
    at most ``most_filter_bytes`` and a block for each of up to 255 lengths.
    """
    shard = F.least(F.length("word"), F.lit(LONGEST))
    counts = {r.shard: r["count"] for r in words.groupBy(shard.alias("shard")).count().collect()}
    bits = min(bits, 8 * most_filter_bytes / max(1, sum(counts.values())))
    shards, blocks = {}, 0
    for length, n in sorted(counts.items()):
        size = max(1, int(n * bits / (8 * BLOCK_BYTES)))
        shards[length] = (blocks, size)
        blocks += size
    filled = np.zeros((blocks, 8), np.uint32)
    if not shards:
        return filled, shards
    first = F.create_map(*[F.lit(x) for k, (a, _) in shards.items() for x in (k, a)])
    size = F.create_map(*[F.lit(x) for k, (_, b) in shards.items() for x in (k, b)])
    placed = words.select(shard.alias("shard"), word_hash(F.col("word")).alias("hash")).select(
        (first[F.col("shard")] + F.shiftright(F.shiftrightunsigned("hash", 32) * size[F.col("shard")], 32)).alias("block"), "hash")

    def build(table: pa.Table) -> pa.Table:
        part = np.zeros((SEGMENT, 8), np.uint32)
        block = table["block"].to_numpy() % SEGMENT
        lanes = _lanes(table["hash"].to_numpy().view(np.uint64))
        for lane in range(8):
            np.bitwise_or.at(part[:, lane], block, np.uint32(1) << lanes[:, lane])
        return pa.table({"segment": [table["segment"][0].as_py()], "lanes": [part.tobytes()]})

    rows = (placed.withColumn("segment", F.floor(F.col("block") / SEGMENT).cast("long"))
            .groupBy("segment").applyInArrow(build, "segment long, lanes binary").collect())
    for r in rows:
        at = r.segment * SEGMENT
        part = np.frombuffer(r.lanes, np.uint32).reshape(SEGMENT, 8)
        filled[at:at + SEGMENT] = part[:blocks - at]
    return filled, shards


def _present(hashes: np.ndarray, filled: np.ndarray, shard: tuple[int, int] | None) -> np.ndarray:
    """Places of the hashes that the shard may hold."""
    if shard is None or not len(hashes):
        return np.zeros(0, np.int64)
    first, size = shard
    block = first + (((hashes >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    alive = np.arange(len(hashes))
    for lane, salt in enumerate(SALTS):
        bit = (low[alive] * salt) >> np.uint32(27)
        alive = alive[(filled[block[alive], lane] >> bit) & np.uint32(1) > 0]
        if not len(alive):
            break
    return alive


def edits_in(words: np.ndarray, filled: np.ndarray, shards: dict[int, tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """``(row, edit)`` of what the filter may hold of the words' deletions and
    of their replacements by a greater character.  ``words``: a row of
    characters each, all of one length."""
    n, m = words.shape
    up, down = powers(m)
    values = BYTE_VALUES[words]
    sums = np.zeros((n, m + 1), np.uint64)
    np.cumsum(values * up[:m], axis=1, out=sums[:, 1:])
    whole = sums[:, -1]
    same, shorter = shards.get(min(m, LONGEST)), shards.get(min(m - 1, LONGEST))
    for i in range(m):
        row, new = np.nonzero(ALPHABET[None, :] > words[:, i:i + 1])
        h = mix(whole[row] + (BYTE_VALUES[ALPHABET[new]] - values[row, i]) * up[i])
        for k in _present(h, filled, same):
            yield int(row[k]), words[row[k], :i].tobytes() + bytes([ALPHABET[new[k]]]) + words[row[k], i + 1:].tobytes()
        # without character i; of equal neighbours the last one goes
        row = np.arange(n) if i == m - 1 else np.flatnonzero(words[:, i] != words[:, i + 1])
        h = mix(sums[row, i] + (whole[row] - sums[row, i + 1]) * down[1])
        for k in _present(h, filled, shorter):
            yield int(row[k]), words[row[k], :i].tobytes() + words[row[k], i + 1:].tobytes()


def near_words(vocab: DataFrame, most_filter_bytes: int = 64 << 20) -> DataFrame:
    """``(word, n, near, near_n)``: both directions of all pairs of near words
    of a written ``vocab (word, n)``."""
    spark = vocab.sparkSession
    filled, shards = bloom_filter(vocab, most_filter_bytes)
    shared = spark.sparkContext.broadcast((filled, shards))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, shards = shared.value
        for batch in batches:
            codes, offsets = _codes(batch["word"])
            counts = batch["n"].to_numpy()
            lengths = np.diff(offsets)
            for m in np.unique(lengths):
                rows = np.flatnonzero(lengths == m)
                for some in np.array_split(rows, -(-len(rows) * int(m) // 200_000)):
                    words = codes[offsets[some][:, None] + np.arange(m)]
                    found = list(edits_in(words, filled, shards))
                    if found:
                        at = [k for k, _ in found]
                        yield pa.RecordBatch.from_pydict({
                            "word": [words[k].tobytes().decode("latin-1") for k in at],
                            "n": pa.array(counts[some][at], pa.int64()),
                            "edit": [e.decode("latin-1") for _, e in found]})

    # words are few and light: dealt out by number, they keep all cores busy
    dealt = vocab.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    edits = dealt.mapInArrow(probe, "word string, n long, edit string")
    pairs = written(edits.join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit"), "variant-pairs")
    return pairs.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")).unionByName(
        pairs.select(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(links: DataFrame, depth: int) -> DataFrame:
    """``(word, root)`` of ``links (word, form)``, written, whose chains have at
    most ``depth`` links: every round follows twice as many of them."""
    now = links.select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(max(1, depth)))):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                      f"variant-roots-{i}")
    return now


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
                      least_count: int = 5, ratio: int = 5, damage: int | None = None,
                      most_filter_bytes: int = 64 << 20) -> DataFrame:
    """The words of a corpus with what they may be variants of.

    Returns ``(word, n, n_near, form, form_n, root)``.  ``n``: occurrences,
    ``n_near``: the number of near words, ``form``: of the near words the one
    that occurs most often (of several the first in code-point order), if it
    occurs at least ``ratio`` times as often as the word, else null; ``root``:
    the last form that forms lead to, the word itself where it has none.

    ``damage``: see :func:`words_of`.  Null and empty texts have no words, a
    null id counts as an empty one, a repeated row counts as often as it
    stands, an empty table gives no rows.  Other columns are not read.
    """
    vocab = written(vocabulary(df, id_col, text_col, least_length, least_count, damage), "variant-words")
    near = near_words(vocab, most_filter_bytes)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"),
                                    F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    best = written(best.select("word", "n_near", F.when(-F.col("best.n") >= ratio * F.col("n"), F.struct(
        F.col("best.near").alias("form"), (-F.col("best.n")).alias("form_n"))).alias("up")), "variant-best")
    links = best.where("up is not null").select("word", "up.form")
    # along a chain counts grow by the ratio at least
    top = vocab.agg(F.max("n")).first()[0] or 1
    depth = 1
    while least_count * ratio ** (depth + 1) <= top:
        depth += 1
    return (vocab.join(best, "word", "left").join(roots(links, depth), "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.col("up.form").alias("form"), F.col("up.form_n").alias("form_n"),
                    F.coalesce("root", "word").alias("root")))
