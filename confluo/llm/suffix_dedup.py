"""Suffix-array deduplication with a logarithmic index family.

A byte is removed when a string of ``length`` bytes that covers it also starts
earlier, in a document with a smaller id or earlier in the same one.

*Suffixes.*  Each text's suffixes are sampled where the hash of the next
``gram`` bytes is the smallest of a window (winnowing), so that every string of
``length`` bytes holds exactly one sampled suffix, at the same place wherever
the string occurs.  An entry is a suffix's key (the hash of its first ``gram``
bytes), its place, the range of the strings it stands for, and a hash of the
bytes these strings span (its context).

*Index family.*  Entries are spread over the cluster by key.  Each partition
takes them in document order, batch by batch.  A batch is sorted into a suffix
array, merge-scanned against the levels so far, and added as a new level;
levels of equal size merge, so their sizes grow geometrically.  Only the first
occurrence of a (key, context) enters, so a passage repeated in a third of all
documents is one entry.  An entry whose whole context occurred before is
settled; entries that share a key but not the context are read again from the
texts and compared string by string.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm.common import mix, powers, prefix_hashes, text_slices, written

#: Bytes handled at a time; places within a slice take 20 bits.
_SLICE = 1 << 19
_NO_ID = -(1 << 63)
_SALT = 0xA24BAED4963EE407


def _pieces(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of at most ``_SLICE`` bytes: ``(first_row, data, offsets, base)``.
    A text longer than a slice comes in several, each overlapping the next by
    ``length - 1`` bytes; ``base`` is where each row's bytes begin in its text."""
    for row, data, off in text_slices(texts, _SLICE):
        if len(data) <= _SLICE:
            yield row, data, off, np.zeros(len(off) - 1, np.int64)
        else:
            step = _SLICE - length + 1
            for a in range(0, max(1, len(data) - length + 1), step):
                part = data[a:a + _SLICE]
                yield row, part, np.array([0, len(part)]), np.array([a])


def suffix_entries(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of texts laid end to end (fewer than 2**20 bytes):
    ``(row, first, count, key, context)``: the strings starting at ``first`` ..
    ``first + count - 1`` are the ones this suffix stands for."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none
    up, down = powers(n)
    p = prefix_hashes(data, up)
    grams = mix((p[gram:] - p[:-gram]) * down[:n - gram + 1])
    low = np.uint64((1 << 20) - 1)
    v = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    w = length - gram + 1
    # smallest of each w values: running minima of blocks from both ends
    m = -(-len(v) // w) * w
    padded = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - length + 1
    at = (np.minimum(back[:strings], ahead[w - 1:w - 1 + strings]) & low).astype(np.int64)
    row = np.searchsorted(off, np.arange(strings), side="right") - 1
    inside = np.arange(strings) + length <= off[row + 1]
    change = np.ones(strings, bool)
    change[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change)
    # strings that cross a text's end follow those inside it
    total = np.concatenate([[0], np.cumsum(inside)])
    end = np.append(first[1:], strings)
    count = total[end] - total[first]
    keep = (count > 0) & inside[first]
    first, count = first[keep], count[keep]
    anchor = at[first]
    span = (p[first + count - 1 + length] - p[first]) * down[first]
    context = mix(span + (count * 256 + anchor - first).astype(np.uint64) * np.uint64(_SALT))
    return row[first], first, count, grams[anchor].view(np.int64), context.view(np.int64)


def _entries(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(key, id, place, context)`` of all sampled suffixes; place = first
    byte << 32 | 24 bits of the text's checksum << 8 | number of strings.
    Of the entries of one key and context that a batch of rows holds, all but
    the earliest are settled here: they go on with a null context and a key that
    spreads them, so repeated passages do not pile up in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sums = batch.column(2).to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, ...]] = []
            for top, data, off, base in _pieces(batch.column(1), length):
                row, first, count, key, context = suffix_entries(data, off, length, gram)
                start = first - off[row] + base[row]
                held.append((key, ids[top + row], (start << 32) | (sums[top + row] << 8) | count, context))
            if not held:
                continue
            key, ident, place, context = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((place, ident, context, key))
            key, ident, place, context = key[order], ident[order], place[order], context[order]
            _, known = _first_seen(key, ident, place, context)
            spread = np.where(known, mix(place.view(np.uint64) + ident.view(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(ident), pa.array(place), pa.array(context, mask=known)],
                ["key", "id", "place", "context"])

    return docs.mapInArrow(run, "key long, id long, place long, context long")


def _first_seen(key: np.ndarray, ident: np.ndarray, place: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in order of (key, context, id, place): which begin a (key,
    context), and which have an earlier one before them.  Rows repeating an id
    may tie in place: neither is earlier."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return new, ~new & ((ident != ident[head]) | ((place >> 32) != (place[head] >> 32)))


class SuffixFamily:
    """Levels of sorted suffix entries; sizes grow by factors of two."""

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []

    def scan(self, key: np.ndarray, ident: np.ndarray, place: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, list]:
        """Adds a batch in document order.  Returns the rows of the batch whose
        context occurred earlier, and ``(key, id, place)`` arrays of the entries,
        of this batch or earlier ones, that newly share a key with another context."""
        order = np.lexsort((place, ident, context, key))
        key, ident, place, context = key[order], ident[order], place[order], context[order]
        new, known = _first_seen(key, ident, place, context)
        shared = np.zeros(len(key), bool)
        out = []
        both = mix(key.view(np.uint64) * np.uint64(_SALT) + context.view(np.uint64))
        for level in self.levels:
            lo, hi = np.searchsorted(level["key"], key, "left"), np.searchsorted(level["key"], key, "right")
            at = np.minimum(np.searchsorted(level["both_sorted"], both), len(level["both_sorted"]) - 1)
            same = level["both_sorted"][at] == both
            was = level["both_order"][at]
            tie = same & (level["id"][was] == ident) & ((level["place"][was] >> 32) == (place >> 32))
            known |= same & ~tie
            new &= ~same
            shared |= (hi > lo) & ~same
            # the level's entries under those keys, once each
            ask = (hi > lo) & ~same
            touched = np.zeros(len(level["key"]) + 1, np.int64)
            np.add.at(touched, lo[ask], 1)
            np.add.at(touched, hi[ask], -1)
            fresh = (np.cumsum(touched[:-1]) > 0) & ~level["sent"]
            if fresh.any():
                out.append((level["key"][fresh], level["id"][fresh], level["place"][fresh]))
                level["sent"] |= fresh
        shared &= new
        k = np.flatnonzero(new)
        if len(k):
            twins = np.zeros(len(k), bool)
            equal = key[k][1:] == key[k][:-1]
            twins[1:] |= equal
            twins[:-1] |= equal
            send = twins | shared[k]
            if send.any():
                out.append((key[k][send], ident[k][send], place[k][send]))
            self._add({"key": key[k], "id": ident[k], "place": place[k], "both": both[k], "sent": send})
        rows = np.zeros(len(order), bool)
        rows[order] = known
        return rows, out

    def _add(self, level: dict[str, np.ndarray]) -> None:
        while self.levels and len(self.levels[-1]["key"]) <= 2 * len(level["key"]):
            other = self.levels.pop()
            names = ("key", "id", "place", "both", "sent")
            joined = {c: np.concatenate([other[c], level[c]]) for c in names}
            order = np.argsort(joined["key"], kind="stable")  # merges two sorted runs
            level = {c: joined[c][order] for c in names}
        order = np.argsort(level["both"], kind="stable")
        level["both_order"], level["both_sorted"] = order, level["both"][order]
        self.levels.append(level)


def _scanned(entries: DataFrame, batch_rows: int) -> DataFrame:
    """``(key, id, place, settled)``: entries whose context occurred before, and
    entries to compare string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, waiting, rows = SuffixFamily(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, rows
            if not rows:
                return
            t = pa.Table.from_batches(waiting)
            waiting, rows = [], 0
            before = t.filter(pc.is_null(t.column(3)))
            t = t.filter(pc.is_valid(t.column(3)))
            key, ident, place, context = (t.column(c).to_numpy() for c in range(4))
            known, asked = family.scan(key, ident, place, context)
            parts = [(*(before.column(c).to_numpy() for c in range(3)), True),
                     (key[known], ident[known], place[known], True), *[(*a, False) for a in asked]]
            for k, i, p, settled in parts:
                if len(k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), pa.array(i), pa.array(p), pa.array(np.full(len(k), settled))],
                        ["key", "id", "place", "settled"])

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= batch_rows:
                yield from flush()
        yield from flush()

    return entries.repartition("key").sortWithinPartitions("id", "place").mapInArrow(
        run, "key long, id long, place long, settled boolean")


def _contexts(asked: DataFrame, length: int, as_strings: bool) -> DataFrame:
    """What ``asked (id, sum, text, entries)`` is compared by: ``(key, id, sum,
    first, bytes)``, the bytes that an entry's strings span, or a row for each
    string with its hash as the key."""

    names = ["key", "id", "sum", "first", "bytes"]

    def spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
        ids, sums = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (ident, total) in enumerate(zip(ids, sums, strict=True)):
            raw = None
            for e in batch.column(3)[i].as_py():
                place = e["place"]
                if (place >> 8) & 0xFFFFFF == total:  # else another text of the same id
                    raw = batch.column(2)[i].as_py().encode() if raw is None else raw
                    first = place >> 32
                    yield e["key"], ident, total, first, raw[first:first + (place & 0xFF) + length - 1]

    def rows(some: list[tuple]) -> pa.RecordBatch:
        key, ident, total, first, bytes_ = zip(*some, strict=True)
        if not as_strings:
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(ident, pa.int64()), pa.array(total, pa.int64()),
                 pa.array(first, pa.int64()), pa.array(bytes_, pa.binary())], names)
        entry, step, h = string_hashes(list(bytes_), length)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(np.array(ident)[entry]), pa.array(np.array(total)[entry]),
             pa.array(np.array(first)[entry] + step), pa.nulls(len(h), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = spans(batch)
            while some := list(itertools.islice(every, 4096)):
                yield rows(some)

    return asked.mapInArrow(run, "key long, id long, sum long, first long, bytes binary")


def string_hashes(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(entry, step, hash)`` of every string of ``length`` bytes in the spans."""
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    data = np.frombuffer(b"".join(spans), np.uint8)
    begin, count = np.cumsum(sizes) - sizes, sizes - length + 1
    up, down = powers(len(data))
    p = prefix_hashes(data, up)
    entry = np.repeat(np.arange(len(spans)), count)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[entry] + step
    return entry, step, mix((p[at + length] - p[at]) * down[at])


def later_strings(key: np.ndarray, ident: np.ndarray, first: np.ndarray, spans: list[bytes], length: int) -> tuple:
    """The strings that occurred earlier among entries in order of key, id and
    place, as ``(entry, first, last)`` of maximal runs."""
    entry, step, h = string_hashes(spans, length)
    h = h + mix(key.view(np.uint64))[entry]
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    start = first[entry] + step
    # the same place of rows repeating an id is not earlier
    later = np.zeros(len(h), bool)
    later[order] = ~new & ((ident[entry[order]] != ident[entry[head]]) | (start[order] != start[head]))
    k = np.flatnonzero(later)
    if not len(k):
        return k, k, k
    cut = np.ones(len(k), bool)
    cut[1:] = (entry[k[1:]] != entry[k[:-1]]) | (start[k[1:]] != start[k[:-1]] + 1)
    i = np.flatnonzero(cut)
    j = np.append(i[1:], len(k)) - 1
    return entry[k[i]], start[k[i]], start[k[j]] + length


def _compared(contexts: DataFrame, length: int, together: int = 20_000) -> DataFrame:
    """``(id, sum, first, last)``: the runs of strings that occurred earlier,
    key by key, about ``together`` entries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, ident, total, first = (t.column(c).to_numpy() for c in range(4))
            entry, a, b = later_strings(key, ident, first, t.column(4).to_pylist(), length)
            if len(entry):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ident[entry], total[entry], a, b)],
                                                 ["id", "sum", "first", "last"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            waiting = t if waiting is None else pa.concat_tables([waiting, t])
            if waiting.num_rows >= together:
                key = waiting.column(0).to_numpy()
                n = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if n:
                    yield from compare(waiting.slice(0, n))
                    waiting = waiting.slice(n)
        if waiting is not None and waiting.num_rows:
            yield from compare(waiting)

    return contexts.repartition("key").sortWithinPartitions("key", "id", "first").mapInArrow(
        run, "id long, sum long, first long, last long")


_KEPT = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: string>"


def _cut(with_text: bool):
    @arrow_udf(_KEPT)
    def run(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out = []
        for text, first, last in zip(texts.to_pylist(), firsts.to_pylist(), lasts.to_pylist(), strict=True):
            raw = (text or "").encode()
            spans: list[list[int]] = []
            for a, b in sorted(zip(first or (), last or (), strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]]) if spans else raw
            out.append({"n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(spans),
                        "kept_sha256": hashlib.sha256(rest).hexdigest(),
                        "kept": rest.decode(errors="ignore") if with_text else None})
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                                        ("kept_sha256", pa.string()), ("kept", pa.string())]))

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32,
                 batch_rows: int = 1 << 16, most_together: int = 50_000, with_text: bool = False) -> DataFrame:
    """One row per row of ``df``: ``(id, n_bytes, n_removed, n_spans,
    kept_sha256)`` and, on request, ``kept_text`` (a character cut in two is
    left out).

    Texts are UTF-8 bytes; null and empty ones have none.  A null id counts as
    smaller than any other.  Rows repeating an id and text get the same result:
    the same place is not earlier.  Strings never cross texts.  Keys with more
    than ``most_together`` contexts are compared through a shuffle of their
    strings, so no task holds them.
    """
    checksum = F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0xFFFFFF))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("sum", checksum)
    scanned = written(_scanned(_entries(docs.select("id", "text", "sum"), length, gram), batch_rows), "suffix-scanned")

    asked = scanned.where("not settled")
    often = written(asked.groupBy("key").count().where(F.col("count") > F.lit(most_together)).select("key"), "suffix-often")
    usual = asked.join(often, "key", "left_anti") if often.limit(1).count() else asked

    def read(entries: DataFrame, as_strings: bool) -> DataFrame:
        each = entries.groupBy("id").agg(F.collect_set(F.struct("key", "place")).alias("entries"))
        return _contexts(docs.join(each, "id").select("id", "sum", "text", "entries"), length, as_strings)

    later = _compared(read(usual, False), length)
    if usual is not asked:
        # a key with very many contexts: string by string, minima combined before the shuffle
        strings = written(read(asked.join(often, "key", "left_semi"), True), "suffix-strings")
        place = F.struct("id", "first")
        heads = strings.groupBy("key").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head != tail")
        later = later.union(strings.join(heads.select("key", "head"), "key").where(place != F.col("head")).select(
            "id", "sum", "first", F.col("first") + F.lit(length)))

    start = F.shiftright("place", 32)
    whole = scanned.where("settled").select(
        "id", F.shiftright("place", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("sum"), start.alias("first"),
        (start + F.col("place").bitwiseAND(F.lit(0xFF)) + F.lit(length - 1)).alias("last"))
    # a set: rows repeating an id and text repeat its spans
    spans = whole.union(later).groupBy(F.col("id").alias("of"), F.col("sum").alias("of_sum")).agg(
        F.collect_set(F.struct("first", "last")).alias("spans"))
    out = docs.join(spans, (docs["id"] == spans["of"]) & (docs["sum"] == spans["of_sum"]), "left").select(
        F.when(F.col("id") != F.lit(_NO_ID), F.col("id")).alias(id_col), _cut(with_text)("text", "spans.first", "spans.last").alias("x"))
    more = [F.col("x.kept").alias("kept_text")] if with_text else []
    return out.select(id_col, "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept_sha256", *more)
