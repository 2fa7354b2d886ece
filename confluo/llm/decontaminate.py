"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and texts are normalised alike (A-Z lower-cased, words joined by one
space).  Every window of ``width`` consecutive item words is a pattern of one
automaton (an item with fewer words is one pattern), and each text is scanned
once.  Word numbers of the hits map back to offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm.common import folding, separators_word, text_slices, whole_rows, written

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_HITS = "struct<n_words: bigint, words: array<int>, items: array<string>, spans: array<struct<first: int, last: int>>>"


def _letters() -> bytes:
    """Byte table of the normalisation: separators to spaces, A-Z to a-z."""
    out = folding()
    out[separators_word()] = 32
    return out.tobytes()


def patterns(items: list[tuple[str, str | None]], width: int) -> dict[str, list[str]]:
    """Normalised window -> ids of the items that hold it."""
    table, out = _letters(), {}
    for item, text in items:
        words = (text or "").encode().translate(table).split()
        for i in range(max(1, len(words) - width + 1) if words else 0):
            window = b" " + b" ".join(words[i:i + width]) + b" "
            owners = out.setdefault(window.decode("latin-1"), [])
            if item not in owners:
                owners.append(item)
    return out


def _scanner(items: list[tuple[str, str | None]], width: int):
    """A column function text -> hits for these items."""

    @arrow_udf(_HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for window, owners in patterns(items, width).items():
            automaton.add_word(window, (len(window), owners))
        if len(automaton):
            automaton.make_automaton()
        table, word = _letters(), re.compile(_WORD)

        def hits(text: bytes) -> tuple:
            words = text.translate(table).split()
            if not words or not len(automaton):
                return len(words), None, None, None
            line = b" " + b" ".join(words) + b" "
            found = list(automaton.iter(line.decode("latin-1")))
            if not found:
                return len(words), None, None, None
            gaps = np.cumsum(np.frombuffer(line, np.uint8) == 32)
            hit, owners = np.zeros(len(words), bool), set()
            for end, (length, ids) in found:
                # spaces up to a window's first and last byte number its words
                hit[gaps[end - length + 1] - 1:gaps[end] - 1] = True
                owners.update(ids)
            numbers = np.flatnonzero(hit)
            at = [m.span() for m in word.finditer(text.decode())]
            runs = np.split(numbers, np.flatnonzero(np.diff(numbers) > 1) + 1)
            spans = [{"first": at[r[0]][0], "last": at[r[-1]][1]} for r in runs]
            return len(words), numbers.tolist(), sorted(owners), spans

        kind = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
        for batch in batches:
            out = []
            for _, data, off in text_slices(batch, 4 << 20):
                raw = data.tobytes()
                out += [dict(zip(("n_words", "words", "items", "spans"), hits(raw[a:b]), strict=True))
                        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.array(out, kind)

    return scan


def benchmark_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", width: int = 10, chunk_bytes: int = 16 << 20,
                   out: str = "__hits") -> DataFrame:
    """``df`` with a column ``out``: ``struct(n_words, words, items, spans)``.

    ``words``: numbers (from 0) of the words inside an occurrence of a window;
    ``items``: ids (as text) of the items that occur; ``spans``: code-point
    offsets ``[first, last)`` of the hit runs in the original text.  The three
    are empty arrays without hits.  Null texts and items have no words.

    The automaton is built from at most ``chunk_bytes`` of item text, so what
    is sent to the workers is bounded; a larger benchmark is scanned in several
    chunks, one written pass each, and the hits are united.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where(
        "item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    chunks = -(-size // chunk_bytes) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(chunks))
    empty = F.expr("struct(0L as n_words, cast(array() as array<int>) as words, cast(array() as array<string>) as items, "
                   "cast(array() as array<struct<first: int, last: int>>) as spans)")
    got = None
    for i in range(chunks):
        items = [(r.item, r.text) for r in rows.where(part == i).collect()]
        name = f"{out}_{i}"
        df = df.withColumn(name, _scanner(items, width)(F.col(text_col)))
        one = F.struct(*[F.coalesce(F.col(name)[k], empty[k]).alias(k) for k in ("n_words", "words", "items", "spans")])
        got = one if got is None else F.struct(
            one["n_words"].alias("n_words"),
            *[F.array_sort(F.array_union(F.col(out)[k], one[k])).alias(k) for k in ("words", "items", "spans")])
        df = df.withColumn(out, got).drop(name)
        if chunks > 1:
            df = written(df, f"decontaminate-{i}")
    return df


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """One row per row of ``df``: ``(id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans)``.  Rows repeating an id are reported each."""
    found = benchmark_hits(df.select(F.col(id_col), F.col(text_col).alias("text")), benchmark, "text", **options)
    hit = F.size("__hits.words").cast("long")
    return found.select(
        id_col, F.col("__hits.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__hits.items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.col("__hits.spans").alias("spans"))


def decontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, columns as they are, without a word of any test item's window."""
    rows = whole_rows(df, text=df[text_col])
    found = benchmark_hits(rows, benchmark, "text", **options)
    return found.where(F.size("__hits.words") == 0).select("row.*")
