"""Mixing sources to target weights by Pfair scheduling.

Block k of a source with weight w may be served from slot floor(k / w) on and
must be served before slot ceil((k + 1) / w).  Serving the released block with
the earliest deadline in every slot keeps each source within less than one
block of its weighted share at every prefix (Baruah et al., 1996).

Releases and deadlines are reckoned in whole numbers from the exact weights, so
nothing is rounded and nothing adds up over a long mix.  When a source ends,
its weight is shared out among the rest and the count begins anew.  One task
goes through all blocks, a step of a heap each, and holds one entry per source,
never a document.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import number_within, whole_rows, written

#: The source name that null sources go by inside the operator.
_NO_SOURCE = "\x00null"
#: Blocks that the schedule hands on at once.
_PART = 1 << 16


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = max((w.denominator for w in exact.values()), default=1)  # powers of two
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(sources: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """The service of ``(source, share, blocks)``: (source, block, release,
    deadline, slot) for every block.  A source that ends leaves its weight to
    the rest, whose releases and deadlines count from that slot on."""
    left = [n for _, _, n in sources]
    done = [0] * len(sources)
    slot = 0
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        total, start, base = sum(sources[i][1] for i in live), slot, list(done)
        waiting = [(start, i) for i in live]  # release, source
        ready: list[tuple[int, int, int]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                release, i = heapq.heappop(waiting)
                k = done[i] - base[i]
                heapq.heappush(ready, (start - (-(k + 1) * total // sources[i][1]), i, release))
            deadline, i, release = heapq.heappop(ready)
            yield sources[i][0], done[i], release, deadline, slot
            slot += 1
            done[i] += 1
            left[i] -= 1
            if not left[i]:
                break
            heapq.heappush(waiting, (start + (done[i] - base[i]) * total // sources[i][1], i))


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
                source_col: str = "source", block_rows: int = 32, power: float = 0.7) -> DataFrame:
    """The place of every row in the mix.

    Returns one row per input row: ``(id, source, weight, block, release,
    deadline, slot, row_in_block)``; reading by ``(slot, row_in_block)`` gives
    the mix, and every prefix of whole blocks holds each source to within less
    than one block of its share (``weight``) while no source has ended.  ``weights`` maps
    every source to its target weight (default: its number of rows to the
    ``power``, which lifts small sources).  A source's rows come in a hash order
    of their ids.  All rows are placed, each once; a null source is a source of
    its own, a null id counts as the empty text, an empty table gives no rows.
    A source without a positive weight raises ``ValueError``.  Other columns of
    ``df`` are not read.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NO_SOURCE)).alias("s"),
        F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 3).alias("bucket"))
    numbered = written(number_within(rows, "s", "bucket", ["id"], "n")
                       .withColumn("block", F.floor(F.col("n") / F.lit(block_rows))), "mix-rows")
    counts = {r.s: r.n for r in numbered.groupBy("s").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        share = {s: float(n) ** power for s, n in counts.items()}
    else:
        given = {_NO_SOURCE if s is None else s: float(w) for s, w in weights.items()}
        wrong = sorted(s for s in counts if not given.get(s, 0) > 0)
        if wrong:
            raise ValueError(f"no positive weight for sources {wrong}")
        share = {s: given[s] for s in counts}
    total = sum(share.values())
    whole = whole_shares(share)
    # whole numbers go as text: they may exceed 64 bits
    plan = spark.createDataFrame([([(s, str(whole[s]), -(-n // block_rows)) for s, n in sorted(counts.items())],)],
                                 "sources array<struct<s string, share string, blocks long>>")

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sources in batch["sources"]:
                served = schedule([(x["s"], int(x["share"]), x["blocks"]) for x in sources])
                while part := list(itertools.islice(served, _PART)):
                    yield pd.DataFrame(part, columns=["s", "block", "release", "deadline", "slot"])

    places = plan.mapInPandas(serve, "s string, block long, release long, deadline long, slot long")
    known = spark.createDataFrame([(s, w / total) for s, w in share.items()], "s string, weight double")
    return (numbered.join(places.join(known, "s"), ["s", "block"])
            .select(F.col("id").alias(id_col),
                    F.when(F.col("s") != F.lit(_NO_SOURCE), F.col("s")).alias(source_col),
                    "weight", "block", "release", "deadline", "slot",
                    (F.col("n") % F.lit(block_rows)).alias("row_in_block")))


def mixed(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
          source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, laid out in the order of the mix: range
    partitions of slots, sorted inside, so files written from it read as the mix.
    Rows equal in id, source and text are interchangeable; nulls and the empty
    table are as in :func:`mix_sources`."""
    marked = whole_rows(df, id=df[id_col], source=df[source_col],
                        key=F.xxhash64(df[id_col], df[source_col], df[text_col]))
    same = Window.partitionBy("key").orderBy("id")
    light = marked.select("id", "source", "key")
    # several rows may share an id: the schedule numbers rows, not ids
    light = light.withColumn("copy", F.row_number().over(same))
    plan = mix_sources(light.select(F.to_json(F.struct("key", "copy")).alias("id"), "source"), weights, "id", "source", **options)
    plan = plan.select(F.from_json("id", "key long, copy int").alias("r"), "slot", "row_in_block") \
        .select(F.col("r.key").alias("of"), F.col("r.copy").alias("nth"), "slot", "row_in_block")
    rows = marked.withColumn("copy", F.row_number().over(same))
    placed = rows.join(plan, (F.col("key") == F.col("of")) & (F.col("copy") - F.col("nth") == 0))
    return placed.repartitionByRange("slot", "row_in_block").sortWithinPartitions("slot", "row_in_block").select("row.*")
