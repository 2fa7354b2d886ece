"""Exact deduplication by a tree merge of sorted digest runs.

Each row belongs to one of ``runs`` runs.  A run is the sorted list of its
digests with the id that stays and the number of rows.  In binomial rounds,
``fan_in`` neighbouring runs merge into one: entries with the same digest and
the same checks meet, and the best id and the summed count go up.  The last
round leaves one run, spread over the cluster by digest.  The answer goes down
the same tree, so a group holding a third of all rows is never one task's work:
no step sees more than ``fan_in`` entries of a digest under one parent, and the
rows themselves meet their run's entry only.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import written


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "max", runs: int = 256, fan_in: int = 16) -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns one row per input row: ``(id, keep_id, group_size, kept,
    text_sha256)``.  Texts are equal when their SHA-256 digest, their byte
    length and their 64-bit xxHash all agree (the verification carried through
    every merge).  A null text counts as empty.  ``keep``: ``max`` or ``min``
    id; a null id loses against any other and stays only where the group has no
    other.  Of rows repeating one id and text, one is kept.  Other columns are
    not read.
    """
    best = {"max": F.max, "min": F.min}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = ["sha", "bytes", "check"]
    rows = df.select(
        F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"),
        F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("check"))
    # rows of one id and text carry a number, so that one of them can be kept
    rows = written(
        rows.groupBy("id", *same).count()
        .withColumn("run", F.pmod(F.xxhash64("id", "check"), F.lit(runs))), "dedup-rows")
    levels = [rows.groupBy("run", *same).agg(best("id").alias("best"), F.sum("count").alias("n"))]
    size = runs
    while size > 1:
        size = -(-size // fan_in)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / F.lit(fan_in)))
        levels.append(written(up.groupBy("run", *same).agg(best("best").alias("best"), F.sum("n").alias("n"))
                              .sortWithinPartitions("run", "sha"), f"dedup-run-{size}"))
    answer = levels[-1]
    for below in reversed([rows, *levels[:-1]]):
        answer = answer.select(F.col("run").alias("parent"), *same,
                               F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
        lower = below.withColumn("parent", F.col("run") if below is rows
                                 else F.floor(F.col("run") / F.lit(fan_in)))
        answer = lower.join(answer, ["parent", *same])
        if below is not rows:
            answer = answer.select("run", *same, F.col("keep_id").alias("best"), F.col("group_size").alias("n"))
    each = answer.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    return each.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("number") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"))
