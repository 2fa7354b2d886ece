"""Running null profile of a stream: state is one row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions.nulls import col_ref, null_or_nan


def null_profile_stream(stream: DataFrame, empty_as_null: bool = True) -> DataFrame:
    """``(column, nulls, rows)`` updated per micro-batch (complete/update mode)."""
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"),
                               null_or_nan(col_ref(f.name), f.dataType, empty_as_null).cast("int").alias("m"))
                      for f in stream.schema.fields])
    return (stream.select(F.inline(cells)).groupBy("column")
                  .agg(F.sum("m").cast("bigint").alias("nulls"), F.count(F.lit(1)).alias("rows")))
