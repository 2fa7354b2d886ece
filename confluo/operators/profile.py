"""Value-shape profile and pattern conformance of string columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.functions.nulls import col_ref
from confluo.functions.shapes import shape_to_regex, value_shape


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col_ref(c).cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(cells)) \
        .where(F.col("value").isNotNull())


def value_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, shape, n)``: how many values have each shape (map-side combined)."""
    return (_long_values(df, columns)
            .select("column", value_shape(F.col("value")).alias("shape"))
            .groupBy("column", "shape").agg(F.count(F.lit(1)).alias("n")))


def dominant_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, shape, n)``: the most frequent shape per column (ties: smallest
    shape).  A mergeable ``min(struct(-n, shape))`` — no per-column window."""
    best = (value_shapes(df, columns).groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("shape").alias("shape"))).alias("b")))
    return best.select("column", F.col("b.shape").alias("shape"), (-F.col("b.neg")).alias("n"))


def pattern_conformance(df: DataFrame, patterns: dict[str, str] | None = None,
                        columns: list[str] | None = None) -> DataFrame:
    """``(column, shape, pattern, n_values, n_match, match_rate)``.

    ``patterns`` maps a column to a Java regex (search semantics, as
    ``re.search``; ``shape`` is then null); without it each column's dominant
    shape becomes an anchored regex (metacharacters quoted).  The dominant
    shapes are one row per column; then one wide pass over the data.
    """
    spark = df.sparkSession
    shapes: dict[str, str] = {}
    if patterns is None:
        cols = columns or df.columns
        shapes = {r.column: r.shape for r in dominant_shapes(df, cols).collect()}
        patterns = {c: shape_to_regex(s) for c, s in shapes.items()}
    names = [c for c in (columns or df.columns) if c in patterns]
    schema = ("column string, shape string, pattern string, n_values bigint, n_match bigint, "
              "match_rate double")
    if not names:
        return spark.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(names):
        v = col_ref(c).cast("string")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(patterns[c])).alias(f"m{i}")]
    wide = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(shapes.get(c)).cast("string").alias("shape"),
                               F.lit(patterns[c]).alias("pattern"),
                               F.col(f"n{i}").alias("n_values"), F.col(f"m{i}").alias("n_match"))
                      for i, c in enumerate(names)])
    return wide.select(F.inline(cells)).withColumn(
        "match_rate", F.when(F.col("n_values") > 0, F.col("n_match") / F.col("n_values")))
