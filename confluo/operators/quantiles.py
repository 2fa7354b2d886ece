"""Quantiles of many columns at once.

*Approximate* (the reference's ``approxQuantile(…, 0.05)``): one wide
``percentile_approx`` aggregate — mergeable sketches, map-side partial
aggregation, memory bounded by the accuracy, not by the data.

*Exact* (``percentile_disc``: the smallest value whose cumulative count reaches
⌈p·N⌉) by radix selection, since Spark's own ``percentile_disc`` keeps every
distinct value of a group in one task.  A digit is a function that never falls
as the value rises, so the digit's counts say which digit the wanted rank has:

1. the first digit is a value's sign and sixteenth of an octave; one scan counts
   all columns' digits, with the least and the greatest value of each;
2. the values of the digit found are divided into :data:`BINS` equal parts
   between their least and greatest, which are the next digit's values, and so
   on until these two are one value.

A sixteenth of an octave holds 2⁴⁸ doubles, so there are five scans at most, for
all columns and ranks together, and one or two for values that repeat.  Counts
are combined before the shuffle: what moves is a row a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions.nulls import as_double, col_ref

#: Digits of every scan after the first.
BINS = 4096
#: More than any first digit of a finite value.
_INFINITE = 100_000


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles ``v0, v1, …``; NaN becomes null (as approxQuantile)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for i, c in enumerate(columns):
        v = as_double(col_ref(c), dtypes[c])
        exprs.append(F.when(~F.isnan(v), v).alias(f"v{i}"))
    return df.select(*exprs)


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     relative_error: float = 0.05) -> dict[str, list[float] | None]:
    """One job for all columns; ``None`` where a column has no non-NaN value."""
    if not columns:
        return {}
    accuracy = max(1, int(round(1.0 / relative_error))) if relative_error > 0 else 1_000_000
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(columns):
        v = as_double(col_ref(c), dtypes[c])
        v = F.when(~F.isnan(v), v)
        aggs.append(F.percentile_approx(v, F.array(*[F.lit(float(p)) for p in probs]), accuracy).alias(f"q{i}"))
    row = df.agg(*aggs).collect()[0]
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else None) for i, c in enumerate(columns)}


def _first_digit(v: Column) -> Column:
    """Sign and sixteenth of an octave, as an integer that rises with ``v``."""
    octave = (F.floor(F.log2(F.abs(v)) * 16) + 20_000).cast("int")
    size = F.when(v == 0, 0).when(F.abs(v) == F.lit(float("inf")), _INFINITE).otherwise(octave)
    return F.when(v < 0, -size).otherwise(size)


def _counted(df: DataFrame, cells: list[Column]) -> DataFrame:
    """``(at, digit, n, least, most)`` of cells ``(at, digit, v)`` without nulls."""
    return (df.select(F.inline(F.array(*cells))).where("digit is not null").groupBy("at", "digit")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))


def exact_quantiles_df(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """``(column, p, value)`` with ``percentile_disc`` semantics; columns
    without a value have no row.  A row a column and probability reaches the
    driver with every scan."""
    spark, values = df.sparkSession, _values(df, columns)
    upto = Window.partitionBy("at").orderBy("digit")

    def cell(at: int, digit: Column, v: Column) -> Column:
        return F.struct(F.lit(at).alias("at"), digit.alias("digit"), v.alias("v"))

    vs = [F.col(f"v{i}") for i in range(len(columns))]
    found = _counted(values, [cell(i, _first_digit(v), v) for i, v in enumerate(vs)])
    found = found.withColumn("all", F.sum("n").over(Window.partitionBy("at"))).withColumn("upto", F.sum("n").over(upto))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    found = found.select("*", wanted).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("all"))))
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
    rest = F.col("rank") - F.col("upto") + F.col("n")
    open_ = [(r["at"], r.p, r["rest"], r.least, r.most)
             for r in found.where(hit).select("at", "p", rest.alias("rest"), "least", "most").collect()]
    done = []
    while open_:
        done += [t for t in open_ if t[3] == t[4]]
        open_ = [t for t in open_ if t[3] < t[4]]
        if not open_:
            break
        cells = [cell(j, F.when(vs[i].between(lo, hi), F.floor((vs[i] - F.lit(lo)) / F.lit(hi - lo) * BINS).cast("int")), vs[i])
                 for j, (i, _, _, lo, hi) in enumerate(open_)]
        ranks = F.element_at(F.array(*[F.lit(t[2]) for t in open_]).cast("array<bigint>"), F.col("at") + 1)
        found = _counted(values, cells).withColumn("upto", F.sum("n").over(upto)).withColumn("rank", ranks)
        open_ = [(*open_[r["at"]][:2], r["rest"], r.least, r.most)
                 for r in found.where(hit).select("at", rest.alias("rest"), "least", "most").collect()]
    return spark.createDataFrame([(columns[i], p, lo) for i, p, _, lo, _ in done], "column string, p double, value double")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    if not columns:
        return {}
    rows = exact_quantiles_df(df, columns, probs).collect()
    got = {(r.column, r.p): r.value for r in rows}
    out = {}
    for c in columns:
        vals = [got.get((c, float(p))) for p in probs]
        out[c] = None if any(v is None for v in vals) else vals
    return out
