"""Data-quality report of a (combined) table: nulls, numeric columns, IQR
outliers and histograms.

Jobs are constant in the number of columns: every pass is one wide aggregate
over all columns (partial aggregation on the map side, a one-row result), and
the small per-column statistics are brought back as literals for the next
pass.  Nothing per-row reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions.nulls import as_double, col_ref, null_or_nan
from confluo.operators.quantiles import approx_quantiles, exact_quantiles

# Fences at 1.5 interquartile ranges, 30 histogram bins,
# quartile relative error 0.05.
IQR_FACTOR = 1.5
N_BINS = 30
RELATIVE_ERROR = 0.05


def _long(pairs: list[tuple[str, Column]], name: str, value_type: str) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.cast(value_type).alias(name))
                              for c, v in pairs]))


# --- F1, D2, D7 ---------------------------------------------------------------

def null_profile(df: DataFrame, empty_as_null: bool = True, nonzero_only: bool = True) -> DataFrame:
    """``(column, nulls)``: per column, rows that are null or NaN (one pass)."""
    fields = df.schema.fields
    aggs = [F.count_if(null_or_nan(col_ref(f.name), f.dataType, empty_as_null)).alias(f"n{i}")
            for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    out = wide.select(_long([(f.name, F.col(f"n{i}")) for i, f in enumerate(fields)], "nulls", "bigint"))
    return out.where(F.col("nulls") > 0) if nonzero_only else out


# --- C11, C12, D1, F2 ---------------------------------------------------------

def castable_counts(df: DataFrame) -> DataFrame:
    """``(column, n_castable, is_numeric)`` — one job for all columns.

    Numeric iff at least one value casts to double (a column of ``'NaN'``
    strings counts: the cast gives NaN, not null).
    """
    fields = df.schema.fields
    aggs = [F.count(as_double(col_ref(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    out = wide.select(_long([(f.name, F.col(f"n{i}")) for i, f in enumerate(fields)], "n_castable", "bigint"))
    return out.withColumn("is_numeric", F.col("n_castable") > 0)


def column_profile(df: DataFrame, empty_as_null: bool = True) -> DataFrame:
    """``(column, nulls, n_castable)`` — the null profile and the numeric test
    of every column in **one** pass (one wide aggregate)."""
    fields = df.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        c = col_ref(f.name)
        aggs += [F.count_if(null_or_nan(c, f.dataType, empty_as_null)).alias(f"n{i}"),
                 F.count(as_double(c, f.dataType)).alias(f"k{i}")]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").cast("bigint").alias("nulls"),
                               F.col(f"k{i}").cast("bigint").alias("n_castable"))
                      for i, f in enumerate(fields)])
    return df.agg(*aggs).select(F.inline(cells))


def numeric_column_names(df: DataFrame) -> list[str]:
    rows = castable_counts(df).collect()   # one row per column: schema-bounded
    return [r.column for r in rows if r.is_numeric]


def numeric_columns(df: DataFrame) -> DataFrame:
    """The numeric columns only, as doubles (``try_cast``; unparsable → null)."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[as_double(col_ref(c), dtypes[c]).alias(c) for c in numeric_column_names(df)])


def categorical_columns(df: DataFrame) -> DataFrame:
    """Columns where no value casts to double (kept as they are)."""
    num = set(numeric_column_names(df))
    return df.select(*[col_ref(c) for c in df.columns if c not in num])


# --- F3, F4 -------------------------------------------------------------------

def iqr_fences(df: DataFrame, columns: list[str] | None = None, exact: bool = False,
               relative_error: float = RELATIVE_ERROR, factor: float = IQR_FACTOR) -> DataFrame:
    """``(column, q1, q3, lower, upper)`` per numeric column.

    ``exact=False`` is the reference's ``approxQuantile(…, 0.05)``;
    ``exact=True`` is ``percentile_disc`` computed by a distributed rank.
    A column with no non-NaN value has no row.
    """
    spark = df.sparkSession
    stats = fence_stats(df, columns, exact, relative_error, factor)
    schema = "column string, q1 double, q3 double, lower double, upper double"
    return spark.createDataFrame([(c, *s) for c, s in stats.items()], schema)


def fence_stats(df: DataFrame, columns: list[str] | None, exact: bool,
                relative_error: float = RELATIVE_ERROR, factor: float = IQR_FACTOR) -> dict[str, tuple]:
    cols = columns if columns is not None else numeric_column_names(df)
    q = exact_quantiles(df, cols, [0.25, 0.75]) if exact else \
        approx_quantiles(df, cols, [0.25, 0.75], relative_error)
    out = {}
    for c in cols:
        if not q.get(c):
            continue
        q1, q3 = q[c]
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - factor * iqr, q3 + factor * iqr)
    return out


# --- D3, F5 -------------------------------------------------------------------

def _value(df: DataFrame, c: str) -> Column:
    return as_double(col_ref(c), df.schema[c].dataType)


def _finite(v: Column) -> Column:
    """Neither null nor NaN nor infinite: what has a place in a histogram."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def non_finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n_nan, n_infinite)``: what the histograms leave out, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = _value(df, c)
        aggs += [F.count_if(F.isnan(v)).alias(f"a{i}"),
                 F.count_if(F.abs(v) == F.lit(float("inf"))).alias(f"b{i}")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("n_nan"), F.col(f"b{i}").alias("n_infinite"))
                      for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(cells))


def outlier_predicate(v: Column, lower: float, upper: float) -> Column:
    """Strict: ``v < lower or v > upper``; NaN is an outlier, null is not."""
    return (v < F.lit(lower)) | (v > F.lit(upper))


def outlier_summary(df: DataFrame, stats: dict[str, tuple]) -> dict[str, dict]:
    """One pass for every column with fences: the outlier count (NaN counts,
    null does not) and the min/max of all values and of the outliers (null,
    NaN and infinities left out) that the histograms need."""
    names = list(stats)
    if not names:
        return {}
    aggs = []
    for i, c in enumerate(names):
        v = _value(df, c)
        good = _finite(v)
        pred = outlier_predicate(v, stats[c][2], stats[c][3])
        aggs += [F.count_if(pred).alias(f"o{i}"),
                 F.min(F.when(good, v)).alias(f"a{i}"), F.max(F.when(good, v)).alias(f"b{i}"),
                 F.min(F.when(good & pred, v)).alias(f"c{i}"), F.max(F.when(good & pred, v)).alias(f"d{i}")]
    r = df.agg(*aggs).collect()[0]
    return {c: {"n_outliers": int(r[f"o{i}"]), "all": (r[f"a{i}"], r[f"b{i}"]), "outliers": (r[f"c{i}"], r[f"d{i}"])}
            for i, c in enumerate(names)}


def iqr_outliers(df: DataFrame, column: str, exact: bool = False,
                 relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """The whole rows whose ``column`` lies outside the IQR fences."""
    stats = fence_stats(df, [column], exact, relative_error)
    if column not in stats:
        return df.limit(0)
    _, _, lo, hi = stats[column]
    return df.where(F.coalesce(outlier_predicate(_value(df, column), lo, hi), F.lit(False)))


def outlier_report(df: DataFrame, columns: list[str] | None = None, exact: bool = False,
                   relative_error: float = RELATIVE_ERROR, only_null_columns: bool = False,
                   stats: dict[str, tuple] | None = None, summary: dict[str, dict] | None = None) -> DataFrame:
    """``(column, q1, q3, lower, upper, n_outliers)`` for every numeric column.

    ``only_null_columns=True`` keeps the reference's rule: report only columns
    that also have nulls.  ``stats`` (from :func:`fence_stats`) and
    ``summary`` (from :func:`outlier_summary`) skip passes the caller has
    already made.
    """
    spark = df.sparkSession
    if stats is None:
        stats = fence_stats(df, columns, exact, relative_error)
    if only_null_columns:
        with_nulls = {r.column for r in null_profile(df).collect()}
        stats = {c: s for c, s in stats.items() if c in with_nulls}
    schema = "column string, q1 double, q3 double, lower double, upper double, n_outliers bigint"
    if not stats:
        return spark.createDataFrame([], schema)
    if summary is None:
        summary = outlier_summary(df, stats)
    return spark.createDataFrame([(c, *stats[c], summary[c]["n_outliers"]) for c in stats], schema)


# --- F6 -----------------------------------------------------------------------

def bin_index(v: Column, lo: float, hi: float, bins: int = N_BINS) -> Column:
    """numpy.histogram's bin for ``v`` on ``bins`` equal bins over [lo, hi].

    Right edge closed; ``lo == hi`` widens the range by ±0.5.  The index is
    computed as numpy does — scale, then correct against the edges
    ``lo + i·(hi-lo)/bins`` — so boundary values land in the same bin.
    """
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if math.isinf(hi - lo):  # the range itself overflows: work at half the scale
        v, lo, hi = v / 2.0, lo / 2.0, hi / 2.0
    step = (hi - lo) / bins
    i = F.floor(((v - F.lit(lo)) / F.lit(hi - lo)) * F.lit(float(bins))).cast("int")
    i = F.when(i == bins, bins - 1).otherwise(i)

    def edge(k: Column) -> Column:
        return F.when(k == bins, F.lit(hi)).otherwise(k.cast("double") * F.lit(step) + F.lit(lo))

    i = F.when(v < edge(i), i - 1).otherwise(i)
    i = F.when((v >= edge(i + 1)) & (i != bins - 1), i + 1).otherwise(i)
    return i


def histogram(df: DataFrame, columns: list[str] | None = None, exact: bool = False,
              relative_error: float = RELATIVE_ERROR, bins: int = N_BINS,
              stats: dict[str, tuple] | None = None, summary: dict[str, dict] | None = None) -> DataFrame:
    """``(column, series, bin, n)``: 30 equal-width bins of all values and of
    the outliers, each over its own min–max (null, NaN and infinities left out;
    :func:`non_finite_counts` says how many).

    Three wide passes (fences, min/max, bins; the first two can be passed
    in); the last is one ``groupBy`` on ``(column, series, bin)`` — at most
    columns × 2 × 30 groups, combined map-side before the shuffle.
    """
    spark = df.sparkSession
    if stats is None:
        stats = fence_stats(df, columns, exact, relative_error)
    schema = "column string, series string, bin int, n bigint"
    if not stats:
        return spark.createDataFrame([], schema)
    names = list(stats)
    if summary is None:
        summary = outlier_summary(df, stats)
    vals = {c: _value(df, c) for c in names}
    good = {c: _finite(vals[c]) for c in names}
    out = {c: good[c] & outlier_predicate(vals[c], stats[c][2], stats[c][3]) for c in names}
    cells = []
    for c in names:
        for series, cond in (("all", good[c]), ("outliers", out[c])):
            lo, hi = summary[c][series]
            if lo is not None:
                cells.append(F.struct(F.lit(c).alias("column"), F.lit(series).alias("series"),
                                      F.when(cond, bin_index(vals[c], lo, hi, bins)).alias("bin")))
    if not cells:
        return spark.createDataFrame([], schema)
    return (df.select(F.inline(F.array(*cells)))
              .where(F.col("bin").isNotNull())
              .groupBy("column", "series", "bin")
              .agg(F.count(F.lit(1)).alias("n")))


def as_string_table(df: DataFrame) -> DataFrame:
    """Every column cast to string — a parquet table seen as a CSV would be."""
    return df.select(*[col_ref(f.name).cast("string").alias(f.name)
                       if not isinstance(f.dataType, T.StringType) else col_ref(f.name)
                       for f in df.schema.fields])
