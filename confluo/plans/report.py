"""E3: the quality report of a combined table — constant jobs in the column count."""

from __future__ import annotations

from pyspark.sql import DataFrame

from confluo.functions.nulls import as_double, col_ref
from confluo.operators.quality import column_profile, fence_stats, histogram, outlier_report, outlier_summary


def final_report(df: DataFrame, exact: bool = False, only_null_columns: bool = False,
                 persist: bool = False) -> dict[str, DataFrame]:
    """``{"nulls", "outliers", "histogram"}`` DataFrames.

    Full passes over the data, whatever the number of columns: one for nulls
    and numeric detection together, the fences, one for outlier counts and
    all min/max values together, one for the bins.  ``persist`` keeps the
    numeric projection on the executors between them (worth it where it fits
    their memory) and releases it at the end.  Only per-column
    statistics and bin counts reach the driver; the results are computed.
    """
    spark = df.sparkSession
    prof = column_profile(df).collect()          # one row per column
    nulls = spark.createDataFrame([(r.column, r.nulls) for r in prof if r.nulls > 0],
                                  "column string, nulls bigint")
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    numeric = [r.column for r in prof if r.n_castable > 0]
    num = df.select(*[as_double(col_ref(c), dtypes[c]).alias(c) for c in numeric])
    if persist:
        num = num.persist()
    stats = fence_stats(num, numeric, exact)
    if only_null_columns:
        with_nulls = {r.column for r in prof if r.nulls > 0}
        stats = {c: st for c, st in stats.items() if c in with_nulls}
    summary = outlier_summary(num, stats)
    outliers = outlier_report(num, exact=exact, stats=stats, summary=summary)
    # the bins are at most columns × 2 × 30 rows: materialise them so the
    # persisted projection can be released before returning
    hist = histogram(num, exact=exact, stats=stats, summary=summary)
    hist = spark.createDataFrame(hist.collect(), hist.schema)
    if persist:
        num.unpersist()
    return {"nulls": nulls, "outliers": outliers, "histogram": hist}


def report_dict(report: dict[str, DataFrame]) -> dict[str, dict]:
    """``{column: {"nulls": n, "outliers": {...}, "histogram": {...}}}`` — the
    reference's response shape with the plot replaced by its bin counts
    (collected: a few rows per column)."""
    out: dict[str, dict] = {}
    for r in report["nulls"].collect():
        out.setdefault(r.column, {})["nulls"] = int(r.nulls)
    for r in report["outliers"].collect():
        out.setdefault(r.column, {})["outliers"] = {k: r[k] for k in ("q1", "q3", "lower", "upper", "n_outliers")}
    for r in report["histogram"].collect():
        h = out.setdefault(r.column, {}).setdefault("histogram", {})
        h.setdefault(r.series, {})[int(r.bin)] = int(r.n)
    return out
