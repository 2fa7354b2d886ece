"""Vector assembly and the PCA explained-variance curve.

One ``PCA(k=n)`` fit: the covariance is a distributed tree aggregate of the
n×n Gramian; the eigen-decomposition of that small matrix runs on the driver.
The first k ratios do not depend on the k of the fit, so the curve for every
k is a running sum of one fit's ratios.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.errors import InvalidRowsError
from confluo.functions.nulls import as_double, col_ref


def _refuse_or_skip(rows: DataFrame, bad: Column, skip_invalid: bool) -> DataFrame:
    """Rows without the bad ones, or an error that counts them."""
    if not skip_invalid:
        n = rows.agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n")).first()
        if n.bad:
            raise InvalidRowsError(f"{n.bad} of {n.n} rows have a null or NaN: fill them, or pass skip_invalid=True")
    return rows.where(~bad)


def assemble(df: DataFrame, columns: list[str], output: str = "features", skip_invalid: bool = False) -> DataFrame:
    """Numeric columns → one vector.  Rows with a null, NaN or text that is no
    number raise :class:`InvalidRowsError`, or are left out on request."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    dbl = df.select(*[as_double(col_ref(c), dtypes[c]).alias(f"f{i}") for i, c in enumerate(columns)])
    bad = F.lit(False)
    for i in range(len(columns)):
        bad = bad | F.col(f"f{i}").isNull() | F.isnan(f"f{i}")
    dbl = _refuse_or_skip(dbl, F.coalesce(bad, F.lit(True)), skip_invalid)
    va = VectorAssembler(inputCols=[f"f{i}" for i in range(len(columns))], outputCol=output)
    return va.transform(dbl).select(output)


def pca_variance(df: DataFrame, columns: list[str] | None = None, vector_col: str | None = None,
                 standardize: bool = True, skip_invalid: bool = False) -> DataFrame:
    """``(k, explained_variance, cumulative_variance)`` for k = 1 … n.  Every row
    counts; ``skip_invalid`` leaves out the rows that hold a null or NaN.  A table
    without rows has no curve: no rows."""
    spark = df.sparkSession
    if vector_col is not None:
        dtype = df.schema[vector_col].dataType
        v = array_to_vector(col_ref(vector_col)) if isinstance(dtype, T.ArrayType) else col_ref(vector_col)
        feats = _refuse_or_skip(df.select(col_ref(vector_col).alias("v"), v.alias("features")),
                                F.col("v").isNull(), skip_invalid).select("features")
        one = feats.first()
        n = len(one["features"]) if one else 0
    else:
        feats = assemble(df, columns, skip_invalid=skip_invalid)
        n = len(columns)
    schema = "k int, explained_variance double, cumulative_variance double"
    if not n or feats.isEmpty():
        return spark.createDataFrame([], schema)
    if standardize:
        feats = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True) \
            .fit(feats).transform(feats).select(F.col("scaled").alias("features"))
    model = PCA(k=n, inputCol="features", outputCol="pca").fit(feats)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    rows, acc = [], 0.0
    for k, e in enumerate(ev, 1):
        acc += e
        rows.append((k, e, acc))
    return spark.createDataFrame(rows, schema)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, corr)`` for every pair a < b (in ``columns``
    order): one wide aggregate of Pearson correlations — the matrix whose
    eigenvalue shares are the standardised PCA curve."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    v = {c: as_double(col_ref(c), dtypes[c]) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[F.corr(v[a], v[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                               F.col(f"r{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(cells))
