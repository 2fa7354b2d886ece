"""G10: recommendations for a session directory of CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confluo.operators.names import RECOMMEND_THRESHOLD, name_recommendations
from confluo.operators.sampling import DEFAULT_SEED, hash_sample
from confluo.operators.values import SIMILARITY_THRESHOLD, column_similarity
from confluo.errors import NoTablesError
from confluo.session import run_concurrently
from confluo.sources.csv import sanitize_headers, session_files
from confluo.sources.headers import session_headers
from confluo.sources.records import scan_csv


def recommend_names(spark: SparkSession, session_dir: str, threshold: int = RECOMMEND_THRESHOLD) -> DataFrame:
    """Name-based recommendations; only headers are read (no data scan)."""
    return name_recommendations(session_headers(spark, session_dir), threshold)


def recommend_values(spark: SparkSession, session_dir: str, threshold: float = SIMILARITY_THRESHOLD,
                     sample_fraction: float | None = None, seed: int = DEFAULT_SEED,
                     normalize: bool = False, sanitize: bool = True) -> DataFrame:
    """Value-based recommendations over all column pairs of different files.

    Columns go by their sanitised headers (C10; headers of one file that become
    equal raise HeaderCollisionError), or as they stand with ``sanitize=False``.

    All rows are compared; ``sample_fraction`` asks for a sample by row hash
    instead (the same rows on every run and partitioning).  Files are read in
    parallel within, records over several lines included.
    """
    files = session_files(spark, session_dir)
    if not files:
        raise NoTablesError(f"no CSV files in {session_dir}")
    read = run_concurrently(lambda f: scan_csv(spark, f[1]), files)
    tables = {f: sanitize_headers(df) if sanitize else df for (f, _), df in zip(files, read)}
    if sample_fraction is not None:
        tables = {f: hash_sample(df, None, sample_fraction, seed) for f, df in tables.items()}
    return column_similarity(tables, None, threshold, normalize)
