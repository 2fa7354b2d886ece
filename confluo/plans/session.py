"""One function per data task of the reference's service, without the HTTP layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confluo.operators.values import similarity_two
from confluo.plans.report import final_report
from confluo.sources.catalogue import columns_by_file
from confluo.sources.csv import find_file, list_csv_files, read_csv
from confluo.sources.headers import session_headers
from confluo.sources.inline import inline_table
from confluo.sources.records import scan_csv
from confluo.sources.sinks import preview_records, write_csv


def session_columns(spark: SparkSession, session_dir: str) -> dict[str, list[str]]:
    """Column names of every CSV in a session, by file (headers only)."""
    return columns_by_file(session_headers(spark, session_dir))


def search_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, file)`` of every CSV under ``root``, recursively."""
    return list_csv_files(spark, root, recursive=True)


def preview_file(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A CSV's rows as JSON records (all rows when ``n`` is None), multi-line read."""
    return preview_records(scan_csv(spark, path) if n is None else read_csv(spark, path, multi_line=True), n)


def export_quote_all(spark: SparkSession, root: str, filename: str, out_path: str) -> str:
    """The one file under ``root`` ending with ``filename``, re-written quote-all."""
    return write_csv(scan_csv(spark, find_file(spark, root, filename)), out_path, quote_all=True)


def compare_inline(spark: SparkSession, left: dict, right: dict, threshold: float = 0.8) -> DataFrame:
    """Value similarity of every column pair of two inline tables (one job)."""
    return similarity_two(inline_table(spark, left), inline_table(spark, right),
                          left["name"], right["name"], threshold)


def report_for_file(spark: SparkSession, path: str, fmt: str = "csv", exact: bool = False,
                    only_null_columns: bool = False) -> dict[str, DataFrame]:
    """Null profile, outlier report and histograms of a written combined table."""
    df = scan_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)
    return final_report(df, exact=exact, only_null_columns=only_null_columns)
