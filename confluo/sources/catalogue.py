"""A8/E3: the header catalogue ``(file, file_idx, ordinal, column_name)``.

Headers are metadata: they come from each table's schema (for a CSV the
header line only), one row per column — bounded by the schema width.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, file_idx int, ordinal int, column_name string"


def header_catalogue(spark: SparkSession, tables: Mapping[str, DataFrame],
                     order: str = "name") -> DataFrame:
    """Files are indexed in name order (``order='name'``) or as given."""
    names = sorted(tables) if order == "name" else list(tables)
    rows = [(f, i, j + 1, c) for i, f in enumerate(names) for j, c in enumerate(tables[f].columns)]
    return spark.createDataFrame(rows, SCHEMA)


def catalogue_from_names(spark: SparkSession, names: list[str], file: str = "_") -> DataFrame:
    """A plain list of column names as a one-file catalogue (order kept)."""
    return spark.createDataFrame([(file, 0, j + 1, c) for j, c in enumerate(names)], SCHEMA)


def distinct_headers(cat: DataFrame) -> DataFrame:
    return cat.select("column_name").distinct()


def columns_by_file(cat: DataFrame) -> dict[str, list[str]]:
    """The reference's ``{file: [columns]}`` view (small: one row per column)."""
    out: dict[str, list[str]] = {}
    for r in cat.orderBy("file_idx", "ordinal").collect():
        out.setdefault(r.file, []).append(r.column_name)
    return out
