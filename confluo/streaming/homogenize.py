"""Apply a column mapping to CSV files as they arrive (file source → sink).

A file stream has one schema, so one stream serves one family of files with
the same header (e.g. daily exports of one system).  The projection is the
batch operator's own (stateless, so it streams unchanged).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from confluo.operators.homogenize import main_columns, mapping_rows, project_file
from confluo.sources.csv import csv_options


def csv_stream(spark: SparkSession, source_dir: str, header: list[str],
               max_files_per_trigger: int | None = None, multi_line: bool = True) -> DataFrame:
    """The rows of CSV files as they arrive.  Records may go over several lines;
    a file is one task then, so large files without such records are better
    read with ``multi_line=False``, which cuts records at every line end."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    r = spark.readStream.schema(schema).options(**csv_options(multi_line)).option("pathGlobFilter", "*.csv")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.csv(source_dir)


def homogenize_stream(stream: DataFrame, file: str, mapping, fill: str | None = "",
                      source_col: str | None = None) -> DataFrame:
    rows = mapping_rows(mapping)
    return project_file(stream, file, rows, main_columns(rows), fill, source_col=source_col)


def start_parquet_sink(df: DataFrame, out_path: str, checkpoint: str, trigger_once: bool = False):
    """Exactly-once file sink; the checkpoint belongs in the shared work folder."""
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
