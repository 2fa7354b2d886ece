"""A8: the headers of a session's CSV files, read on the executors in one job.

Every split is a task of its own that stops at once: the first split of a file
after the header, the others before anything.  So a session of a million files,
or of a few huge ones, costs one short task a split, and no list of files or
headers passes through the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.errors import FileNotFound, NoTablesError
from confluo.session import scratch_path
from confluo.sources.csv import source_file_name
from confluo.sources.records import ends_inside


def column_names(record: str, sep: str = ",") -> list[str]:
    """A header record as Spark names the columns: an empty name becomes
    ``_c<place>``, names that repeat (in any case) get their place behind them."""
    cells = next(csv.reader([record], delimiter=sep, strict=False), [])
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _headers(sep: str, quote: str, escape: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        inside, name = False, None
        for batch in batches:
            if batch.num_rows and batch["start"][0].as_py():
                return  # not a file's first split
            for line, file in zip(batch["value"].to_pylist(), batch["name"].to_pylist(), strict=True):
                if not held and not line.rstrip("\r"):
                    continue
                name = file
                held.append(line)
                inside = ends_inside(line, inside, sep, quote, escape)
                if not inside:
                    break
            if held and not inside:
                break
        if held:
            names = column_names("\n".join(x.rstrip("\r") for x in held), sep)
            yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(names), pa.string()),
                                              "ordinal": pa.array(range(1, len(names) + 1), pa.int32()),
                                              "column_name": pa.array(names, pa.string())})
    return run


def session_headers(spark: SparkSession, root: str, recursive: bool = False, sep: str = ",", quote: str = '"',
                    escape: str = '"') -> DataFrame:
    """``(file, file_idx, ordinal, column_name)`` of the CSV files under ``root``.

    The header is a file's first record that is not blank, which may go over
    several lines; a file without one has no rows.  Files are numbered in the
    order of their names.
    """
    # splits are not packed together, so that a task can stop at its own
    one_each = spark.newSession()
    one_each.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    text = one_each.read.option("lineSep", "\n").option("pathGlobFilter", "*.csv")
    text = text.option("recursiveFileLookup", str(recursive).lower())
    try:
        lines = text.text(root).select("value", source_file_name().alias("name"), F.col("_metadata.file_block_start").alias("start"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFound(root) from e
        raise
    if not lines.inputFiles():
        raise NoTablesError(f"no CSV files in {root}")
    path = scratch_path(spark, "headers")
    lines.mapInArrow(_headers(sep, quote, escape), "file string, ordinal int, column_name string").write.parquet(path)
    found = spark.read.parquet(path)
    files = found.select("file").distinct().withColumn("file_idx", F.row_number().over(Window.orderBy("file")) - 1)
    return found.join(files, "file").select("file", "file_idx", "ordinal", "column_name")
