"""CSV scans and session discovery.

Every column is read as ``string`` (no inference).  ``multi_line=True``
honours quoted newlines but makes a file one split; ``multi_line=False`` is
splittable, for files without them.  ``records.scan_csv`` does both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.errors import AmbiguousFileError, FileNotFound, HeaderCollisionError, NoTablesError
from confluo.session import run_concurrently


def csv_options(multi_line: bool = True, **options) -> dict[str, str]:
    """The reader options that batch and streaming reads share."""
    return {"header": "true", "multiLine": str(bool(multi_line)).lower(), "escape": '"', **options}


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, **options) -> DataFrame:
    """A1/A2: header row, all columns ``string``, PERMISSIVE (ragged rows pad/truncate).

    Quotes inside quoted fields are doubled (RFC 4180, as our writer does);
    pass ``escape='\\'`` for backslash-escaped files.
    """
    try:
        return spark.read.options(**csv_options(multi_line, **options)).csv(path)
    except Exception as e:  # PATH_NOT_FOUND and friends → typed error
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFound(path) from e
        raise


def list_csv_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """A3/A4: ``(path, file)`` of the regular files under ``root`` ending ``.csv``.

    Uses the ``binaryFile`` source for the listing only: ``content`` is never
    selected, so no file is read.
    """
    r = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    try:
        df = r.load(root)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFound(root) from e
        raise
    return df.select("path", base_name(F.col("path")).alias("file"))


def session_files(spark: SparkSession, root: str, recursive: bool = False) -> list[tuple[str, str]]:
    """``[(file, path)]`` sorted by file name — file metadata, not data."""
    rows = list_csv_files(spark, root, recursive).collect()
    return sorted(((r.file, r.path) for r in rows), key=lambda t: (t[0], t[1]))


def read_session(spark: SparkSession, root: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """A3 + A1: every CSV of a session directory, by base name, in name order.

    Headers are read concurrently, each file's once (a bounded pool).
    """
    files = session_files(spark, root)
    if not files:
        raise NoTablesError(f"no CSV files in {root}")
    tables = run_concurrently(lambda f: read_csv(spark, f[1], multi_line), files)
    return {f: df for (f, _), df in zip(files, tables)}


def source_file_name() -> Column:
    """The file name of a row, as it is on disk (Spark's is percent-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def find_file(spark: SparkSession, root: str, filename: str) -> str:
    """A5: the one file under ``root`` (recursive) whose path ends with ``filename``."""
    hits = (list_csv_files(spark, root, recursive=True)
            .where(F.col("path").endswith(filename)).select("path").collect())
    if not hits:
        raise FileNotFound(f"{filename} under {root}")
    if len(hits) > 1:
        raise AmbiguousFileError(f"{filename} matches {len(hits)} files under {root}")
    return hits[0].path


def base_name(path):
    """C13: the last path element."""
    return F.element_at(F.split(path, "/"), -1)


def sanitize_headers(df: DataFrame) -> DataFrame:
    """C10: strip blanks and turn ``...`` into ``_%&%_`` (a dot breaks ``col()``)."""
    new = [c.strip().replace("...", "_%&%_") for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise HeaderCollisionError(f"headers collide after sanitising: {dup}")
    return df.toDF(*new)
