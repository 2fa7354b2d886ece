"""B1–B4: writers and previews.  Writes are parallel (one file per task);
``write_csv_file`` joins the parts of a parallel write into one file.
``write_csv(single_file=True)`` coalesces to one writer, for small outputs."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a Hadoop file system says of itself where files can be joined in place.
_CONCAT = "fs.capability.paths.concat"


def write_csv(df: DataFrame, path: str, quote_all: bool = False, single_file: bool = False,
              mode: str = "overwrite") -> str:
    """B1/B2: header row; ``quote_all`` quotes every field (null and ``''`` → ``""``).

    A quote inside a field is doubled (RFC 4180), so text with quotes,
    backslashes and newlines survives a multi-line read with ``escape='"'``.
    """
    out = df.coalesce(1) if single_file else df
    _csv_writer(out, quote_all, mode).option("header", "true").csv(path)
    return path


def _csv_writer(df: DataFrame, quote_all: bool, mode: str = "overwrite"):
    w = df.write.mode(mode).option("escape", '"')
    return w.option("quoteAll", "true") if quote_all else w


def write_csv_file(df: DataFrame, path: str, quote_all: bool = False) -> str:
    """B1 as one file of the given name, in the order of ``df``'s partitions.

    Parts without a header are written in parallel, the header as a part of its
    own.  Where the file system can join files in place (HDFS) it does; where
    all executors see it as local files, each task copies its part to its place
    in the file, which it may do any number of times; on other stores, which have
    neither, one task writes the file.  The file has its name only when whole.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), f"{path}.parts"
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())

    def parts(name: str) -> list:
        found = [f for f in fs.listStatus(hadoop.Path(f"{folder}/{name}")) if f.getPath().getName().startswith("part-")]
        found.sort(key=lambda f: (int(f.getPath().getName().split("-")[1]), f.getPath().getName()))
        return [(f.getPath(), f.getLen()) for f in found if f.getLen()]

    in_place, local = fs.hasPathCapability(target, _CONCAT), target.toUri().getScheme() in (None, "file") and fs.getScheme() == "file"
    if not in_place and not local:
        write_csv(df, f"{folder}/rows", quote_all, single_file=True)
        whole = parts("rows")[0][0]
    else:
        schema = ", ".join(f"c{i} string" for i in range(len(df.columns)))
        _csv_writer(spark.createDataFrame([tuple(df.columns)], schema).coalesce(1), quote_all).csv(f"{folder}/header")
        _csv_writer(df, quote_all).csv(f"{folder}/rows")
        pieces = parts("header") + parts("rows")
        if in_place:
            whole = _joined_in_place(sc, fs, hadoop, [p for p, _ in pieces])
        else:
            whole = hadoop.Path(f"{folder}/whole")
            _copied_together(spark, [(p.toUri().getPath(), n) for p, n in pieces], whole.toUri().getPath())
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError(f"cannot name {whole} {path}")
    fs.delete(hadoop.Path(folder), True)
    return path


def _joined_in_place(sc, fs, hadoop, pieces: list):
    """The first piece, with the blocks of the others behind its own (HDFS wants
    all in one folder)."""
    first = pieces[0]
    beside = [first]
    for i, p in enumerate(pieces[1:]):
        beside.append(hadoop.Path(first.getParent(), f"joined-{i}"))
        fs.rename(p, beside[-1])
    if len(beside) > 1:
        rest = sc._gateway.new_array(hadoop.Path, len(beside) - 1)
        for i, p in enumerate(beside[1:]):
            rest[i] = p
        fs.concat(first, rest)
    return first


def _copied_together(spark, pieces: list[tuple[str, int]], whole: str) -> None:
    """Copies files of known sizes one behind the other, a task each."""
    rows, at = [], 0
    for name, size in pieces:
        rows.append((name, at, size))
        at += size

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, place in zip(batch["name"].to_pylist(), batch["place"].to_pylist(), strict=True):
                # opened without cutting it: other tasks write it too
                with open(name, "rb") as src, os.fdopen(os.open(whole, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as out:
                    out.seek(place)
                    shutil.copyfileobj(src, out, 1 << 20)
            yield batch.select(["size"])

    listed = spark.createDataFrame(rows, "name string, place long, size long").repartition(len(rows))
    done = listed.mapInArrow(copy, "size long").agg(F.sum("size").alias("n")).first().n
    if done != at or os.path.getsize(whole) != at:
        raise OSError(f"{whole}: {at} bytes wanted")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def preview(df: DataFrame, n: int | None = 10, order_by: list[str] | None = None) -> DataFrame:
    """B3/B4: the first ``n`` rows (in ``order_by`` order when given); ``None``: all."""
    out = df.orderBy(*order_by) if order_by else df
    return out.limit(n) if n is not None else out


def preview_records(df: DataFrame, n: int | None = 10, order_by: list[str] | None = None) -> DataFrame:
    """B3 as JSON records, one string per row."""
    return preview(df, n, order_by).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
                                           .alias("record"))
