"""E1: apply a column mapping to a session and write the combined table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from confluo.errors import FileNotFound, MissingColumnsError
from confluo.operators.homogenize import files_in_order, main_columns, mapping_rows, project_file
from confluo.session import run_concurrently
from confluo.sources.csv import read_csv, session_files
from confluo.sources.records import scan_csv
from confluo.sources.sinks import write_csv, write_csv_file, write_parquet


def _signature(rows, file: str, mains: list[str]) -> tuple:
    by_main: dict[str, list[str]] = {}
    for main, f, _, src in sorted(rows, key=lambda r: r[2]):
        if f == file:
            by_main.setdefault(main, []).append(src)
    return tuple((m, tuple(by_main.get(m, ()))) for m in mains)


def combine_session(spark: SparkSession, session_dir: str, mapping, fill: str | None = "",
                    source_col: str | None = None, row_id_col: str | None = None) -> DataFrame:
    """The combined table of a session; records may go over several lines.

    Files with the same header and the same projection are read by **one**
    multi-path scan, in parallel within files, so the plan grows with the number
    of distinct file layouts, not files.  Headers are read per file (the first
    record only, several at once) and checked before any data is read.
    ``source_col`` adds the file's name, ``row_id_col`` the row's number in its
    file (:func:`scan_csv`): together they name a row for good, whatever the
    partitioning and however often a task is repeated.
    """
    rows = mapping_rows(mapping)
    mains = main_columns(rows)
    paths = dict(session_files(spark, session_dir))
    groups: dict[tuple, list[str]] = {}
    files = files_in_order(rows)
    absent = [f for f in files if f not in paths]
    if absent:
        raise FileNotFound(f"{', '.join(absent)} in {session_dir}")
    headers = run_concurrently(lambda f: tuple(read_csv(spark, paths[f]).columns), files)
    for f, header in zip(files, headers):
        groups.setdefault((header, _signature(rows, f, mains)), []).append(f)
    for (header, signature), same in groups.items():
        missing = [s for _, sources in signature for s in sources if s not in header]
        if missing:
            raise MissingColumnsError(same[0], list(dict.fromkeys(missing)))

    def part(layout: tuple) -> DataFrame:
        (header, _), same = layout
        extra = {"__file": source_col, "__row": row_id_col}
        df = scan_csv(spark, [paths[f] for f in same], *[k if extra[k] else None for k in extra], columns=list(header))
        out = project_file(df, same[0], rows, mains, fill, extra=[k for k, name in extra.items() if name])
        return out.withColumnsRenamed({k: name for k, name in extra.items() if name})

    return reduce(DataFrame.union, run_concurrently(part, list(groups.items())))


def homogenize_session(spark: SparkSession, session_dir: str, mapping, out_path: str,
                       fmt: str = "parquet", single_file: bool = False, source_col: str | None = None,
                       row_id_col: str | None = None) -> str:
    """Read only the files the mapping names, merge, write; nothing is collected.
    ``fmt``: ``parquet``, or ``csv`` as a folder or (``single_file``) one file."""
    combined = combine_session(spark, session_dir, mapping, "", source_col, row_id_col)
    if fmt == "csv":
        return write_csv_file(combined, out_path) if single_file else write_csv(combined, out_path)
    return write_parquet(combined, out_path, partition_by=[source_col] if source_col else None)
