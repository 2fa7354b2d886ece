"""Merge the chosen columns of many tables into one table by a column mapping.

mapping: ``{main_col: {file: [source_col, ...]}}`` (the request shape), or a
DataFrame / list of rows ``(main_col, file, ordinal, source_col)``.  Per file
one ``select`` renames a single source, or ``concat_ws(' ', …)`` merges
several (nulls skipped); then all files are unioned by name.  The plan is a
union of narrow projections — no shuffle, no driver round trip.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.errors import MissingColumnsError, NoTablesError
from confluo.functions.nulls import col_ref

MappingRows = list[tuple[str, str, int, str]]


def mapping_rows(mapping) -> MappingRows:
    """Normalise any mapping form to ``(main_col, file, ordinal, source_col)`` rows.

    A DataFrame mapping is collected: it is metadata, one row per chosen source
    column, bounded by the schema width, not by the data.
    """
    if isinstance(mapping, DataFrame):
        rows = mapping.select("main_col", "file", "ordinal", "source_col").collect()
        rows = sorted(rows, key=lambda r: r.ordinal)
        return [(r.main_col, r.file, int(r.ordinal), r.source_col) for r in rows]
    if isinstance(mapping, Mapping):
        out, k = [], 0
        for main, files in mapping.items():
            for file, cols in files.items():
                for c in cols:
                    out.append((main, file, k, c))
                    k += 1
        return out
    return [tuple(r) for r in mapping]


def main_columns(rows: MappingRows) -> list[str]:
    seen: dict[str, None] = {}
    for main, *_ in rows:
        seen.setdefault(main, None)
    return list(seen)


def files_in_order(rows: MappingRows) -> list[str]:
    seen: dict[str, None] = {}
    for _, file, _, _ in sorted(rows, key=lambda r: r[2]):
        seen.setdefault(file, None)
    return list(seen)


def check_columns(df: DataFrame, file: str, wanted: list[str]) -> None:
    """Raise one error naming every missing column (checked before any select)."""
    have = set(df.columns)
    missing = [c for c in dict.fromkeys(wanted) if c not in have]
    if missing:
        raise MissingColumnsError(file, missing)


def _as_text(c: Column, df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType.typeName()
    return c if dtype == "string" else c.cast("string")


def project_file(df: DataFrame, file: str, rows: MappingRows, mains: list[str],
                 fill: str | None = "", sep: str = " ",
                 source_col: str | None = None, row_id_col: str | None = None,
                 extra: list[str] | None = None) -> DataFrame:
    """One simultaneous select for one file: every main column in mapping order.

    A single source is renamed; several are merged with ``concat_ws`` (nulls
    skipped, all-null gives ``''``); a main column without source here is null.
    Because all outputs come from one ``select``, a source shared by two main
    columns, a main named like a source, or swapped names all work.
    """
    by_main: dict[str, list[str]] = {}
    for main, f, _, src in sorted(rows, key=lambda r: r[2]):
        if f == file:
            by_main.setdefault(main, []).append(src)
    check_columns(df, file, [s for srcs in by_main.values() for s in srcs])
    exprs = []
    for main in mains:
        srcs = by_main.get(main, [])
        if len(srcs) == 1:
            e = _as_text(col_ref(srcs[0]), df, srcs[0])
        elif srcs:
            e = F.concat_ws(sep, *[_as_text(col_ref(s), df, s) for s in srcs])
        else:
            e = F.lit(None).cast("string")
        if fill is not None:
            e = F.coalesce(e, F.lit(fill))
        exprs.append(e.alias(main))
    if source_col:
        exprs.append(F.lit(file).alias(source_col))
    if row_id_col:
        exprs.append(F.monotonically_increasing_id().alias(row_id_col))
    exprs += [col_ref(c) for c in extra or []]
    return df.select(*exprs)


def homogenize(tables: Mapping[str, DataFrame], mapping, fill: str | None = "",
               sep: str = " ", source_col: str | None = None,
               row_id_col: str | None = None) -> DataFrame:
    """Combined table: main columns in mapping order, all ``string``.

    ``fill`` replaces nulls (the reference writes ``''``); ``None`` keeps them.
    ``source_col`` adds the file name as lineage, ``row_id_col`` a per-file
    ``monotonically_increasing_id`` (unique only together with the file).
    """
    rows = mapping_rows(mapping)
    mains = main_columns(rows)
    files = files_in_order(rows)
    if not files:
        raise NoTablesError("empty column mapping")
    parts = []
    for f in files:
        if f not in tables:
            from confluo.errors import FileNotFound
            raise FileNotFound(f"file {f} not in the session")
        parts.append(project_file(tables[f], f, rows, mains, fill, sep, source_col, row_id_col))
    # every part has the same columns in the same order: a positional union
    return reduce(DataFrame.union, parts)
