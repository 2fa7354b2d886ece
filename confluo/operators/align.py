"""Aligned union of tables with differing headers (bag semantics)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.errors import HeaderCollisionError, NoTablesError


def _as_items(tables) -> list[tuple[str, DataFrame]]:
    if isinstance(tables, Mapping):
        return list(tables.items())
    items = list(tables)
    if items and isinstance(items[0], DataFrame):
        return [(str(i), df) for i, df in enumerate(items)]
    return items


def distinct_columns(tables) -> list[str]:
    """The set of all header names, in first-seen order (deterministic)."""
    seen: dict[str, None] = {}
    for _, df in _as_items(tables):
        for c in df.columns:
            seen.setdefault(c, None)
    return list(seen)


def align_union(tables: Mapping[str, DataFrame] | Iterable, source_col: str | None = None,
                merge_case: bool = False) -> DataFrame:
    """Union of all tables by column name; a column absent from a table is null.

    Headers that differ only in case raise :class:`HeaderCollisionError`, or on
    request (``merge_case``) are one column under the first spelling; two of
    them in one table always raise.  A column whose type differs between tables
    is cast to string.

    Columns come in first-seen order; rows keep table order then row order;
    duplicates are kept.  A narrow plan: no shuffle, one scan per table.
    """
    items = _as_items(tables)
    if not items:
        raise NoTablesError("no tables to align")
    cols = distinct_columns(items)
    spelling: dict[str, str] = {}
    for c in cols:
        spelling.setdefault(c.lower(), c)
    if len(spelling) < len(cols):
        variants = [c for c in cols if sum(c.lower() == d.lower() for d in cols) > 1]
        twice = [n for n, df in items if len({c.lower() for c in df.columns}) < len(df.columns)]
        if twice or not merge_case:
            raise HeaderCollisionError(f"headers differ only in case: {variants}")
        cols = list(spelling.values())
    types: dict[str, set] = {c: set() for c in cols}
    for _, df in items:
        for f in df.schema.fields:
            types[spelling[f.name.lower()]].add(f.dataType)
    kind = {c: next(iter(t)) if len(t) == 1 else T.StringType() for c, t in types.items()}
    parts = []
    for name, df in items:
        # columns by place: names that differ in case would be ambiguous
        at = {spelling[c.lower()]: i for i, c in enumerate(df.columns)}
        placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        exprs = [(F.col(f"c{at[c]}") if c in at else F.lit(None)).cast(kind[c]).alias(c) for c in cols]
        parts.append(placed.select(*exprs, *([F.lit(name).alias(source_col)] if source_col else [])))
    return reduce(DataFrame.union, parts)
