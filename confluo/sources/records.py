"""CSV with records over several lines, read in parallel within a file.

Spark's multi-line reader takes a file as one task.  Here the lines of every
split are read where they lie, and each split learns whether it starts inside a
quoted field:

1. one scan runs every split's quotes from both possible beginnings, outside
   and inside a quoted field; lines without a quote change nothing and send no
   text to Python;
2. composing the splits' results in file order (a row a split reaches the
   driver) gives every split its beginning.  Where no record goes over a line
   end, Spark's own line reader reads the files;
3. otherwise each split joins the lines of its records; a record that crosses
   splits is put together from its fragments, at most two of a split.

A quote counts where the reader would count it: at the start of a field, or
inside a quoted one.  A quote amid an unquoted value is text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.errors import BrokenRecordError
from confluo.sources.csv import csv_options, read_csv, source_file_name

#: Kinds of what :func:`_records` yields: a record of one split, the end of one
#: that began in an earlier split, the beginning of one that goes on, and the
#: same of a file's header.
WHOLE, LATER, EARLY, HEADER = 2, 1, 0, -1


def ends_inside(line: str, inside: bool, sep: str = ",", quote: str = '"', escape: str = '"') -> bool:
    """Whether a quoted field is open after ``line``, if one is open before it or not."""
    i, n = 0, len(line)
    while True:
        if not inside and line.startswith(quote, i):
            inside, i = True, i + 1
        if inside:
            while True:
                j = line.find(quote, i)
                if escape != quote:
                    e = line.find(escape, i, len(line) if j < 0 else j)
                    if e >= 0:
                        i = e + 2
                        continue
                if j < 0:
                    return True
                if escape == quote and line.startswith(quote, j + 1):
                    i = j + 2
                    continue
                break
            inside, i = False, j + 1
        k = line.find(sep, i)
        if k < 0 or i > n:
            return False
        i = k + len(sep)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(value, file, start, name)``: the lines, their file's hash and split's start."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        source_file_name().alias("name"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """``((file, start), first, last)`` of a batch's stretches from one split."""
    file, start = (batch[c].to_numpy(zero_copy_only=False) for c in ("file", "start"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
        if b > a:
            yield (int(file[a]), int(start[a])), int(a), int(b)


def _transfers(sep: str, quote: str, escape: str):
    """Maps the quoted lines of each split to where both beginnings lead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, int], list[bool]] = {}
        for batch in batches:
            for key, a, b in _runs(batch):
                state = done.setdefault(key, [False, True, False])
                for line in batch["value"].slice(a, b - a).drop_null().to_pylist():
                    state[0] = ends_inside(line, state[0], sep, quote, escape)
                    state[1] = ends_inside(line, state[1], sep, quote, escape)
                    state[2] |= state[0]
        if done:
            yield pa.RecordBatch.from_pydict({
                "file": [k[0] for k in done], "start": [k[1] for k in done], "from_outside": [s[0] for s in done.values()],
                "from_inside": [s[1] for s in done.values()], "crossed": [s[2] for s in done.values()]})
    return run


def splits_of(spark: SparkSession, paths: list[str], sep: str = ",", quote: str = '"', escape: str = '"') -> dict | None:
    """``{(file, start): starts inside a quoted field}`` of all splits, or None
    where no record goes over a line end."""
    quoted = _lines(spark, paths).select(F.when(F.contains("value", F.lit(quote)), F.col("value")).alias("value"), "file", "start")
    rows = quoted.mapInArrow(_transfers(sep, quote, escape),
                             "file long, start long, from_outside boolean, from_inside boolean, crossed boolean").collect()
    if not any(r.crossed for r in rows):
        return None
    out, inside, file = {}, False, None
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        inside = inside and r.file == file
        out[r.file, r.start] = inside
        inside, file = (r.from_inside if inside else r.from_outside), r.file
    return out


def _records(splits, fragments: bool, sep: str, quote: str, escape: str):
    """Joins each split's lines to records: ``(record, file, start, part, name,
    place)``, its whole records or (``fragments``) the others.  ``place``: the
    records that begin in the split before this one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = splits.value
        key, name, inside, header, later, held, begun = None, None, False, False, False, [], 0

        def part() -> int:
            return LATER if later else HEADER if header else EARLY

        for batch in batches:
            out: list[tuple] = []  # (array of records, key, part, name, first place)

            def give(records: pa.Array, kind: int, out=out) -> None:
                nonlocal begun
                if (kind != WHOLE) == fragments and len(records):
                    out.append((records, key, kind, name, begun))
                if kind in (WHOLE, EARLY):
                    begun += len(records)

            for now, a, b in _runs(batch):
                if now != key:
                    if held:
                        give(pa.array(["\n".join(held)]), part())
                    if now not in starts:
                        raise BrokenRecordError("the files' splits changed between two scans: read them again")
                    key, name, inside, held, begun = now, batch["name"][a].as_py(), starts[now], [], 0
                    header, later = now[1] == 0, inside
                values = batch["value"].slice(a, b - a)
                quoted = np.flatnonzero(pc.match_substring(values, quote).to_numpy(zero_copy_only=False))
                at = 0
                for q in [*quoted.tolist(), len(values)]:
                    plain = values.slice(at, q - at)  # lines without a quote
                    if inside:
                        held += plain.to_pylist()
                    else:
                        plain = plain.filter(pc.invert(pc.is_in(plain, pa.array(["", "\r"]))))
                        if header and len(plain):
                            plain, header = plain.slice(1), False
                        give(plain, WHOLE)
                    if q == len(values):
                        break
                    line = values[q].as_py()
                    held.append(line)
                    inside = ends_inside(line, inside, sep, quote, escape)
                    if not inside:
                        if later:
                            give(pa.array(["\n".join(held)]), LATER)
                        elif not header:
                            give(pa.array(["\n".join(held)]), WHOLE)
                        header = header and later
                        later, held = False, []
                    at = q + 1
            if out:
                yield _as_batch(out)
        if held and fragments:
            yield _as_batch([(pa.array(["\n".join(held)]), key, part(), name, begun)])
    return run


def _as_batch(parts: list[tuple]) -> pa.RecordBatch:
    """Groups of records of one split each, as rows."""
    n = [len(p[0]) for p in parts]
    spread = lambda xs, kind: pa.array(np.repeat(np.array(xs, kind), n))
    _, keys, kinds, names, begun = zip(*parts, strict=True)
    places = np.concatenate([b + np.arange(m) for b, m in zip(begun, n, strict=True)])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([p[0].cast(pa.string()) for p in parts]), spread([k[0] for k in keys], np.int64),
         spread([k[1] for k in keys], np.int64), spread(kinds, np.int32),
         pa.array(np.repeat(np.array(names, object), n), pa.string()), pa.array(places, pa.int64())],
        names=["record", "file", "start", "part", "name", "place"])


_OUT = "record string, file long, start long, part int, name string, place long"


def _stitched(fragments: DataFrame) -> DataFrame:
    """The records that cross splits, headers left out; ``start`` and ``place``
    are those of their beginning."""
    along = Window.partitionBy("file").orderBy("start", F.desc("part"))  # the end of one before the beginning of another
    rows = fragments.withColumn("number", F.sum((F.col("part") != LATER).cast("int")).over(along))
    pieces = F.array_sort(F.collect_list(F.struct("start", (-F.col("part")).alias("order"), "record")))
    return (rows.groupBy("file", "number").agg(
        F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"), F.first("name").alias("name"),
        F.min("part").alias("least"), F.min("start").alias("start"), F.max(F.when(F.col("part") == EARLY, F.col("place"))).alias("place"))
        .where(F.col("least") != HEADER).select("record", "file", "start", "name", "place"))


def _numbered(rows: DataFrame, counts: DataFrame, out: str) -> DataFrame:
    """Adds each record's number in its file, from 0, to rows with ``(file,
    start, place)``.  ``counts``: ``(file, start, n)``, the records that begin
    in each split.  The number says nothing of splits or tasks."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(firsts, ["file", "start"]).withColumn(out, F.col("place") + F.col("before")).drop("before")


def _parsed(records: DataFrame, columns: list[str], options: dict[str, str], more: dict[str, str], crlf: bool) -> DataFrame:
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in columns)
    record = F.replace("record", F.lit("\r\n"), F.lit("\n")) if crlf else F.col("record")
    cells = F.from_csv(F.regexp_replace(record, r"\r$", ""), schema, options)
    return records.select(cells.alias("cells"), *[F.col(c).alias(name) for c, name in more.items()]).select("cells.*", *more.values())


def scan_csv(spark: SparkSession, paths: str | list[str], source_col: str | None = None, row_col: str | None = None,
             columns: list[str] | None = None, **options) -> DataFrame:
    """A1, in parallel within a file: the rows of CSV files that share a header,
    all columns ``string``, records over several lines included.

    The same rows as ``read_csv(multi_line=True)``, in many tasks (but for the
    end of a file inside an open quote: that field ends before the last line
    end).  One scan of the text runs at once, to find records over several
    lines; where there are none, Spark's line reader reads the files.  Line ends
    inside quotes are as in the first file's header: ``\\r\\n`` becomes ``\\n``
    where that ends in it.

    ``source_col`` adds each row's file name, ``row_col`` its number in its file
    (C8: from 0, the same in any splitting, partitioning or repetition; counting
    the splits' records takes one more scan).  ``columns``: the header, if known.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    settings = csv_options(multi_line=True, **options)
    signs = {"sep": settings.get("sep", ","), "quote": settings.get("quote", '"'), "escape": settings["escape"]}
    columns = columns or read_csv(spark, paths, multi_line=True, **options).columns
    more = {k: v for k, v in (("name", source_col), ("row", row_col)) if v}
    splits = splits_of(spark, paths, **signs)
    if splits is None:
        df = read_csv(spark, paths, multi_line=False, **options)
        if not more:
            return df
        rows = df.select(F.struct("*").alias("cells"), source_file_name().alias("name"), F.xxhash64("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        if row_col:
            # ids rise along a split, whichever task reads it
            first = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
            rows = rows.join(first.select("file", "start", "first"), ["file", "start"])
            rows = _numbered(rows.withColumn("place", F.col("at") - F.col("first")), first, "row")
        return rows.select("cells.*", *[F.col(c).alias(name) for c, name in more.items()])
    known = spark.sparkContext.broadcast(splits)
    lines = _lines(spark, paths)
    whole = lines.mapInArrow(_records(known, False, **signs), _OUT)
    rows = whole.drop("part").unionByName(_stitched(lines.mapInArrow(_records(known, True, **signs), _OUT)))
    if row_col:
        rows = _numbered(rows, rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")), "row")
    head = spark.read.option("lineSep", "\n").text(paths[0]).where("value not in ('', '\r')").head()
    crlf = head is not None and head.value.endswith("\r")
    return _parsed(rows, columns, {k: v for k, v in settings.items() if k != "header"}, more, crlf)
