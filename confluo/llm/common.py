"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.session import scratch_path

#: Fixed odd multipliers of the 64-bit hashes below (splitmix64's and two others).
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared scratch folder: cuts the lineage,
    and a lost executor costs a re-read instead of a re-computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


#: Rows of a file that are numbered together.
_ORDER_ROWS = 1 << 16


def written_order(df: DataFrame) -> tuple[Column, Column]:
    """``(part, within)``: the order in which rows were written, of a table that
    :func:`written` returned.  A part is up to 65,536 rows of a file; files come
    by the number of the task that wrote them, rows by their place in the file."""
    file = df.metadataColumn("_metadata")
    name, row = file["file_name"], file["row_index"]
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    return F.struct(number("^part-([0-9]+)").alias("task"), number("-c([0-9]+)[.]").alias("file"),
                    F.floor(row / F.lit(_ORDER_ROWS)).alias("rows")), row


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` made, once nothing will read them."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` with each row in one column ``row`` and further columns beside it,
    so that no name of ``df`` meets one used inside; ``row.*`` gives it back."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in more.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def number_within(df: DataFrame, group: str, bucket: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each ``group``, in the order of
    ``bucket`` (a column of many hash values), then ``order``.

    No task holds a whole group: rows are numbered within (group, bucket), and
    the buckets' starts come from a running sum over their counts (one row per
    group and bucket).
    """
    g, b, start = f"__{out}_group", f"__{out}_bucket", f"__{out}_start"
    counts = df.groupBy(F.col(group).alias(g), F.col(bucket).alias(b)).count()
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(g, b, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start))
    w = Window.partitionBy(group, bucket).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(w) - F.lit(1))
    return (numbered.join(starts, F.col(group).eqNullSafe(F.col(g)) & F.col(bucket).eqNullSafe(F.col(b)))
            .withColumn(out, F.col(out).cast("long") + F.col(start)).drop(g, b, start))


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``links (a, b)``: ``(node, component)``, the
    component being its smallest node.

    Labels move along the links and jump to their label's label (hooking and
    pointer jumping, as in FastSV), so a path of n nodes takes about log n
    rounds.  Every round is written to the shared folder; only a count of
    changed rows reaches the driver.  Hub nodes are safe: minima are combined
    before the shuffle and the join on a hub's id is one AQE can split.
    """
    spark = links.sparkSession
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct()
                   .toDF("u", "v"), f"{name}-links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("p")), f"{name}-0")
    for i in range(1, rounds + 1):
        up = labels.select(F.col("node").alias("p"), F.col("p").alias("g"))
        grand = labels.join(up, "p").select("node", "p", "g")
        near = (both.join(grand.select(F.col("node").alias("v"), "g"), "v")
                .groupBy("u").agg(F.min("g").alias("m")))
        state = grand.join(near, F.col("node") == F.col("u")).select("node", "p", "g", "m")
        votes = state.select(F.explode(F.array(
            F.struct("node", F.least("p", "g", "m").alias("p")),
            F.struct(F.col("p").alias("node"), F.col("m").alias("p")))).alias("x")).select("x.*")
        new = written(votes.groupBy("node").agg(F.min("p").alias("p")), f"{name}-{i}")
        moved = new.join(labels.withColumnRenamed("p", "was"), "node").where("p != was").limit(1).count()
        release(labels)
        labels = new
        if not moved:
            release(both)
            out = labels.select("node", F.col("p").alias("component"))
            out.scratch = labels.scratch
            return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")


# ---- helpers inside tasks (numpy over Arrow buffers) -------------------------


def text_slices(texts: pa.StringArray | pa.LargeStringArray | pa.ChunkedArray, most: int):
    """Cuts an Arrow string array into runs of rows of about ``most`` bytes:
    yields ``(first_row, bytes as uint8 array, offsets)``; nulls count as empty.
    A single longer row is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i in 0..n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: Values of the bytes in the polynomial hashes.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_hashes(data: np.ndarray, power: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(byte j) * base**j over j < i, mod 2**64."""
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(BYTE_VALUES[data] * power[:len(data)], out=p[1:])
    return p


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray,
                folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts laid end to end, and the
    number of words before each text's end (``len(offsets)`` counts, first 0).

    ``separator``: 256 flags; ``folded``: 256 byte values (lower-casing).
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    starts[cut] = inside[cut]
    ends = np.empty_like(inside)
    ends[:-1] = inside[:-1] & (~inside[1:] | starts[1:])
    ends[-1] = inside[-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data))
    p = prefix_hashes(folded[data], up)
    h = mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, offsets, side="left")


def folding() -> np.ndarray:
    """Byte values with A-Z lower-cased."""
    f = np.arange(256, dtype=np.uint8)
    f[65:91] += 32
    return f


def separators_space() -> np.ndarray:
    """Flags of the bytes that end a word of ``[^\\x20\\x09-\\x0D]+``."""
    s = np.zeros(256, bool)
    s[[32, 9, 10, 11, 12, 13]] = True
    return s


def separators_word() -> np.ndarray:
    """Flags of the bytes that end a word of
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    s = np.ones(256, bool)
    s[48:58] = s[65:91] = s[97:123] = False
    s[128:] = False
    return s
