"""Row sampling: Spark's Bernoulli sample and a reproducible hash sample."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.nulls import col_ref

# The reference samples 5 % of rows with seed 274.
DEFAULT_FRACTION = 0.05
DEFAULT_SEED = 274


def hash_threshold(fraction: float) -> int:
    """A row is kept iff the first 32 bits of its md5 are below this."""
    return int(round(fraction * 16 ** 8))


def _below(key: Column, fraction: float) -> Column:
    bound = hash_threshold(fraction)
    if bound >= 16 ** 8:  # above every prefix
        return F.lit(True)
    # eight hex digits order as the number does
    return F.substring(F.md5(key), 1, 8) < F.lit(f"{bound:08x}")


def bernoulli_sample(df: DataFrame, fraction: float = DEFAULT_FRACTION, seed: int = DEFAULT_SEED,
                     place: list[str] | None = None) -> DataFrame:
    """Every row on its own with probability ``fraction`` (J1, without replacement).

    The random number of a row is a hash of the seed and of the row's place, its
    file's name and its number in the file: equal rows fare independently, and
    the sample is the same in any partitioning, splitting or repetition.  Of
    Parquet files the place is known; ``place`` names columns that hold it
    otherwise (such as ``scan_csv``'s file and row).  Where neither is there,
    Spark's own sample is taken, which depends on the partitioning.
    """
    if fraction >= 1:
        return df
    if place:
        at = [col_ref(c).cast("string") for c in place]
        return df.where(_below(F.concat_ws("|", F.lit(str(seed)), *at), fraction))
    try:
        row = F.col("_metadata.row_index")
        at = [F.col("_metadata.file_name"), row.cast("string")]
        return df.where(_below(F.concat_ws("|", F.lit(str(seed)), *at), fraction)).select(*map(col_ref, df.columns))
    except AnalysisException:  # no Parquet scan below
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, keys: list[str] | None = None, fraction: float = DEFAULT_FRACTION,
                seed: int = DEFAULT_SEED) -> DataFrame:
    """Keep a row iff ``md5(seed|key…)`` falls below ``fraction`` — the same rows
    on any partitioning, any engine and any re-run (a pushed-down filter).
    Without ``keys`` the whole row is the key (equal rows share a fate)."""
    if fraction >= 1:
        return df
    keys = list(keys) if keys else list(df.columns)
    return df.where(_below(F.concat_ws("|", F.lit(str(seed)), *[col_ref(k).cast("string") for k in keys]), fraction))
