"""Column matching by value: TF-IDF cosine of whole columns, all pairs at once.

Each column is one document (all its values joined by blanks; tokens never
cross values, so no document is ever built).  With two documents per pair
scikit-learn's smooth IDF is 1 for a token both share and ``ln(1.5) + 1``
for a token only one has, so with raw term counts ``tf`` and ``w = (ln 1.5 + 1)²``::

    dot = Σ_shared tfa·tfb      sa = Σ_shared tfa²      ssa = Σ_all tfa²
    sim = dot / (√(sa + w·(ssa − sa)) · √(sb + w·(ssb − sb)))

Plan: explode tokens → ``(table, column, token) → tf`` (map-side combined, so a
frequent token is one row per column), checkpointed once → one row per token
with the columns that hold it, checkpointed likewise → an exact prefix filter
gives the column pairs that can exceed the threshold → these pairs are read off
the tokens' rows and summed before anything is shuffled.  Null cells are ignored.  Counts are multiplied as doubles, so a token that occurs
billions of times cannot overflow.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.functions.nulls import col_ref
from confluo.functions.text import normalize_text, split_words
from confluo.session import reliable_checkpoint

# Two documents per comparison with smooth IDF, so a token in
# only one of them weighs ln(3/2) + 1; a column pair is reported above 0.8.
IDF_ONLY_ONE = math.log(1.5) + 1.0
SIMILARITY_THRESHOLD = 0.8
W = IDF_ONLY_ONE ** 2


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _spread(df: DataFrame) -> DataFrame:
    """A table whose scan has fewer splits than the cluster has cores, dealt out
    to all of them before its text is taken apart; others are read in place."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def column_terms(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None,
                 normalize: bool = False) -> DataFrame:
    """``(table, tidx, column, token, tf)`` over the chosen (default: string) columns."""
    parts = []
    for tidx, (name, df) in enumerate(tables.items()):
        cols = list(columns[name]) if columns and name in columns else _string_columns(df)
        if not cols:
            continue
        cells = F.array(*[F.struct(F.lit(c).alias("column"), col_ref(c).cast("string").alias("value"))
                          for c in cols])
        long = _spread(df.select(*map(col_ref, cols))).select(
            F.lit(name).alias("table"), F.lit(tidx).alias("tidx"), F.inline(cells))
        v = F.col("value")
        if normalize:
            v = normalize_text(F.coalesce(v, F.lit("")))
        # explode the split, then a plain (codegen'd) WHERE on the token length:
        # cheaper than a lambda filter inside the array
        toks = long.select("table", "tidx", "column", F.explode(split_words(v)).alias("token"))
        parts.append(toks.where(F.length("token") >= 2))
    if not parts:
        raise ValueError("no text columns to compare")
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    return terms.groupBy("table", "tidx", "column", "token").agg(F.count(F.lit(1)).alias("tf"))


def _pair_scores(g: DataFrame, tot: DataFrame) -> DataFrame:
    """Similarity from per-pair sums ``dot, sa, sb`` and per-column totals."""
    ta = F.broadcast(tot.select(F.col("table").alias("df1_name"), F.col("column").alias("column_df1"),
                                F.col("ss").alias("ssa")))
    tb = F.broadcast(tot.select(F.col("table").alias("df2_name"), F.col("column").alias("column_df2"),
                                F.col("ss").alias("ssb")))
    g = g.join(ta, ["df1_name", "column_df1"]).join(tb, ["df2_name", "column_df2"])
    na = F.sqrt(F.col("sa") + F.lit(W) * (F.col("ssa") - F.col("sa")))
    nb = F.sqrt(F.col("sb") + F.lit(W) * (F.col("ssb") - F.col("sb")))
    return g.select("column_df1", "column_df2", (F.col("dot") / (na * nb)).alias("similarity"),
                    "df1_name", "df2_name")


def _sums(joined: DataFrame) -> DataFrame:
    return (joined.groupBy("df1_name", "column_df1", "df2_name", "column_df2")
                  .agg(F.sum(F.col("tfa") * F.col("tfb")).alias("dot"),
                       F.sum(F.col("tfa") * F.col("tfa")).alias("sa"),
                       F.sum(F.col("tfb") * F.col("tfb")).alias("sb")))


def _sides(tf: DataFrame):
    a = tf.select(F.col("tidx").alias("ta"), F.col("table").alias("df1_name"),
                  F.col("column").alias("column_df1"), "token", "bucket", F.col("tf").cast("double").alias("tfa"))
    b = tf.select(F.col("tidx").alias("tb"), F.col("table").alias("df2_name"),
                  F.col("column").alias("column_df2"), "token", "bucket", F.col("tf").cast("double").alias("tfb"))
    return a, b


def _postings(tf: DataFrame) -> DataFrame:
    """``(token, dfreq, columns)``: the columns that hold a token, at most one
    entry ``(tidx, table, column, tf)`` each; tokens of one column are left out."""
    held = F.collect_list(F.struct("tidx", "table", "column", F.col("tf").cast("double").alias("tf")))
    return tf.groupBy("token").agg(held.alias("columns")).withColumn("dfreq", F.size("columns")).where("dfreq > 1")


def _pairs(postings: DataFrame) -> DataFrame:
    """``(a, b)``: a row for two columns of different tables that hold a token."""
    return postings.select("columns", F.explode("columns").alias("a")) \
        .select("a", F.explode("columns").alias("b")).where("a.tidx < b.tidx")


def _candidates(postings: DataFrame, tot: DataFrame, threshold: float) -> DataFrame:
    """Column pairs that can exceed ``threshold`` — an exact superset.

    The pair-dependent IDF only shrinks a score (unshared tokens weigh
    ``W > 1`` in the norms), so similarity > t implies cosine > t of the raw
    term counts.  Order tokens by how many columns hold them (rarest first):
    two columns with cosine > t share a token before which each has less
    than ``1 − t²`` of its squared, normalised mass (all-pairs prefix
    filtering, Bayardo et al. 2007).  Tokens are taken a whole frequency
    class at a time, so the per-column running sum is a window over at most
    one row per class (bounded by the number of columns); the mass of the
    tokens that only one column holds is what the others leave of the whole.
    """
    entries = postings.select("token", "dfreq", F.inline("columns"))
    mass = entries.groupBy("tidx", "table", "column", "dfreq").agg(F.sum(F.col("tf") * F.col("tf")).alias("m"))
    line = Window.partitionBy("tidx", "column")
    alone = F.col("ss") - F.sum("m").over(line)
    before = F.coalesce(F.sum("m").over(line.orderBy("dfreq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    keep = (mass.join(F.broadcast(tot), ["table", "column"])
                .withColumn("before", (alone + before) / F.col("ss"))
                .where(F.col("before") < F.lit(1.0 - threshold * threshold + 1e-9))
                .select("tidx", "column", "dfreq"))
    prefix = entries.join(F.broadcast(keep), ["tidx", "column", "dfreq"]) \
        .groupBy("token").agg(F.collect_list(F.struct("tidx", "table", "column")).alias("columns"))
    return _pairs(prefix).select(F.col("a.table").alias("df1_name"), F.col("a.column").alias("column_df1"),
                                 F.col("b.table").alias("df2_name"), F.col("b.column").alias("column_df2")).distinct()


def column_similarity(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None,
                      threshold: float | None = SIMILARITY_THRESHOLD, normalize: bool = False,
                      buckets: int = 64) -> DataFrame:
    """``(df1_name, column_df1, df2_name, column_df2, similarity)`` for every
    pair of columns from two different tables (earlier table on the left)
    whose similarity is above ``threshold`` (strict; ``None`` keeps all pairs
    that share a token).

    Candidates come from the prefix filter whatever the number of columns;
    they are verified over all their shared tokens.  A column's vocabulary is
    spread by its tokens (``buckets`` numbers them), so no task holds a whole one.
    """
    # Tokenise once: every branch below reads this checkpoint (it also cuts
    # the lineage of the expensive explode).
    tf = reliable_checkpoint(column_terms(tables, columns, normalize)
                             .withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")))
    tot = tf.groupBy("table", "column").agg(F.sum(F.col("tf").cast("double") * F.col("tf")).alias("ss"))
    a, b = _sides(tf)
    if threshold is None:
        joined = a.drop("bucket").join(b.drop("bucket"), "token").where(F.col("ta") < F.col("tb"))
    else:
        postings = reliable_checkpoint(_postings(tf))
        cand = _candidates(postings, tot, threshold)
        pairs = _pairs(postings).select(
            F.col("a.table").alias("df1_name"), F.col("a.column").alias("column_df1"),
            F.col("a.tf").alias("tfa"), F.col("b.table").alias("df2_name"),
            F.col("b.column").alias("column_df2"), F.col("b.tf").alias("tfb"))
        joined = pairs.join(F.broadcast(cand), ["df1_name", "column_df1", "df2_name", "column_df2"])
    out = _pair_scores(_sums(joined), tot)
    return out.where(F.col("similarity") > threshold) if threshold is not None else out


def similarity_two(df1: DataFrame, df2: DataFrame, df1_name: str, df2_name: str,
                   threshold: float = SIMILARITY_THRESHOLD, normalize: bool = False) -> DataFrame:
    """Every column of ``df1`` against every column of ``df2`` (the reference's
    per-request comparison), as one job."""
    if df1_name == df2_name:
        df2_name = df2_name + "_2"
    return column_similarity({df1_name: df1, df2_name: df2},
                             {df1_name: df1.columns, df2_name: df2.columns}, threshold, normalize)
