"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A text is a set of weighted terms: its words, each weighing as much as it
occurs.  For each of the fingerprint's places, every term has gamma variates
r, c ~ Gamma(2, 1) and an offset b ~ U(0, 1), drawn from hashes of the term and
the place.  A term of weight w is sampled at t = floor(ln w / r + b),
y = exp(r (t - b)), with the key a = c / (y exp(r)); the term with the smallest
key is the place's sample.  Two texts agree at a place with the probability of
their generalised Jaccard similarity, sum(min(w, w')) / sum(max(w, w')).

From uniform u1, u2 come r = -ln(u1 u2) and b = ln u2 / ln(u1 u2), which are
independent, Gamma(2, 1) and uniform.  Then r (1 - b) = -ln u1, so that
a = c u1 (u1 u2) ** t, where t = 0 just for u1 < 1 / w: always for a term that
occurs once, which takes one logarithm.

The smallest key itself stands for the sample (term, t): it is a function of
both, and distinct samples have distinct keys but for chance.  DataFrame
operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import written

#: Places of a fingerprint.  The likeness has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 64
#: Places whose smallest keys one row of the aggregation holds.
LANES = 16
#: Sets the places' hashes of a term apart (odd; times a place it stays a long).
STRIDE = 0x9E3779B97F4A7


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number in (0, 1) from ``width`` bits of a 64-bit hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -width)


def sample_key(term: Column, n: Column, place: Column) -> Column:
    """The key a of a term (a 64-bit hash) that occurs n times, at a place."""
    number = place.cast("long") * 2
    first = F.xxhash64(term.bitwiseXOR(number * STRIDE))
    second = F.xxhash64(term.bitwiseXOR((number + 1) * STRIDE))
    u1, u2 = _uniform(first, 0, 32), _uniform(first, 32, 32)
    c = -F.ln(_uniform(second, 0, 32) * _uniform(second, 32, 32))
    t = F.floor((F.ln(u2) - F.ln(n)) / F.ln(u1 * u2))
    # t is 0 just where -ln u1 > ln n
    return c * u1 * F.when(u1 * n < 1.0, F.lit(1.0)).otherwise(F.pow(u1 * u2, t.cast("double")))


def weighted_samples(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``(keys, samples)``: the fingerprint of every row of ``rows``, which
    ``keys`` tell apart, as an array of ``samples`` 32-bit numbers, all 0 for a
    text without words.  Words are runs between blanks, as they are spelled.

    One aggregation counts a row's terms, one takes the smallest keys, one
    collects the places; where the rows lie partitioned by some of ``keys`` none
    of them moves any.
    """
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    each = rows.select(*keys, F.explode(words).alias("w"))
    # an empty word (of an empty text, or beside leading and trailing blanks) is no term
    each = each.select(*keys, F.when(F.col("w") != "", F.xxhash64("w")).alias("term"))
    terms = each.groupBy(*keys, "term").agg(F.count("term").alias("n"))
    # a group of places at a time, so that the compiled aggregation stays small
    parts = terms.select(*keys, "term", "n", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // LANES))).alias("part"))
    present = F.col("term").isNotNull()
    smallest = parts.groupBy(*keys, "part").agg(*[
        F.min(F.when(present, sample_key(F.col("term"), F.col("n"), F.col("part") * LANES + i))).alias(f"s{i}")
        for i in range(LANES)])
    codes = [F.coalesce(F.when(F.col(f"s{i}").isNotNull(), F.xxhash64(f"s{i}")).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))
             for i in range(LANES)]
    whole = smallest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", F.array(*codes).alias("codes")))).alias("p"))
    return whole.select(*keys, F.slice(F.flatten("p.codes"), 1, samples).alias("samples"))


def as_text(samples: Column) -> Column:
    """A fingerprint as text: eight hex digits a place."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of places where two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: ``(id, samples)``, see :func:`weighted_samples`.

    Equal texts are sampled once.  A null text counts as empty; texts without
    words are alike and unlike all others; ids may be null or repeat.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text, 256)
    distinct = df.select(sha.alias("sha"), text.alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    known = weighted_samples(distinct, ["sha"], "text", samples)
    return df.select(F.col(id_col), sha.alias("sha")).join(known, "sha").select(id_col, "samples")


def _buckets(df: DataFrame, bucket_rows: int, most_cuts: int) -> tuple[Column, Column]:
    """A bucket number and the order of the rows inside a bucket, so that the
    buckets' rows, one bucket behind the other, stand in descending order of
    ``(id, tie)``, nulls last.

    Cuts are quantiles of the ids; a cell between two cuts is divided evenly
    where it holds more than ``bucket_rows``; an id that fills whole cells is
    divided by its ties.  At most ``most_cuts`` numbers reach the driver.
    """
    n, nulls = df.agg(F.count("id"), F.count_if(F.col("id").isNull())).first()
    cells = max(1, min(most_cuts, n // bucket_rows))
    found = df.agg(F.percentile_approx("id", [i / cells for i in range(cells)], 10 * most_cuts)).first()[0] or []
    parts = max(1, math.ceil(n / cells / bucket_rows))  # of a cell
    cuts = sorted(set(found))
    repeated = [(c, found.count(c) * parts) for c in cuts if found.count(c) > 1]
    by_tie = (F.lit(1.0) - F.col("tie") / F.lit(2.0 ** 63)) / 2
    span = max([parts, *(k + parts for _, k in repeated), 1 + nulls // bucket_rows]) + 1
    tie_part = lambda k: F.least(F.floor(by_tie * k), F.lit(k - 1))
    # the cell, counted from the greatest ids, by a look at every step-th cut and at the cuts of one step
    step = math.isqrt(len(cuts)) + 1
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    not_above = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("id")))
    steps = not_above(array(cuts[step::step])) * step
    cell = len(cuts) - steps - not_above(F.slice(array(cuts), steps + 1, step))
    part = F.lit(0)
    if parts > 1:
        ends = F.array(*map(F.lit, [cuts[-1] + 1, *reversed(cuts)]))
        high, low = F.element_at(ends, F.least(cell + 1, F.lit(len(cuts)))), F.element_at(ends, F.least(cell + 2, F.lit(len(cuts) + 1)))
        part = F.greatest(F.lit(0), F.least(F.floor((high - F.col("id")) / F.greatest(F.lit(1), high - low) * parts), F.lit(parts - 1)))
    for c, k in repeated:  # behind the cell's other ids
        part = F.when(F.col("id") == c, parts + tie_part(k)).otherwise(part)
    bucket = F.when(F.col("id").isNull(), F.lit((len(cuts) + 1) * span) + tie_part(1 + nulls // bucket_rows)) \
        .otherwise(cell * span + part)
    return bucket.cast("long"), F.struct("id", "tie")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 256,
              most_cuts: int = 1000, task_rows: int = 1000, most_tasks: int = 20_000) -> DataFrame:
    """``(bucket, number, extra, id, text, next_text)``: each row with the text of the
    row that follows in descending order of the ids (null ids last, equal ids
    in the order of a hash of their texts), the first after the last.

    Texts move once, to buckets of neighbouring ids; a bucket also gets the
    first row of the bucket behind it, as ``extra`` row.  ``(bucket, number)``
    tells rows apart.  The rows lie partitioned by ``bucket``, about
    ``task_rows`` in a partition (fewer in a small table, which takes the
    session's number of partitions; more where that took over ``most_tasks``).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    bucket, order = _buckets(rows, bucket_rows, most_cuts)
    rows = rows.withColumn("bucket", bucket)
    # a bucket's first row is shown again at the end of the bucket before it
    heads = rows.groupBy("bucket").agg(F.max(order).alias("head"))
    turn = Window.orderBy("bucket")  # one small row a bucket
    before = F.coalesce(F.lag("bucket").over(turn), F.max("bucket").over(
        turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = written(heads.select(F.col("bucket").alias("own"), "head", before.alias("shown_in")), "fingerprint-heads")
    shown = rows.join(heads, (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("head.id"))
                      & (F.col("tie") == F.col("head.tie"))).groupBy("own").agg(
        F.first("shown_in").alias("bucket"), F.first("id").alias("id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    both = rows.select("bucket", "id", "tie", "text", F.lit(0).alias("extra")).unionByName(
        shown.select("bucket", "id", "tie", "text", F.lit(1).alias("extra")))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(most_tasks, df.count() // task_rows))
    both = both.repartition(tasks, "bucket")
    along = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("id"), F.desc("tie"))
    return both.select("bucket", F.row_number().over(along).alias("number"), "extra", "id", "text",
                       F.lead("text").over(along).alias("next_text"))


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts, of the same texts with their ends replaced by
    the next text's start, and their likeness.

    The next text is that of :func:`with_next`.  Of a text of n characters the
    last floor(n / 3) are replaced by as many of the next one's first, or by
    all of them.  Returns ``(id, n_chars, edited_sha256, samples,
    edited_samples, near_edited, near_next)``, one row per input row.  A null
    text counts as empty; texts without words are alike and unlike all others;
    a table of one row is its own next; an empty table gives no rows.
    """
    rows = with_next(df, id_col, text_col)
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), k))
    rows = rows.select("bucket", "number", "extra", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    # the digest goes along as four numbers: keys of fixed width are hashed and compared faster
    parts = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"sha{i}")), 16, "0") for i in range(4)])
    kind = lambda k, t: F.struct(F.lit(k).alias("kind"), F.col(t).alias("t"))
    kinds = F.when(F.col("extra") == 0, F.array(kind(0, "text"), kind(1, "edited"))).otherwise(F.array(kind(2, "text")))
    own = ["bucket", "number", "id", "n_chars"]
    sampled = weighted_samples(rows.select(*own, *parts, F.inline(kinds)), [*own, *[f"sha{i}" for i in range(4)], "kind"],
                               "t", samples)
    # a bucket's rows by number, each text before its edited one, then the extra row
    along = Window.partitionBy("bucket").orderBy("number", "kind")
    out = sampled.select("*", F.lead("samples", 1).over(along).alias("edited_samples"), F.lead("samples", 2).over(along).alias("next"))
    return out.where("kind = 0").select(
        F.col("id").alias(id_col), "n_chars", sha.alias("edited_sha256"), "samples", "edited_samples",
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next")).alias("near_next"))
