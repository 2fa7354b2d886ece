"""N-gram Jaccard join with adaptive multi-match prefixes (Wang, Li and Feng, 2012).

A document is its set of word n-grams.  With all sets in one global order, rare
n-grams first, two sets with an overlap of o share at least l n-grams in
prefixes that are l - 1 longer than the plain prefix filter's.  Each document
picks its l by the estimated cost of its candidates, from a count of all
n-grams of the corpus folded into a fixed number of counters.  A pair is
verified only where its prefixes share as many n-grams as a true pair must.

Equal sets are one class and take part once.  Links are found in two steps, so
that a large group of near copies is never paired off completely:

1. In each n-gram's list, every class meets the list's most typical class and
   its neighbour.  Verified pairs join into components.
2. Pairs of classes that are still in different components, and only those, are
   enumerated from the smaller component's side, over as few lists as the
   pigeonhole principle allows, and verified.  What is left out is linked
   through its component already, so the components are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import (
    components,
    folding,
    mix,
    release,
    separators_space,
    text_slices,
    whole_rows,
    word_hashes,
    written,
)

#: Bytes of text that a task turns into numbers at a time.
_SLICE = 1 << 19
_BLOCK = 1 << 14
#: Ids of documents with a text to fetch: up to this many are broadcast (16 bytes each).
MOST_BROADCAST_IDS = 500_000


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (fewer words than
    ``width``: the whole sequence as one; none: an empty set)."""
    sep, fold = separators_space(), folding()
    for _, data, off in text_slices(texts, _SLICE):
        h, at = word_hashes(data, off, sep, fold)
        grams = h.copy()
        for k in range(1, width):
            grams[:-k or None] = mix(grams[:-k or None]) + h[k:] if k < len(h) else grams[:0]
        grams = mix(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a:b - width + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for i in range(a, b):
                    one = mix(one + h[i:i + 1])
                yield one
            else:
                yield np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> np.int64:
    """A 64-bit hash of a set."""
    total = np.add.reduce(mix(grams + np.uint64(1)), keepdims=True)
    return mix(total + np.uint64(len(grams))).view(np.int64)[0]


def _in_tasks(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def _signatures(texts: DataFrame, width: int, counters: int) -> DataFrame:
    """One row per document ``(id, n, sig)``, and per task the counters' blocks
    ``(block, counts)`` of the n-grams of the distinct sets that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(counters, np.int32), set()
        names = ["id", "n", "sig", "block", "counts"]
        for batch in batches:
            n, sigs = [], []
            for g in shingle_sets(batch.column(1), width):
                n.append(len(g))
                sigs.append(signature(g) if len(g) else None)
                if len(g) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    np.add.at(count, (g % np.uint64(counters)).astype(np.int64), 1)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.int64()),
                 none.cast(pa.int32()), none.cast(pa.binary())], names)
        blocks = [i for i in range(0, counters, _BLOCK) if count[i:i + _BLOCK].any()]
        if blocks:
            none = pa.nulls(len(blocks)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.array([i // _BLOCK for i in blocks], pa.int32()),
                 pa.array([count[i:i + _BLOCK].tobytes() for i in blocks], pa.binary())], names)

    return _in_tasks(texts, run, "id long, n long, sig long, block int, counts binary")


def _ranks(blocks: DataFrame, counters: int) -> np.ndarray:
    """How frequent the n-grams of each counter are: 0 for a usual load, then
    one more for each doubling (uint8, ``counters`` of them)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                              pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    total = np.zeros(counters, np.int64)
    for r in _in_tasks(blocks.repartition("block"), add, "block int, counts binary").collect():
        part = np.frombuffer(r.counts, np.int64)
        total[r.block * _BLOCK:r.block * _BLOCK + len(part)] = part
    usual = float(np.median(total))
    excess = (total - usual) / (6 * np.sqrt(usual) + 6)
    return np.where(excess < 1, 0, np.log2(np.maximum(excess, 1)).astype(np.int64) + 1).astype(np.uint8)


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection of linked sets of n and m n-grams."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9)).cast("long")


def _entries(texts: DataFrame, width: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Prefix entries ``(token, sig, info)``, info = n << 32 | prefix length."""
    packed, counters = ranks.tobytes(), len(ranks)

    def rows(tokens: list, sigs: list, infos: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sigs)),
             pa.array(np.concatenate(infos))], ["token", "sig", "info"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = np.frombuffer(packed, np.uint8), set()
        for batch in batches:
            tokens, sigs, infos = [], [], []
            for g in shingle_sets(batch.column(0), width):
                n = len(g)
                sig = signature(g) if n else None
                if not n or sig in seen:
                    continue
                seen.add(sig)
                often = rank[(g % np.uint64(counters)).astype(np.int64)]
                order = np.argsort(often, kind="stable")  # g is sorted: ties by hash
                needed = -(-percent * n // 100)
                least = 2 if n >= 20 else 1
                # lengthen while it pays: l shared n-grams cut the candidates by l
                weight = np.cumsum(np.where(often[order] > 0, 1 << np.minimum(often[order].astype(np.int64), 40), 0) + 0.02)
                cost = [(weight[n - needed + k - 1] / k + 0.05 * k, k)
                        for k in range(least, min(needed, least + 4) + 1)] or [(0, 1)]
                prefix = n - needed + min(cost)[1]
                tokens.append(g[order[:prefix]])
                sigs.append(np.full(prefix, sig))
                infos.append(np.full(prefix, (n << 32) | prefix, np.int64))
                if len(tokens) == 1024:
                    yield rows(tokens, sigs, infos)
                    tokens, sigs, infos = [], [], []
            if tokens:
                yield rows(tokens, sigs, infos)

    return _in_tasks(texts, run, "token long, sig long, info long")


def _sets(texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``(sig, grams, brief)`` of the classes in ``reps (sig, id)``; ``brief``:
    the distinct last 16 bits of the n-grams."""
    n = reps.count()
    wanted = reps.select("id").distinct()
    rows = texts.join(F.broadcast(wanted) if n <= MOST_BROADCAST_IDS else wanted, "id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = (g for g in shingle_sets(batch.column(0), width) if len(g))
            while sets := list(itertools.islice(every, 1024)):
                sigs = pa.array([signature(g) for g in sets], pa.int64())
                brief = [np.unique(g.astype(np.uint16)).view(np.int16) for g in sets]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x)))
                         for x in ([g.view(np.int64) for g in sets], brief)]
                yield pa.RecordBatch.from_arrays([sigs, *lists], ["sig", "grams", "brief"])

    return _in_tasks(rows, run, "sig long, grams array<long>, brief array<smallint>").dropDuplicates(["sig"])


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link, by their whole sets.

    First by the sets cut to 16 bits, a quarter of the size: two sets share no
    more n-grams than their cut sets share values, plus what one of them lost
    to equal values.  Few pairs that do not link get past that.
    """
    pairs = written(pairs, f"join-{name}-pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = written(reps.join(used, "sig"), f"join-{name}-reps")
    sets = written(_sets(texts, wanted, width), f"join-{name}-sets")
    n, lost = F.size("grams").alias("n"), (F.size("grams") - F.size("brief")).alias("lost")

    def linked(some: DataFrame, values: str) -> DataFrame:
        left = sets.select(F.col("sig").alias("a"), F.struct(n, lost, F.col(values).alias("v")).alias("x"))
        right = sets.select(F.col("sig").alias("b"), F.struct(n, lost, F.col(values).alias("v")).alias("y"))
        both = F.size(F.array_intersect("x.v", "y.v"))
        if values == "brief":
            both = both + F.least("x.lost", "y.lost")
        return some.join(left, "a").join(right, "b").where(
            F.lit(100) * both >= F.lit(percent) * (F.col("x.n") + F.col("y.n") - both)).select("a", "b")

    near = written(linked(pairs, "brief"), f"join-{name}-near")
    links = written(linked(near, "grams"), f"join-{name}-links")
    release(pairs, wanted, sets, near)
    return links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                       percent: int = 85, counters: int = 1 << 20) -> DataFrame:
    """Groups of documents linked by ``100 * |A & B| >= percent * |A | B|``.

    Returns one row per row of ``df``: ``(id, n_shingles, component_id)``, the
    component being the smallest id reachable through links, its own included.
    Null and empty texts and texts without words have no n-grams, link with
    nothing and are their own component.  Rows with equal sets always share a
    component.  A null id never names a component; rows with one get the
    component of their set (null where no other row has it).  Words are runs of
    other than ASCII white space, A-Z lower-cased.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = written(_signatures(texts, width, counters), "join-signatures")
    rows = first.where("block is null").select("id", "n", "sig")
    ranks = _ranks(first.where("block is not null").select("block", "counts"), counters)
    reps = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("id"))

    n, p = F.shiftright("info", 32).alias("n"), F.col("info").bitwiseAND(F.lit(0xFFFFFFFF)).alias("p")
    everything = Window.partitionBy("token")
    in_order = Window.partitionBy("token").orderBy("sig")
    shared = (_entries(texts.select("text"), width, percent, ranks).repartition("token")
              .withColumn("lo", F.min("sig").over(everything)).withColumn("hi", F.max("sig").over(everything))
              .withColumn("same", F.lag("sig").over(in_order))
              .where("lo != hi and (same is null or same != sig)").select("token", "sig", n, p))
    shared = written(shared, "join-shared")
    # A pair with an overlap of o shares c prefix n-grams, and o <= c + the n-grams
    # behind the prefix that ends first.  ``needs`` is the least c of any partner of
    # a size that occurs in the class's lists (least at either end of the sizes).
    lists = shared.groupBy("token").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    near = shared.join(lists, "token").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("p").alias("p"), F.min("least_n").alias("least_n"),
        F.max("most_n").alias("most_n"), F.array_sort(F.collect_list("token")).alias("tokens"))
    share = lambda m: F.ceil(m * F.lit(percent) / F.lit(100))
    small = F.greatest(F.col("least_n"), share(F.col("n")))
    large = F.least(F.col("most_n"), F.floor(F.col("n") * F.lit(100) / F.lit(percent)))
    at_least = lambda m: least_overlap(F.col("n"), m, percent) - F.greatest(share(F.col("n")), share(m))
    needs = F.greatest(F.lit(1).cast("long"), F.least(at_least(small), at_least(large)))
    classes = written(near.withColumn("needs", needs).where(F.size("tokens") >= F.col("needs"))
                      .withColumn("lone", F.col("p") - F.size("tokens")), "join-classes")

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select(F.col("sig").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "p", "tokens", *more)])

    need = least_overlap(F.col("n_a"), F.col("n_b"), percent) - F.greatest(
        F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    enough = fits & (F.size(F.array_intersect("tokens_a", "tokens_b")) >= need)

    # step 1: the class with the fewest n-grams of its own, and the next in line
    line = Window.partitionBy("token").orderBy("lone", "sig")
    meet = classes.select("sig", "lone", F.explode("tokens").alias("token")).select(
        "sig", F.array(F.first("sig").over(line), F.lag("sig").over(line)).alias("others"))
    meet = meet.select("sig", F.explode("others").alias("other"))
    pairs = meet.where("other != sig").select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")) \
        .distinct().join(side(classes, "a"), "a").join(side(classes, "b"), "b").where(enough).select("a", "b")
    links = _verified(pairs, texts, reps, width, percent, "first")
    found = components(links, "join-first")

    # step 2: pairs across components, asked for by the class in the smaller one
    state = classes.join(found.withColumnRenamed("node", "sig"), "sig", "left") \
        .withColumn("comp", F.coalesce("component", "sig"))
    sizes = state.groupBy("comp").agg(F.count("*").alias("size"))
    state = written(state.join(sizes, "comp").select(
        "sig", "n", "p", "needs", "tokens", F.struct("size", "comp").alias("comp")), "join-state")
    posted = state.select("sig", "n", "p", "comp", "needs", F.explode("tokens").alias("token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("length"), F.max("comp").alias("top"), F.min("comp").alias("low")) \
        .where("top != low").select("token", "length", "top")
    # a partner is in at least ``needs`` of a class's open lists, so in one of the
    # (open - needs + 1) shortest.  All classes take their lists in the same order:
    # at the first list that a pair shares, both have enough lists left for what the
    # pair needs, so it can be passed over wherever one of them has not.
    own = Window.partitionBy("sig")
    opened = written(posted.join(lists, "token").withColumn("open", F.count("*").over(own))
                     .withColumn("place", F.row_number().over(own.orderBy("length", "token")))
                     .where("open >= needs").drop("length"), "join-open")
    x = opened.where("place <= open - needs + 1 and comp != top").select(
        F.col("token").alias("token_a"), F.col("sig").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "p", "open", "place", "comp")])
    y = opened.select(
        F.col("token").alias("token_b"), F.col("sig").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "p", "open", "place", "comp")])
    left = F.least(F.col("open_a") - F.col("place_a"), F.col("open_b") - F.col("place_b")) + 1
    across = x.join(y, (F.col("token_a") == F.col("token_b")) & (F.col("comp_a") < F.col("comp_b"))
                    & (left >= need) & fits).select("a", "b").distinct()
    shown = opened.groupBy("sig").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.collect_list("token").alias("tokens"))
    across = across.join(side(shown, "a"), "a").join(side(shown, "b"), "b").where(enough) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(across, texts, reps, width, percent, "second")
    release(shared, classes, state, opened, found)
    found = components(links.union(more), "join-all")
    release(links, more)

    known = reps.join(found.withColumnRenamed("node", "sig"), "sig", "left") \
        .withColumn("component", F.coalesce("component", "sig"))
    names = known.groupBy("component").agg(F.min("id").alias("component_id"))
    answer = known.join(names, "component").select(F.col("sig").alias("of"), "component_id")
    return rows.join(answer, rows["sig"] == answer["of"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                        percent: int = 80) -> DataFrame:
    """The rows of ``df``, columns as they are, with one document of each group:
    the one with the smallest id, and of rows repeating that id one.  Rows without
    n-grams stay unless they repeat an id; rows without an id all stay."""
    groups = jaccard_components(df, id_col, text_col, width, percent)
    keep = written(groups.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("keep")).count(),
                   "join-keep")
    rows = whole_rows(df, id=df[id_col], tie=F.xxhash64(df[text_col]))
    out = rows.join(keep.select("keep"), F.col("id") == F.col("keep"), "left").where("keep is not null or id is null")
    if keep.where("count > 1").limit(1).count():  # rows repeating an id: one of them
        order = Window.partitionBy("keep").orderBy("tie")
        out = out.withColumn("nth", F.row_number().over(order)).where("keep is null or nth = 1")
    return out.select("row.*")
