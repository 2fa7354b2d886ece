"""Merkle dataset manifest, with checkpoints of the tree and recomputation between them.

Every row is a leaf, a SHA-256 over its columns.  Leaves of one group (``tree``)
stand in the order of their ids; runs of ``fan`` neighbours are hashed into
their parent until one node, the group's subroot, is left.  The subroots, in
the order of the groups, are the leaves of one more tree, whose last node is
the dataset's root.

Only every ``every``-th level is stored: a stored node stands for an aligned
subtree of at most ``fan ** every`` stored descendants, which is what one row
of :func:`_subtrees` holds.  Building keeps the subtree's last node.  A proof is
made from the root downwards: a subtree's missing interior nodes are computed
again from its stored descendants, every descendant gets its siblings in front
of the path that came from above, and the interior nodes are gone with the row.
No step holds more than one subtree of a group, however large the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import written

PATH = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """A column as it is hashed: ``-`` for null, else its UTF-8 byte count, ``:``, its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The hex SHA-256 of the framed columns, one behind the other."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """The hex SHA-256 of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds ``place``, the number of nodes of the tree that stand before a row's
    first, and ``size``, the tree's nodes.  ``copies``: the nodes of a row.

    Rows are dealt by range and numbered within their range; a range's start
    comes from the counts of those before it (a row for each tree and range).
    """
    ranged = written(rows.repartitionByRange(tree, *order).withColumn("range", F.spark_partition_id()), name)
    counts = ranged.groupBy(F.col(tree).alias("t"), F.col("range").alias("r")).agg(F.sum("copies").alias("c"))
    before = Window.partitionBy("t").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("t", "r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"),
                           F.sum("c").over(Window.partitionBy("t")).alias("size"))
    within = Window.partitionBy(tree, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("place", F.coalesce(F.sum("copies").over(within), F.lit(0)))
            .join(starts, F.col(tree).eqNullSafe(F.col("t")) & (F.col("range") == F.col("r")))
            .withColumn("place", F.col("place") + F.col("start")).drop("t", "r", "start", "range"))


def _subtrees(level: DataFrame, fan: int, every: int) -> DataFrame:
    """One row for each aligned subtree above a stored level, ``(tree, block,
    size, nodes, level0 ... level<every>)``: its stored nodes in order, and all
    levels up to the next stored one."""
    out = (level.withColumn("block", F.floor(F.col("place") / F.lit(fan ** every)).cast("long"))
           .groupBy("tree", "block").agg(F.first("size").alias("size"),
                                         F.array_sort(F.collect_list(F.struct("place", "digest", "carried"))).alias("nodes"))
           .withColumn("level0", F.col("nodes.digest")))
    for j in range(every):
        # a level that is one node already is the tree's last
        out = out.withColumn(f"level{j + 1}", F.when(F.col("size") > F.lit(fan ** j), _parents(f"level{j}", fan))
                             .otherwise(F.col(f"level{j}")))
    return out


def _parents(level: str, fan: int) -> Column:
    """The digests of a level's runs of ``fan`` nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fan).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * fan + 1, fan), ""), 256))


def _stored_levels(leaves: DataFrame, largest: int, fan: int, every: int, name: str) -> list[DataFrame]:
    """The stored levels of all trees, the leaves first, until every tree is one
    node.  ``leaves``: a written table ``(tree, place, size, digest, carried)``;
    ``largest``: the leaves of the largest tree."""
    levels = [leaves]
    while largest > 1:
        largest = -(-largest // fan ** every)
        up = _subtrees(levels[-1], fan, every).select(
            "tree", F.col("block").alias("place"),
            F.ceil(F.col("size") / F.lit(fan ** every)).cast("long").alias("size"),
            F.col(f"level{every}")[0].alias("digest"), F.lit(None).cast("string").alias("carried"))
        levels.append(written(up, f"{name}-{len(levels)}"))
    return levels


def _paths(levels: list[DataFrame], top: DataFrame, fan: int, every: int) -> DataFrame:
    """``(place, digest, carried, path, more)`` of every leaf.  ``top``: ``(tree,
    path, more)``, the path from each tree's last node on and what to hand down."""
    above = top.select("tree", F.lit(0).cast("long").alias("block"), "path", "more")
    if len(levels) == 1:  # single leaves: the paths from above are theirs
        return levels[0].join(above.drop("block"), "tree").select("tree", "place", "digest", "carried", "path", "more")
    for level in reversed(levels[:-1]):
        cut = _subtrees(level, fan, every).join(above, ["tree", "block"])
        each = cut.select("*", F.posexplode("nodes").alias("i", "node"))
        steps = []
        for j in range(every):
            start = F.floor(F.col("i") / fan ** (j + 1)).cast("int") * fan
            at = F.floor(F.col("i") / fan ** j).cast("int") % fan
            run = F.col(f"level{j}")
            steps.append(F.when(F.col("size") > F.lit(fan ** j), F.array(F.struct(
                F.array_join(F.slice(run, start + 1, at), "").alias("left"),
                F.array_join(F.slice(run, start + at + 2, F.lit(fan) - at - 1), "").alias("right"))))
                .otherwise(F.array().cast(PATH)))
        above = each.select("tree", F.col("node.place").alias("block"), F.col("node.digest").alias("digest"),
                            F.col("node.carried").alias("carried"), F.concat(*steps, F.col("path")).alias("path"), "more")
    return above.withColumnRenamed("block", "place")


def merkle_proofs(df: DataFrame, id_col: str = "doc_id", tree_col: str = "source",
                  columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                  carry: Mapping[str, Column] | None = None, fan: int = 3, every: int = 3) -> DataFrame:
    """The manifest of a table and the proof of every row.

    Returns one row per input row: ``(id, leaf, subroot, root, path)`` and the
    columns of ``carry`` (string expressions over the input, such as digests to
    verify).  ``path`` has one ``(left, right)`` per level, from the leaf up
    through the subroot to the root: the siblings before and after the node, as
    concatenated hex digests, empty where there are none.  ``fold(leaf, path)``
    gives ``root``.

    A null in any column is hashed as null, unlike an empty text.  Rows without
    a tree value are a tree of their own, the first.  Null ids come first;
    rows of one id stand in the order of their leaves; rows repeated whole are
    as many leaves, which take neighbouring places.  An empty table gives no
    rows.  Columns not named are not read.
    """
    carry = dict(carry or {})
    rows = df.select(F.col(id_col).alias("id"), F.col(tree_col).alias("group"),
                     leaf_digest([F.col(c) for c in columns]).alias("digest"),
                     F.struct(*[c.cast("string").alias(k) for k, c in carry.items()], F.lit(0).alias("none")).alias("extra"))
    # a row repeated many times is one row until its places are known
    rows = rows.groupBy("id", "group", "digest", "extra").agg(F.count(F.lit(1)).alias("copies"))
    placed = written(_placed(rows, "group", ["id", "digest"], "merkle-rows"), "merkle-placed")
    groups = placed.groupBy("group").agg(F.first("size").alias("nodes")) \
        .withColumn("copies", F.lit(1).cast("long")).withColumn("tree", F.lit(0).cast("long"))
    trees = written(_placed(groups, "tree", ["group"], "merkle-groups")
                    .select("group", F.col("place").alias("number"), "nodes", F.col("size").alias("trees")), "merkle-trees")
    largest = trees.agg(F.max("nodes").alias("nodes"), F.max("trees").alias("trees")).first()

    leaves = placed.withColumnRenamed("group", "g").join(trees, F.col("g").eqNullSafe(F.col("group")))
    leaves = leaves.select(
        F.col("number").alias("tree"), "size", "digest", F.struct("id", "extra").alias("carried"),
        F.explode(F.sequence(F.col("place"), F.col("place") + F.col("copies") - 1)).alias("place"))
    levels = _stored_levels(written(leaves, "merkle-leaves"), largest.nodes or 0, fan, every, "merkle-level")
    tops = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    tops = tops.join(trees.select(F.col("number").alias("place"), F.col("trees").alias("size")), "place")
    top_levels = _stored_levels(
        written(tops.select("tree", "place", "size", "digest", F.lit(None).cast("string").alias("carried")), "merkle-tops"),
        largest.trees or 0, fan, every, "merkle-top-level")
    root = top_levels[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("more"))
    subroots = _paths(top_levels, root, fan, every).select(
        F.col("place").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("more").alias("root")).alias("more"))
    subroots = written(subroots, "merkle-subroots")
    out = _paths(levels, subroots, fan, every)
    return out.select(F.col("carried.id").alias(id_col), F.col("digest").alias("leaf"),
                      F.col("more.subroot").alias("subroot"), F.col("more.root").alias("root"), "path",
                      *[F.col(f"carried.extra.{k}").alias(k) for k in carry])
