"""Column-name matching: similar-name pairs, recommendations, greedy groups.

Input is a header catalogue ``(file, file_idx, ordinal, column_name)``.

Pairs are found without a cross join, between distinct normalised names only.
A score of at least t allows two names of lengths la <= lb at most
k = (1 - θ)(la + lb) insertions and deletions, θ = (t - 0.5) / 100.  Cut into
k + 1 pieces, the shorter name must have a piece that stands unchanged in the
longer one, moved by no more than the changes before it (Li et al., Pass-Join,
2011).  So the join key is (la, lb, piece number, piece): a length band and a
q-gram in its place.  The overlap of the two names' character bags bounds the
score of what the join finds; the rest is verified with the native LCS score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.functions.fuzzy import name_key, name_ratio
from confluo.session import reliable_checkpoint, written_table


# A name recommendation needs a score of 90, a name group 80.
RECOMMEND_THRESHOLD = 90
GROUP_THRESHOLD = 80


def _keyed(cat: DataFrame) -> DataFrame:
    return (cat.withColumn("eid", F.shiftleft(F.col("file_idx").cast("bigint"), 32) + F.col("ordinal"))
               .withColumn("key", name_key(F.col("column_name")))
               .withColumn("klen", F.length("key")))


def _allowed(la: Column, lb: Column, theta: float) -> Column:
    """How many insertions and deletions a pair of these lengths may have."""
    return F.floor(F.lit(1.0 - theta) * (la + lb) + F.lit(1e-9)).cast("int")


def _piece_start(i: Column, n: Column, pieces: Column) -> Column:
    """0-based start of piece i of a name of n characters in equal pieces."""
    return F.floor(i * n / pieces).cast("int")


def candidate_keys(keys: DataFrame, theta: float) -> DataFrame:
    """``(key_a, key_b)`` with ``key_a`` the shorter: pairs of distinct names
    that may score θ, each once.  ``keys (key, klen)``."""
    shorter = (keys.where("klen > 0").select("key", F.col("klen").alias("la"), F.explode(F.sequence(
        F.col("klen"), F.floor(F.col("klen") * F.lit((2.0 - theta) / theta) + F.lit(1e-9)).cast("int"))).alias("lb"))
        .withColumn("pieces", _allowed(F.col("la"), F.col("lb"), theta) + 1)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))))
    start = _piece_start(F.col("i"), F.col("la"), F.col("pieces"))
    stop = _piece_start(F.col("i") + 1, F.col("la"), F.col("pieces"))
    shorter = shorter.select("la", "lb", "i", F.expr("key").alias("key_a"),
                             F.substring(F.col("key"), start + 1, stop - start).alias("piece"))
    longer = (keys.where("klen > 0").select("key", F.col("klen").alias("lb"), F.explode(F.sequence(
        F.greatest(F.lit(1), F.ceil(F.col("klen") * F.lit(theta / (2.0 - theta)) - F.lit(1e-9)).cast("int")),
        F.col("klen"))).alias("la"))
        .withColumn("pieces", _allowed(F.col("la"), F.col("lb"), theta) + 1)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))))
    # of k changes with lb - la more insertions than deletions
    fewer = F.floor((F.col("pieces") - 1 - (F.col("lb") - F.col("la"))) / 2).cast("int")
    more = fewer + F.col("lb") - F.col("la")
    longer = longer.select(
        "key", "la", "lb", "i", start.alias("start"), (stop - start).alias("size"),
        F.explode(F.sequence(F.greatest(F.lit(0), start - fewer),
                             F.greatest(F.lit(0), start - fewer, F.least(start + more, F.col("lb") - (stop - start)))))
        .alias("at"))
    longer = longer.select("la", "lb", "i", F.col("key").alias("key_b"),
                           F.expr("substring(key, at + 1, size)").alias("piece")).distinct()
    bag = lambda k: F.split(k, "")
    left_over = F.aggregate(bag(F.col("key_a")), F.struct(F.col("key_b").alias("rest"), F.lit(0).alias("n")), _take)
    return (shorter.join(longer, ["la", "lb", "i", "piece"])
            .where((F.col("la") < F.col("lb")) | (F.col("key_a") < F.col("key_b")))
            .select("key_a", "key_b").distinct()
            .where(F.lit(2.0) * left_over["n"] >= F.lit(theta - 1e-9) * (F.length("key_a") + F.length("key_b"))))


def _take(state: Column, ch: Column) -> Column:
    """Takes one character out of the rest, if it is there, and counts it."""
    at = F.instr(state["rest"], ch)
    return F.when(at > 0, F.struct(
        F.concat(F.substring(state["rest"], F.lit(1), at - 1), F.substring(state["rest"], at + 1, F.length(state["rest"])))
        .alias("rest"), (state["n"] + 1).alias("n"))).otherwise(state)


def name_pairs(cat: DataFrame, threshold: int = GROUP_THRESHOLD) -> DataFrame:
    """Unordered pairs of catalogue entries scoring ≥ threshold.

    ``(eid_l, file_l, file_idx_l, ordinal_l, column_l, eid_r, …, score)`` with
    ``eid_l < eid_r``; equal names in different files are included (score 100),
    so a name that many files share gives a row for each pair of them
    (:func:`equal_names` has one row for each name).  Distinct names are scored
    once each, whatever the number of files.
    """
    theta = (threshold - 0.5) / 100.0
    # the keyed catalogue feeds several branches below: compute it once
    k = reliable_checkpoint(_keyed(cat))
    keys = k.select("key", "klen").distinct()
    scored = (candidate_keys(keys, theta)
              .withColumn("score", name_ratio("key_a", "key_b")).where(F.col("score") >= threshold))
    side = ["eid", "file", "file_idx", "ordinal", "column_name", "key"]
    a = k.select(*[F.col(c).alias(c + "_a") for c in side])
    b = k.select(*[F.col(c).alias(c + "_b") for c in side])
    same = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("eid_a") < F.col("eid_b"))) \
        .withColumn("score", F.lit(100))
    other = scored.join(a, "key_a").join(b, "key_b")
    pairs = same.unionByName(other)
    first = F.col("eid_a") < F.col("eid_b")
    pick = lambda c, s: (F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) if s == "l"
                         else F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    return pairs.select(*[pick(c, s).alias(f"{'column' if c == 'column_name' else c}_{s}")
                          for s in "lr" for c in side[:-1]], "score")


def _names(cat: DataFrame) -> DataFrame:
    """``(name, files)``: each distinct name with all its places in the
    catalogue, in order: the factored form of the catalogue, one row a name."""
    place = F.struct(F.col("file_idx").cast("int").alias("file_idx"), F.col("ordinal").cast("int").alias("ordinal"), "file")
    return cat.groupBy(F.col("column_name").alias("name")).agg(F.array_sort(F.collect_list(place)).alias("files"))


def equal_names(cat: DataFrame) -> DataFrame:
    """``(column_name, files)`` of the names that several files have: one row a
    name, where the pairs of its files would be files²."""
    files = F.array_sort(F.array_distinct("files.file"))
    return _names(cat).select(F.col("name").alias("column_name"), files.alias("files")).where(F.size("files") > 1)


def similar_names(names: DataFrame, threshold: int) -> DataFrame:
    """``(a, b, score)``: both directions of all pairs of different names
    (``names (name)``, distinct) that score ≥ threshold."""
    theta = (threshold - 0.5) / 100.0
    keyed = reliable_checkpoint(names.select("name", name_key(F.col("name")).alias("key")).withColumn("klen", F.length("key")))
    scored = (candidate_keys(keyed.select("key", "klen").distinct(), theta)
              .withColumn("score", name_ratio("key_a", "key_b")).where(F.col("score") >= threshold))
    a = keyed.select(F.col("name").alias("a"), F.col("key").alias("key_a"))
    b = keyed.select(F.col("name").alias("b"), F.col("key").alias("key_b"))
    one = scored.join(a, "key_a").join(b, "key_b").select("a", "b", F.col("score").cast("int").alias("score"))
    alike = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("a") != F.col("b"))).select("a", "b", F.lit(100).alias("score"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(alike)


def factored_recommendations(cat: DataFrame, threshold: int = RECOMMEND_THRESHOLD) -> DataFrame:
    """The recommendations without pairs of files: rows linear in the catalogue.

    ``(column, files, file_right, file_right_idx, kind, similar)``.  ``files``:
    the places of ``column`` as an array of ``(file_idx, ordinal, file)``, in
    order.  Kind ``single`` or ``multi``: ``similar``, ``(rank, column, score)``,
    are the differently named similar columns of the file ``file_right``; the
    row stands for a recommendation of each place whose file is not before that
    one.  Kind ``equal``: a name of several files, one row; it stands for one
    recommendation for each two of them (``file_right`` is null).

    A single match is left out when the reversed pair of names is emitted
    first.  Which direction is first needs one event of each: that of the
    column's last file with the last fitting file on the right.
    """
    names = reliable_checkpoint(_names(cat))
    ends = names.select("name", F.element_at("files", -1)["file_idx"].alias("last"))
    places = cat.select(F.col("column_name").alias("b"), F.col("file_idx").cast("int").alias("right_idx"), F.col("ordinal").alias("right_at"),
                        F.col("file").alias("right"))
    met = similar_names(names.select("name"), threshold).join(places, "b").join(ends.withColumnRenamed("name", "a"), "a")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("right_at").alias("at"), F.col("b").alias("column"))))
    found = reliable_checkpoint(
        met.where("right_idx <= last").groupBy("a", "right_idx", "right").agg(ranked.alias("r"))
        .withColumn("kind", F.when(F.size("r") == 1, "single").otherwise("multi")))
    # the first single event of each direction of a pair of names
    single = found.where("kind = 'single'").select("a", F.col("r")[0]["column"].alias("b"), "right_idx")
    first = single.groupBy("a", "b").agg(F.max("right_idx").alias("j")).join(names.withColumnRenamed("name", "a"), "a")
    last = F.element_at("files", -1)["file_idx"]
    ordinal = F.array_min(F.transform(F.filter("files", lambda f: f["file_idx"] == last), lambda f: f["ordinal"]))
    event = F.struct((-last).alias("k"), (-F.col("j")).alias("j"), ordinal.alias("at"), F.col("a").alias("a"))
    winner = first.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), event.alias("event")) \
        .groupBy("x", "y").agg(F.min("event")["a"].alias("winner"))
    kept = single.select("a", "b").distinct().join(
        winner, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))).where("a = winner").select("a", F.col("b").alias("of"))
    singles = found.where("kind = 'single'").withColumn("of", F.col("r")[0]["column"]).join(kept, ["a", "of"]).drop("of")
    events = singles.unionByName(found.where("kind <> 'single'"))
    similar = F.transform("r", lambda x, i: F.struct(i.alias("rank"), x["column"].alias("column"), (-x["o"]).alias("score")))
    differently = events.join(names.withColumnRenamed("name", "a"), "a").select(
        F.col("a").alias("column"), "files", F.col("right").alias("file_right"), F.col("right_idx").alias("file_right_idx"), "kind",
        similar.alias("similar"))
    several = F.element_at("files", -1)["file_idx"] > F.element_at("files", 1)["file_idx"]
    equal = names.where(several).select(
        F.col("name").alias("column"), "files", F.lit(None).cast("string").alias("file_right"),
        F.lit(None).cast("int").alias("file_right_idx"), F.lit("equal").alias("kind"),
        F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("column"), F.lit(100).alias("score"))).alias("similar"))
    return differently.unionByName(equal)


def expand_recommendations(factored: DataFrame) -> DataFrame:
    """Every recommendation of :func:`factored_recommendations`, numbered in
    emission order, one row per recommended column (files² rows for names that
    all files have): ``(rec_no, file_left, column, file_right, kind, rank,
    similar, score)``."""
    places = "array<struct<idx:int,at:int,file:string>>"
    one = F.array(F.struct("file_right_idx", F.lit(0).alias("at"), "file_right"))
    right = F.when(F.col("kind") == "equal", F.col("files").cast(places)).otherwise(one.cast(places))
    each = factored.select("column", "kind", "similar", F.explode("files").alias("left"), right.alias("rights"))
    each = each.select("column", "kind", "similar", "left", F.explode("rights").alias("right")).where(
        F.when(F.col("kind") == "equal", F.col("right.idx") < F.col("left.file_idx")).otherwise(F.col("right.idx") <= F.col("left.file_idx")))
    # emission order: left file descending, right file descending, column order, equal names last
    heads = each.select("column", "kind", "similar", "left", "right", F.col("left.file_idx").alias("k"), F.col("right.idx").alias("j"),
                        F.col("left.ordinal").alias("at"), (F.col("kind") == "equal").alias("e"), F.col("right.at").alias("at_j"))
    kept = _numbered(heads, [F.desc("k"), F.desc("j"), F.asc("at"), F.asc("e"), F.asc("at_j")], "rec_no")
    marked = F.when((F.col("k") == F.col("j")) | F.col("e"), F.concat("left.file", F.lit("_"))).otherwise(F.col("left.file"))
    return kept.select("rec_no", marked.alias("file_left"), "column", F.col("right.file").alias("file_right"), "kind",
                       F.explode("similar").alias("s")).select(
        "rec_no", "file_left", "column", "file_right", "kind", F.col("s.rank").alias("rank"), F.col("s.column").alias("similar"),
        F.col("s.score").alias("score"))


def name_recommendations(cat: DataFrame, threshold: int = RECOMMEND_THRESHOLD) -> DataFrame:
    """Recommendation rows in emission order, one row per recommended column.

    ``(rec_no, file_left, column, file_right, kind, rank, similar, score)``;
    kind ``single`` / ``multi`` (differently named similar columns of file j
    for a column of file k ≥ j, k = j included) or ``equal`` (same name in an
    earlier, different file).  A single match is dropped when the reversed
    name pair was emitted before; ``file_left`` gets ``_`` appended when k = j
    or for ``equal``.  Files are indexed by ``file_idx`` (ascending).  The
    expansion of :func:`factored_recommendations`, whose rows grow with the
    files and not with their pairs.
    """
    return expand_recommendations(factored_recommendations(cat, threshold))


def _numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0, 1, 2, … in the given order without one task seeing all rows: range
    partitions are numbered on their own, from starts that their counts give
    (one row a partition reaches the driver)."""
    ranged = reliable_checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts += [F.lit(part), F.lit(total)]
        total += n
    if not starts:
        return ranged.withColumn(out, F.lit(0).cast("bigint")).drop("__part")
    w = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn(out, (F.row_number().over(w) - 1 + F.create_map(*starts)[F.col("__part")]).cast("bigint")) \
                 .drop("__part")


def first_leaders(nodes: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(x, lead)``: which nodes the greedy walk makes leaders.

    ``nodes (x)``; ``earlier (x, e)``: e is a neighbour of x that comes before
    it.  A node leads if none of its earlier neighbours does: the
    lexicographic-first independent set.  Every round keeps only undecided nodes
    and, for each, what still has to hold, rows ``(x, e, s)``: e must not lead
    (s = 0), or must lead (s = 1).

    - A row whose e is decided goes, or covers x; a node without rows leads; one
      with both rows for an e is covered.
    - A node with a single row is its e or the opposite of it.  Rows that name
      such a node name its e instead, so chains halve with every round.
    """
    # the first round's decisions need no join: nodes without earlier neighbours lead
    has = earlier.select("x").distinct()
    known = written_table(nodes.join(has, "x", "left_anti").select("x", F.lit(True).alias("lead")), "leaders")
    left = written_table(earlier.select("x", "e", F.lit(0).alias("s")).distinct(), "leaders-left")
    decided = [known]
    while not left.isEmpty():
        seen = left.join(known.select(F.col("x").alias("e"), "lead"), "e", "left")
        holds = F.col("lead") == (F.col("s") == 1)
        state = written_table(seen.groupBy("x").agg(
            F.coalesce(F.bool_or(~holds), F.lit(False)).alias("covered"), F.count_if(F.col("lead").isNull()).alias("open"),
            F.count_distinct(F.when(F.col("lead").isNull(), F.col("e"))).alias("of"),
            F.min(F.when(F.col("lead").isNull(), F.struct("e", "s"))).alias("one")), "leaders-state")
        covered = F.col("covered") | (F.col("of") < F.col("open"))
        known = state.where(covered | (F.col("open") == 0)).select("x", (~covered).alias("lead"))
        decided.append(known)
        undecided = state.where(~covered & (F.col("open") > 0))
        alias = undecided.where("open = 1").select(F.col("x").alias("e"), F.col("one.e").alias("f"), F.col("one.s").alias("u"))
        rest = seen.where("lead is null").select("x", "e", "s").join(undecided.select("x"), "x").join(alias, "e", "left")
        left = written_table(rest.select(
            "x", F.coalesce("f", "e").alias("e"), F.when(F.col("f").isNull(), F.col("s")).otherwise(1 - F.col("s").bitwiseXOR(F.col("u")))
            .cast("int").alias("s")).distinct(), "leaders-left")
    out = decided[0]
    for k in decided[1:]:
        out = out.unionByName(k)
    return out


def similar_name_groups(cat: DataFrame, threshold: int = GROUP_THRESHOLD) -> DataFrame:
    """Greedy groups of similar names, decided by rounds (no sequential loop).

    Names in catalogue order ``(file_idx, ordinal)``.  Walking that order, a
    name not yet used leads a group of every differently named similar entry
    (score desc, then order) plus itself, and all of them become used; the
    leaders come from :func:`first_leaders`.  Returns ``(leader, member_rank,
    member)``, leader last.
    """
    pos = cat.select("column_name", (F.shiftleft(F.col("file_idx").cast("bigint"), 32)
                                     + F.col("ordinal")).alias("pos"))
    first = reliable_checkpoint(pos.groupBy("column_name").agg(F.min("pos").alias("pos")))
    both = similar_names(first.select(F.col("column_name").alias("name")), threshold)
    at = lambda c: first.select(F.col("column_name").alias(c), F.col("pos").alias(f"p{c}"))
    both = reliable_checkpoint(both.join(at("a"), "a").join(at("b"), "b"))
    earlier = both.where("pb < pa").select(F.col("a").alias("x"), F.col("b").alias("e"))
    status = first_leaders(both.select(F.col("a").alias("x")).distinct(), earlier)
    leaders = status.where("lead").select(F.col("x").alias("leader"))
    # members: every catalogue entry whose name is similar to the leader
    sim = both.select(F.col("a").alias("leader"), F.col("b").alias("member_name"), "score")
    members = (leaders.join(sim, "leader")
                      .join(pos.withColumnRenamed("column_name", "member_name"), "member_name"))
    w = Window.partitionBy("leader").orderBy(F.desc("score"), "pos")
    ranked = members.withColumn("member_rank", (F.row_number().over(w) - 1).cast("int"))
    last = ranked.groupBy("leader").agg(F.count(F.lit(1)).cast("int").alias("member_rank")) \
                 .withColumn("member", F.col("leader"))
    return ranked.select("leader", "member_rank", F.col("member_name").alias("member")) \
                 .unionByName(last.select("leader", "member_rank", "member"))


def recommendations_dict(recs: DataFrame) -> dict[str, dict]:
    """The reference's response shape: ``{"Recommendation<n>": {left_file: column,
    right_file: [similar, …]}}`` (collected: one row per recommended column
    pair, bounded by the schema)."""
    out: dict[str, dict] = {}
    for r in recs.orderBy("rec_no", "rank").collect():
        rec = out.setdefault(f"Recommendation{r.rec_no}", {})
        rec[r.file_left] = r.column
        rec.setdefault(r.file_right, []).append(r.similar)
    return out


def groups_dict(groups: DataFrame) -> dict[str, list[str]]:
    """``{leader: [members…, leader]}`` (collected; bounded by the column list)."""
    out: dict[str, list[str]] = {}
    for r in groups.orderBy("leader", "member_rank").collect():
        out.setdefault(r.leader, []).append(r.member)
    return out
