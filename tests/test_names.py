"""Name matching against plain-Python brute force written from the semantics."""

import random
import re

import pytest

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from confluo.functions.fuzzy import name_key, name_ratio
from confluo.operators.names import name_pairs, name_recommendations, similar_name_groups
from confluo.sources.catalogue import catalogue_from_names, header_catalogue


def key(s):
    s = "".join(ch for ch in s if not 0x80 <= ord(ch) <= 0xFF)
    s = re.sub(r"[^\w]", " ", s).lower().strip()
    return " ".join(sorted(s.split()))


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def score(x, y):
    a, b = key(x), key(y)
    if a == b:
        return 100
    if not a or not b:
        return 0
    return int(round(100 * (2 * lcs(a, b) / (len(a) + len(b)))))


def ranked(name, choices, t):
    """choices as (pos, name); score desc, ties in choice order."""
    sc = [(score(name, c), i, c) for i, c in choices]
    sc.sort(key=lambda z: (-z[0], z[1]))
    return [(c, s) for s, _, c in sc if s >= t]


def recs_brute(files, t=90):
    """The emission-ordered recommendation loop, as SURVEY §2.7 G8 describes it."""
    names = sorted(files)
    out, seen, n = [], set(), 0
    for k in range(len(names) - 1, -1, -1):
        for j in range(k, -1, -1):
            fk, fj = names[k], names[j]
            for col in files[fk]:
                hits = ranked(col, list(enumerate(files[fj])), t)
                similar = [c for c, _ in hits if c != col]
                if similar:
                    if len(similar) > 1 or (similar[0], col) not in seen:
                        if len(similar) == 1:
                            seen.add((col, similar[0]))
                        left = fk + "_" if k == j else fk
                        kind = "single" if len(similar) == 1 else "multi"
                        out += [(n, left, col, fj, kind, r, s) for r, s in enumerate(similar)]
                        n += 1
                if k != j and any(c == col for c, _ in hits):
                    out.append((n, fk + "_", col, fj, "equal", 0, col))
                    n += 1
    return out


def groups_brute(columns, t=80):
    """Greedy grouping, written as a fold over the names: the state is the set
    of names already placed and the groups found so far."""
    def step(state, name):
        placed, found = state
        if name in placed:
            return state
        sim = [c for c, _ in ranked(name, list(enumerate(columns)), t) if c != name]
        if not sim:
            return state
        members = sim + [name]
        return placed | set(members), found + [(name, r, m) for r, m in enumerate(members)]
    from functools import reduce
    return reduce(step, columns, (frozenset(), []))[1]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcAB_ -é1", max_size=12), st.text(alphabet="abcAB_ -é1", max_size=12))
def test_ratio_matches_brute_force_and_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        name_key(F.col("a")).alias("ka"), name_key(F.col("b")).alias("kb"))
    r = df.select(name_ratio("ka", "kb").alias("s"), name_ratio("kb", "ka").alias("t"), "ka").collect()[0]
    assert r.ka == key(a)
    assert r.s == r.t == score(a, b)
    assert 0 <= r.s <= 100


WORDS = ["order", "date", "id", "cust", "name", "total", "price", "qty", "amount", "code", "key"]


def _random_files(rnd, n_files=4):
    files = {}
    for f in range(n_files):
        cols = []
        for _ in range(rnd.randint(2, 7)):
            w = rnd.sample(WORDS, rnd.randint(1, 2))
            c = rnd.choice(["_", " ", ""]).join(w)
            if rnd.random() < 0.3:
                c = c[:-1] if len(c) > 3 else c + "s"
            if c not in cols:
                cols.append(c)
        files[f"file{f}.csv"] = cols
    return files


def test_pairs_match_all_pairs_brute_force(spark):
    rnd = random.Random(11)
    files = _random_files(rnd, 5)
    cat = header_catalogue(spark, {f: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols))
                                   for f, cols in files.items()})
    entries = [(f, i + 1, c) for f in sorted(files) for i, c in enumerate(files[f])]
    want = set()
    for x in range(len(entries)):
        for y in range(x + 1, len(entries)):
            s = score(entries[x][2], entries[y][2])
            if s >= 80:
                want.add((entries[x][0], entries[x][2], entries[y][0], entries[y][2], s))
    got = {(r.file_l, r.column_l, r.file_r, r.column_r, r.score) for r in name_pairs(cat, 80).collect()}
    assert got == want


def test_recommendations_match_sequential_loop(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        files = _random_files(rnd, 4)
        cat = header_catalogue(spark, {f: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols))
                                       for f, cols in files.items()})
        for t in (80, 90):
            got = sorted(tuple(r) for r in name_recommendations(cat, t)
                         .select("rec_no", "file_left", "column", "file_right", "kind", "rank", "similar").collect())
            assert got == sorted(recs_brute(files, t)), (seed, t)


def test_groups_match_greedy_loop(spark):
    for seed in range(5):
        rnd = random.Random(100 + seed)
        cols = [c for f in _random_files(rnd, 3).values() for c in f]
        cat = catalogue_from_names(spark, cols)
        got = sorted(tuple(r) for r in similar_name_groups(cat, 80).collect())
        assert got == sorted(groups_brute(cols, 80)), seed


def test_few_candidates_among_many_names(spark):
    from confluo.functions.fuzzy import name_key
    from confluo.operators.names import candidate_keys
    from pyspark.sql import functions as F
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(50)]
    names = sorted({f"{a}_{b}" for a in words for b in words if a != b})
    keys = spark.createDataFrame([(n,) for n in names], "n string").select(name_key(F.col("n")).alias("key")) \
        .distinct().withColumn("klen", F.length("key"))
    n = keys.count()
    assert n > 2000
    for t in (80, 90):
        assert candidate_keys(keys, (t - 0.5) / 100).count() < 0.05 * n * (n - 1) / 2


def test_equal_names_are_one_row(spark):
    from confluo.operators.names import equal_names
    cat = header_catalogue(spark, {f"f{i}": spark.createDataFrame([], "id string, x%d string" % i) for i in range(5)})
    assert [(r.column_name, r.files) for r in equal_names(cat).collect()] == [("id", [f"f{i}" for i in range(5)])]


def test_reference_shapes(spark):
    from confluo.operators.names import groups_dict, recommendations_dict
    files = {"a.csv": ["order date", "qty"], "b.csv": ["date order", "qty", "quantity"]}
    cat = header_catalogue(spark, {f: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols))
                                   for f, cols in files.items()})
    d = recommendations_dict(name_recommendations(cat, 90))
    assert d == {"Recommendation0": {"b.csv": "date order", "a.csv": ["order date"]},
                 "Recommendation1": {"b.csv_": "qty", "a.csv": ["qty"]}}
    g = groups_dict(similar_name_groups(catalogue_from_names(spark, ["order date", "date order", "qty"]), 80))
    assert g == {"order date": ["date order", "order date"]}


def test_recommendations_of_many_files_stay_factored(spark):
    """A name that all files have is one row, however many files there are."""
    from confluo.operators.names import expand_recommendations, factored_recommendations
    cat = spark.createDataFrame([(f"f{i:03d}", i, j + 1, c) for i in range(60)
                                 for j, c in enumerate(["customer_id", "customer_ids" if i % 7 == 3 else f"x{i}y", "amount"])],
                                "file string, file_idx int, ordinal int, column_name string")
    rows = factored_recommendations(cat, 90)
    got = rows.collect()
    equal = {r.column: len(r.files) for r in got if r.kind == "equal"}
    assert equal == {"customer_id": 60, "amount": 60, "customer_ids": 9}
    assert len(got) < 60 * 3
    assert expand_recommendations(rows).where("kind = 'equal'").count() == 2 * 60 * 59 // 2 + 9 * 8 // 2


def _greedy(nodes, earlier):
    lead = {}
    for x in sorted(nodes):
        lead[x] = not any(lead[e] for e in earlier.get(x, ()))
    return lead


def test_leaders_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from confluo.operators import names
    n, rounds, keep = 10_000, [], names.written_table
    monkeypatch.setattr(names, "written_table", lambda df, name: rounds.append(1) or keep(df, name))
    nodes, earlier = spark.range(n).toDF("x"), spark.range(1, n).selectExpr("id as x", "id - 1 as e")
    got = {r.x: r.lead for r in names.first_leaders(nodes, earlier).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}
    assert len(rounds) <= 2 + 2 * 16  # two written tables a round, log2 of the chain


@pytest.mark.parametrize("seed, degree", [(1, 1), (2, 3), (3, 8)])
def test_leaders_of_random_graphs(spark, seed, degree):
    from confluo.operators.names import first_leaders
    rnd = random.Random(seed)
    earlier = {x: {rnd.randrange(max(0, x - 12), x) for _ in range(rnd.randrange(degree + 1))} for x in range(1, 120)}
    rows = [(x, e) for x, es in earlier.items() for e in es]
    got = first_leaders(spark.range(120).toDF("x"), spark.createDataFrame(rows, "x long, e long"))
    assert {r.x: r.lead for r in got.collect()} == _greedy(range(120), earlier)


def test_no_edges_and_no_nodes(spark):
    from confluo.operators.names import first_leaders
    none = spark.createDataFrame([], "x long, e long")
    assert first_leaders(spark.range(3).toDF("x"), none).where("lead").count() == 3
    assert first_leaders(spark.range(0).toDF("x"), none).count() == 0
