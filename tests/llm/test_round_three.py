"""Merkle manifest, spelling variants and fingerprints against brute force, and on awkward tables."""

import random

import brute
import llm_fixtures as FIX
import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from confluo.llm import variants as V
from confluo.llm.fingerprints import as_text, edited_neighbours, fingerprints, likeness, sample_key, weighted_samples, with_next
from confluo.llm.merkle import fold, leaf_digest, merkle_proofs, path_digest
from confluo.llm.queries import QUERIES

LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def leaves(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def proved(df, **how):
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))) \
        .otherwise(F.col("text"))
    out = merkle_proofs(df, columns=LEAF, carry={"shown": leaf_digest([shown if c == "text" else F.col(c) for c in LEAF])}, **how)
    out = out.withColumn("folded", fold(F.col("shown"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")), "folded", F.col("folded") == F.col("root"))


def by_id(df):
    rows = df.collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "z", "single"]
    return [(i * 3 - n, sources[6] if i == 5 else "hot" if i % 3 == 0 else rng.choice(sources[:6]), rng.choice([None, "en", "é"]),
             rng.choice([None, i]), rng.choice([None, "", "x\ny\n", f"text {i} é\n", f"plain {i}"])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 28, 300])
def test_merkle_proofs_match_brute_force(spark, n):
    rows = corpus(n)
    assert by_id(proved(leaves(spark, rows))) == brute.merkle(rows)


@pytest.mark.parametrize("fan, every", [(2, 1), (2, 4), (5, 2)])
def test_merkle_trees_of_other_widths(spark, fan, every):
    rows = corpus(90, 2)
    assert by_id(proved(leaves(spark, rows), fan=fan, every=every)) == brute.merkle(rows, fan)


def test_merkle_with_awkward_rows(spark):
    """Null ids, one id with several texts, whole rows repeated, extra columns of the names used inside."""
    rows = [(None, None, None, None, None), (1, "s", "en", 1, "a"), (1, "s", "en", 1, "b"), *[(2, "s", "en", 1, "same\n")] * 40]
    df = leaves(spark, rows)
    for c in ("tree", "place", "size", "digest", "carried", "path", "copies", "group", "root", "leaf", "t", "r"):
        df = df.withColumn(c, F.lit("clash"))
    got = merkle_proofs(df, columns=LEAF).collect()
    assert len(got) == len(rows)
    checked = merkle_proofs(df, columns=LEAF).where(fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert checked.count() == len(rows) and len({r.root for r in got}) == 1
    # forty equal leaves take forty places
    assert merkle_proofs(df, columns=LEAF).where("doc_id = 2").select("path").distinct().count() == 40
    assert merkle_proofs(df.limit(0), columns=LEAF).count() == 0


def test_merkle_stores_every_third_level_only(spark, monkeypatch):
    import confluo.llm.merkle as M
    names, keep = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: names.append(name) or keep(df, name))
    rows = [(i, "s", None, None, None) for i in range(800)]
    assert by_id(proved(leaves(spark, rows))) == brute.merkle(rows)
    assert [n for n in names if n.startswith("merkle-level")] == ["merkle-level-1", "merkle-level-2", "merkle-level-3"]  # 800, 30, 2, 1


def words_corpus(seed=4):
    rng = random.Random(seed)
    base = ["harbour", "harbor", "harbours", "colour", "color", "colours", "naïveté", "naivete", "Été×÷ÿÀÖ", "aaaaaaa", "aaaaaaaa", "aaaaaab"]
    base += ["".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 8]))) for _ in range(60)]
    weight = [5 ** rng.randrange(0, 4) for _ in base]
    rows = [(i, " ".join(rng.choices(base, weight, k=120)) + rng.choice([" ", "\n", ", x1y ", "Aaaaaaa-"])) for i in range(60)]
    rows.append((59, " ".join(["chainsab"] * 5 + ["chainsa"] * 30 + ["chains"] * 200 + ["chaixs"] * 6 + ["bchains"] * 200)))
    return rows + [(60, None), (61, ""), (None, "harbour harbour"), (62, "Ab" * 400), (62, "Ab" * 400)]


def variant_rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("damage", [None, 199, 7])
def test_variants_match_brute_force(spark, damage):
    rows = words_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = variant_rows(V.spelling_variants(df, damage=damage))
    assert got == brute.variants(rows, damage=damage)
    assert sum(v[2] is not None for v in got.values()) > 3 and any(v[4] != (v[2] or k) for k, v in got.items())
    assert damage or (got["chainsab"][2:] == ("chainsa", 30, "chains") and got["chains"][1:3] == (3, None))


def test_variants_do_not_depend_on_the_filter(spark):
    """A filter of a few bytes lets everything through; the exact join decides."""
    rows = words_corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.variants(rows, 6, 1, 2, None)
    for size in (64, 64 << 20):
        assert variant_rows(V.spelling_variants(df, least_count=1, ratio=2, most_filter_bytes=size)) == want


def test_variants_of_very_long_words(spark):
    long = "a" + "bc" * 200
    rows = [(1, " ".join([long] * 10)), (2, f"{long}d {long[:100]}z{long[100:]} {long[:100]}z{long[101:]}")]
    got = variant_rows(V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1))
    assert got == brute.variants(rows, 6, 1, 5, None) and got[long][1] == 3


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert V.spelling_variants(df).count() == 0
    assert V.spelling_variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 0


def test_the_filter_holds_all_words_and_few_others():
    rng = np.random.default_rng(3)
    words = rng.choice(V.ALPHABET, (20_000, 7))
    hashes = V.mix(np.cumsum(V.BYTE_VALUES[words] * V.powers(7)[0][:7], axis=1, dtype=np.uint64)[:, -1])
    half, filled = hashes[:10_000], np.zeros((625, 8), np.uint32)
    block = ((half >> np.uint64(32)) * np.uint64(625) >> np.uint64(32)).astype(int)
    for lane in range(8):
        np.bitwise_or.at(filled[:, lane], block, np.uint32(1) << V._lanes(half)[:, lane])
    assert len(V._present(half, filled, (0, 625))) == 10_000
    assert len(V._present(hashes[10_000:], filled, (0, 625))) < 100  # 16 bits a word: under 1 %


def test_fingerprints_are_consistent_weighted_samples(spark):
    rows = FIX.plain()
    got = by_id(weighted_samples(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], "text", 8))
    terms = [(i, term, n, keys) for i, t in rows for term, n, keys in brute.sample_keys(t, 8)]
    df = spark.createDataFrame(terms, "i long, term long, n long, want array<double>")
    keys = df.select("i", "want", F.array(*[sample_key(F.col("term"), F.col("n"), F.lit(k)) for k in range(8)]).alias("got"))
    assert np.allclose(*zip(*[(r.want, r.got) for r in keys.collect()], strict=True), rtol=1e-9, atol=0)
    # a place holds the hash of the smallest key
    least = keys.groupBy("i").agg(*[F.xxhash64(F.min(F.col("got")[k])).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(8)])
    want = {r[0]: (list(r[1:]),) for r in least.collect()}
    assert got == {i: want.get(i, ([0] * 8,)) for i, _ in rows}


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for keep in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        for _ in range(4):
            a = rng.choices(words, k=250)
            texts.append((" ".join(a), " ".join(w if rng.random() < keep else rng.choice(words) for w in a)))
    rows = [(i, s, t) for i, pair in enumerate(texts) for s, t in enumerate(pair)]
    got = {(r.i, r.s): r.samples for r in weighted_samples(
        spark.createDataFrame(rows, "i int, s int, t string"), ["i", "s"], "t", 256).collect()}
    for i, (a, b) in enumerate(texts):
        share = np.mean([x == y for x, y in zip(got[i, 0], got[i, 1], strict=True)])
        assert abs(share - brute.generalised_jaccard(a, b)) < 4.5 * 0.5 / 16


def test_edited_neighbours_match_brute_force(spark):
    rows = [*FIX.plain(), (None, "of the null id")]
    df = FIX.documents(spark, [(i, t, None) for i, t in rows]).withColumn("bucket", F.lit("clash")).withColumn("samples", F.lit("clash"))
    want = brute.edits(rows)
    got = by_id(edited_neighbours(df).select("doc_id", "n_chars", "edited_sha256", as_text(F.col("samples")),
                                             as_text(F.col("edited_samples")), "near_edited", "near_next"))
    texts = dict(rows)
    assert {i: g[:2] for i, g in got.items()} == {i: (n, brute.digest(e)) for i, (n, e, _) in want.items()}
    for i, (_, e, j) in want.items():
        assert abs(got[i][4] - brute.generalised_jaccard(texts[i], e)) < 0.32
        assert got[i][5] == np.mean([got[i][2][8 * k:8 * k + 8] == got[j][2][8 * k:8 * k + 8] for k in range(64)])
    known = by_id(fingerprints(df).select("doc_id", as_text(F.col("samples"))))
    assert known == {i: (g[2],) for i, g in got.items()}


@pytest.mark.parametrize("bucket_rows, task_rows", [(1, 1), (3, 10), (1000, 1000)])
def test_next_texts_whatever_the_buckets(spark, bucket_rows, task_rows):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-500, 500), 150)) + [10 ** 12, -10 ** 12, 10 ** 12 + 1]
    rows = [(i, f"text of {i}") for i in ids] + [(None, "null")]
    got = with_next(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=bucket_rows, task_rows=task_rows, most_cuts=20)
    texts, want = dict(rows), brute.edits(rows)
    assert {r.id: r.next_text for r in got.where("extra = 0").collect()} == {i: texts[j] for i, (_, _, j) in want.items()}


def test_next_texts_of_repeated_ids(spark):
    """An id of a third of all rows is dealt to several buckets; every row keeps one follower."""
    rows = [(i, f"t{i}") for i in range(200)] + [(77, f"other {k}") for k in range(100)] + [(5, "same")] * 30 + [(None, f"n{k}") for k in range(20)]
    out = with_next(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=10, most_cuts=30).where("extra = 0")
    got = out.collect()
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    assert len({r.bucket for r in got if r.id == 77}) > 3
    order = [r.id for r in sorted(got, key=lambda r: (r.bucket, r.number))]
    assert order == sorted(order, key=lambda i: (i is None, -(i or 0)))


def test_fingerprints_of_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert edited_neighbours(empty).count() == 0 and fingerprints(empty).count() == 0
    one = edited_neighbours(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert (one.near_next, one.n_chars, one.edited_sha256) == (1.0, 5, brute.digest("a b a"))
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    assert edited_neighbours(twice).count() == 3


def test_likeness_is_the_share_of_places(spark):
    row = spark.range(1).select(likeness(F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (1, 0, 3, 5)))).alias("x")).first()
    assert row.x == 0.5


def test_queries_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*LEAF).collect()]
    texts = [(r[0], r[4]) for r in rows]
    out = QUERIES["op11_merkle"](spark, SF_SMALL)
    assert by_id(out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) == brute.merkle(rows)
    assert variant_rows(QUERIES["op12_variants"](spark, SF_SMALL)) == brute.variants(texts)
    got = by_id(QUERIES["op13_fingerprints"](spark, SF_SMALL).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    want = brute.edits(texts)
    assert {i: g[:2] for i, g in got.items()} == {i: (n, brute.digest(e)) for i, (n, e, _) in want.items()}
    seen = {}
    for i, t in texts:
        assert seen.setdefault(t or "", got[i][2]) == got[i][2]
    error = [got[i][4] - brute.generalised_jaccard(dict(texts)[i], want[i][1]) for i in got]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.09
