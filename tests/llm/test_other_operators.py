"""Mixing, toxicity, passages, the pipeline, and awkward tables for all operators."""

import collections
import itertools
import random

import brute
import llm_fixtures as FIX
import numpy as np
import pytest
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from confluo.llm import toxicity
from confluo.llm.decontaminate import contamination, decontaminated
from confluo.llm.exact_dedup import exact_dedup
from confluo.llm.licenses import scan_licenses
from confluo.llm.mixing import mix_sources, mixed, schedule, whole_shares
from confluo.llm.ngram_join import jaccard_components, without_near_copies
from confluo.llm.passages import align, compact_windows, near_duplicate_passages
from confluo.llm.pii import find_pii
from confluo.llm.sharding import shard_rows
from confluo.llm.suffix_dedup import suffix_dedup


@pytest.fixture()
def empty(spark):
    return FIX.documents(spark, [])


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 2 / 3}, dict.fromkeys("abcdefghijklmnopqrst", 1.0),
                                     {"a": 0.35004, "b": 0.0002, "c": 0.64976}, {"a": 1e-9, "b": 0.1, "c": 1e6}])
def test_schedule_deviates_by_less_than_one_block(weights):
    total, served = sum(weights.values()), dict.fromkeys(weights, 0)
    sources = [(s, n, 1 << 40) for s, n in whole_shares(weights).items()]
    for t, (s, k, release, deadline, slot) in enumerate(itertools.islice(schedule(sources), 40_000), 1):
        assert (slot, k) == (t - 1, served[s]) and release <= slot < deadline
        served[s] += 1
        assert all(abs(served[x] - w * t / total) < 1 for x, w in weights.items())


def test_schedule_serves_every_block_once():
    out = list(schedule([("a", 1, 1000), ("b", 2, 7), ("c", 3, 90), ("d", 1, 0)]))
    assert [x[4] for x in out] == list(range(1097)) and all(r <= t < d for _, _, r, d, t in out)
    for s, n in (("a", 1000), ("b", 7), ("c", 90), ("d", 0)):
        assert [k for x, k, *_ in out if x == s] == list(range(n))


def test_mix_keeps_a_small_source_to_its_weight(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "if(id < 200, 's', if(id < 15000, 'a', 'b')) as source")
    weights = {"a": 0.35004, "b": 0.6497, "s": 0.0002}
    # the returned weight holds at every prefix, the first block of the small source included
    out = mix_sources(df, weights, block_rows=1).where("source = 's' and block < 5").collect()
    weight = out[0].weight
    assert weight == pytest.approx(0.0002, rel=1e-3)
    first_end = 14_800 / 0.35004
    for r in out:
        if r.slot < first_end - 2:
            assert abs(r.block + 1 - weight * (r.slot + 1)) < 1 and abs(r.block - weight * r.slot) < 1


def test_mix_places_every_row_and_follows_the_weights(spark):
    rows = [(i, "t", "big" if i % 3 else "mid" if i % 2 else "low") for i in range(3000)]
    weights = {"big": 0.2, "mid": 0.3, "low": 0.5}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, weights, block_rows=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    assert {r.doc_id: r.source for r in out} == {i: s for i, _, s in rows}
    at = {}
    for r in out:
        assert at.setdefault(r.slot, r.source) == r.source and r.release <= r.slot < r.deadline
    assert sorted(at) == list(range(len(at)))
    ends = min(max(s for s, x in at.items() if x == name) for name in weights)
    served = collections.Counter()
    for t in range(ends // 100 * 100):
        served[at[t]] += 1
        assert all(abs(served[x] - w * (t + 1)) < 1 for x, w in weights.items())
    with pytest.raises(ValueError):
        mix_sources(df, {"big": 1.0})


def test_mixed_keeps_rows_and_columns(spark):
    df = FIX.hard(spark)
    out = mixed(df, block_rows=4)
    assert out.columns == df.columns
    assert collections.Counter(map(str, out.collect())) == collections.Counter(map(str, df.collect()))


def test_non_negative_risk_finds_the_marker():
    rng = np.random.default_rng(0)
    # confirmed toxic texts, and unlabelled ones of which a fifth is toxic
    positive = np.arange(1900) < 400
    toxic = positive | (rng.random(1900) < 0.2)
    words = [rng.choice(200, 30, replace=False) + 1 for _ in range(1900)]
    words = [np.append(w, 0) if t else w for w, t in zip(words, toxic, strict=True)]
    w, bias = toxicity.train(words, positive, 0.2, 201)
    score = np.array([bias + w[x].sum() for x in words])
    assert ((score > 0) == toxic)[400:].mean() > 0.97 and np.argmax(w) == 0


def test_held_out_toxicity(spark):
    from confluo.llm.queries import op4_toxicity
    sf = "/root/testdata/sf0.1"
    out = op4_toxicity(spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = out.join(truth, "doc_id").where("held_out").agg(
        F.expr("count_if(predicted = 1 and toxic = 1)").alias("tp"),
        F.expr("count_if(predicted = 1)").alias("p"), F.expr("count_if(toxic = 1)").alias("t")).first()
    assert r.tp / r.p > 0.95 and r.tp / r.t > 0.75  # a tenth of what a cluster run learns from


def toxic_texts(n=300, share=0.2, seed=3):
    """(doc_id, text, toxic): toxic texts hold some of ten telling words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(150)}" for _ in range(30)]
        toxic = rng.random() < share
        rows.append((i, " ".join(words + [f"bad{rng.randrange(4)}" for _ in range(3 * toxic)]), int(toxic)))
    return rows


def scores(df, weights):
    return {r.doc_id: r.s for r in df.select("doc_id", toxicity.score(weights, F.col("text")).alias("s")).collect()}


NO_LESSON = {"none": [], "null": [(None, 1), (1, None)], "absent ids": [(i, i % 2) for i in range(10_000, 10_020)],
             "negative only": [(i, 0) for i in range(20)], "absent positives": [(i, 0) for i in range(20)] + [(20_000, 1)]}


@pytest.mark.parametrize("labels", NO_LESSON)
def test_labels_that_teach_nothing_leave_every_text_clean(spark, labels):
    df = FIX.documents(spark, [(i, t, None) for i, t, _ in toxic_texts(40)])
    weights = toxicity.fit(df, spark.createDataFrame(NO_LESSON[labels], "doc_id long, toxic int"))
    assert weights == toxicity.NOTHING and max(scores(df, weights).values()) < 1e-9


def test_all_rows_confirmed_leave_nothing_to_tell_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert toxicity.fit(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) == toxicity.NOTHING


@pytest.mark.parametrize("kind", ["both kinds", "positive only"])
def test_toxicity_from_labels_of_both_kinds_and_of_one(spark, kind):
    rows = toxic_texts(900)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = [(i, y) for i, _, y in rows if i % 2 and (y or kind == "both kinds")]
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    got = scores(df, toxicity.fit(df, labels, prior=None if kind == "both kinds" else 0.2))
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 2 == 0]
    assert np.mean(right) > 0.97


def test_toxicity_of_awkward_rows(spark):
    """Nulls in every column, repeated rows and labels, empty and very long texts, clashing names."""
    rows = [(i, t, None) for i, t, _ in toxic_texts(400)] + [(None, None, None), (None, "bad1 bad2", None), (1000, None, None),
            (1001, "", None), (1002, "bad1 " * 300_000 + "bad2 bad3", None), (1003, "w1 " * 400_000, None)]
    df = FIX.documents(spark, rows + rows[:50])
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_texts(400) for _ in range(2)] + [(None, 1), (3, None)],
                                   "doc_id long, toxic int")
    weights = toxicity.fit(df, labels)
    out = df.select("doc_id", "text", toxicity.score(weights, F.col("text")).alias("s")).collect()
    assert len(out) == len(rows) + 50 and all(0 <= r.s <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text or "", r.s) == r.s  # equal texts, null and empty ones too, score alike
    # a word counts once, however often it stands
    assert by_text["bad1 " * 300_000 + "bad2 bad3"] == by_text.get("bad1 bad2 bad3", by_text["bad1 " * 300_000 + "bad2 bad3"]) >= 0.5
    assert by_text["w1 " * 400_000] < 0.5 and by_text[""] < 0.5
    assert df.limit(0).select(toxicity.score(weights, F.col("text"))).count() == 0


@pytest.mark.parametrize("shared", [40, 50])
def test_passages_of_templates_with_one_opening(spark, shared):
    """Every later copy is reported with an earlier copy of its own template."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    opening = [word() for _ in range(shared)]
    templates = [opening + [word() for _ in range(60 - shared)] for _ in range(5)]
    kinds = [k for k in range(5) for _ in range(12)]
    rng.shuffle(kinds)
    rows, at = [], []
    for i, k in enumerate(kinds):
        w = [word() for _ in range(rng.randrange(50, 150))]
        at.append(rng.randrange(len(w)))
        w[at[i]:at[i]] = templates[k]
        rows.append((i, " ".join(w)))
    out = near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string"), least_words=48).collect()
    whole = {r.doc_id for r in out if kinds[r.doc_id] == kinds[r.other_id]
             and r.first_word <= at[r.doc_id] and r.last_word >= at[r.doc_id] + 59}
    assert whole == {i for i in range(60) if kinds[i] in kinds[:i]}


def test_compact_windows_partition_the_passages():
    """Each passage of enough n-grams lies in exactly one window of an order."""
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 40, 90).astype(np.uint64)
    ends = np.array([0, 30, 30, 90])
    first, centre, last = compact_windows(grams, ends, 0, 6)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        for i in range(a, b):
            for j in range(i + 5, b):
                assert ((first <= i) & (i <= centre) & (centre <= j) & (j <= last)).sum() == 1


def test_align_cuts_away_chance_matches():
    x = np.arange(1000, 1300, dtype=np.int64)
    y = np.arange(5000, 5300, dtype=np.int64)
    x[100:180] = y[40:120] = np.arange(80)
    x[10], y[290] = 7777, 7777
    assert [r[:4] for r in align(x, y, 46, 0.8)] == [(100, 179, 40, 119)]


@pytest.mark.parametrize("in_x, in_y", [(20, None), (None, 10), (20, 10)])
def test_align_keeps_a_passage_whose_phrase_also_stands_before_it(in_x, in_y):
    for repeated in range(47):
        x, y = np.arange(1000, 1200, dtype=np.int64), np.arange(5000, 5200, dtype=np.int64)
        x[100:147] = y[60:107] = np.arange(47)
        for z, place in ((x, in_x), (y, in_y)):
            if place is not None:
                z[place] = repeated
        assert [r[:4] for r in align(x, y, 44, 0.8)] == [(100, 146, 60, 106)]


def test_align_finds_every_place_of_a_passage():
    x, y = np.arange(1000, 1300, dtype=np.int64), np.arange(5000, 5300, dtype=np.int64)
    x[120:167] = y[60:107] = y[190:237] = np.arange(47)
    assert sorted(r[:4] for r in align(x, y, 44, 0.8)) == [(120, 166, 60, 106), (120, 166, 190, 236)]
    assert [r[:4] for r in align(x[:80] * 0, y[:80] * 0, 44, 0.8)] == [(0, 79, 0, 79)]


def test_passages_finds_repeats_in_all_documents(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, other = [word() for _ in range(80)], [word() for _ in range(60)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(20, 120))]
        k = rng.randrange(len(w))
        if i % 3 == 0:
            p = list(passage)
            if i % 2:  # near: some words differ
                p[rng.randrange(80)] = word()
            w[k:k] = p
        elif i % 3 == 1 and i < 30:
            w[k:k] = other
        rows.append((i, " ".join(w)))
    out = near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {r.doc_id for r in out} | {r.other_id for r in out}
    assert linked == {i for i in range(60) if i % 3 == 0} | {i for i in range(30) if i % 3 == 1}
    text = dict(rows)
    for r in out:
        assert r.last_word - r.first_word + 1 >= 50 and r.jaccard >= 0.8 and r.other_id < r.doc_id
        a = text[r.doc_id].split()[r.first_word:r.last_word + 1]
        b = text[r.other_id].split()[r.other_first:r.other_last + 1]
        g = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        assert len(g(a) & g(b)) / len(g(a) | g(b)) == pytest.approx(r.jaccard)


BENCH = [(1, "same"), (None, "x"), (2, None)]
ALL = {
    "sharding": lambda df, b: shard_rows(df, 8), "licenses": lambda df, b: scan_licenses(df),
    "mixing": lambda df, b: mix_sources(df, block_rows=4), "join": lambda df, b: jaccard_components(df),
    "exact": lambda df, b: exact_dedup(df), "suffix": lambda df, b: suffix_dedup(df), "pii": lambda df, b: find_pii(df),
    "contamination": lambda df, b: contamination(df, b), "passages": lambda df, b: near_duplicate_passages(df),
    "near": lambda df, b: without_near_copies(df), "decontaminated": lambda df, b: decontaminated(df, b),
}


@pytest.mark.parametrize("name", ALL)
def test_awkward_and_empty_tables(spark, name, empty):
    df, bench = FIX.hard(spark), spark.createDataFrame(BENCH, "item_id long, text string")
    out = ALL[name](df, bench).collect()
    if name not in ("passages", "near", "decontaminated"):
        assert len(out) == df.count()
    assert ALL[name](empty, bench).count() == 0


def test_repeated_rows_have_defined_results(spark):
    df = FIX.hard(spark)
    exact = [r for r in exact_dedup(df).collect() if r.doc_id == 500]
    assert sorted(r.kept for r in exact) == [False, True, True]  # "same" twice, the other text once
    near = without_near_copies(df).where("doc_id = 500").collect()
    assert len(near) == 1
    cut = {r.doc_id: r.n_removed for r in suffix_dedup(df).collect()}
    assert cut[500] == 0
    shards = [r.shard for r in shard_rows(df, 8).collect() if r.doc_id == 500]
    assert len(set(shards)) == 1


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.dtypes == docs.dtypes
        docs = out


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path_factory):
    """Clashing columns, nulls and repeated rows go through every stage; no rows give no rows."""
    for name, df in (("hard", FIX.hard(spark)), ("empty", FIX.documents(spark, []))):
        sf = str(tmp_path_factory.mktemp(name))
        df.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(10, 1), (11, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == df.columns
        assert corpus_pipeline.run(spark, sf).count() == docs.count()
        assert docs.count() > 30 if name == "hard" else docs.count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage's decisions over what its predecessor kept."""
    from confluo.llm.queries import op4_toxicity
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "source").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in op4_toxicity(spark, SF_CHECK).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs if r.doc_id not in toxic]
    groups = brute.joined(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    hits = brute.contaminated(rows, items, 10)
    rows = [(i, t) for i, t in rows if not hits[i][4]]
    out = corpus_pipeline.run(spark, SF_CHECK).collect()
    want = brute.shards(rows, 40)
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.grown_shard) for r in out} == want and len(out) == len(want)


def test_passages_longer_than_a_small_window(spark):
    """A passage of more n-grams than a window's short form holds is found whole."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, front, back = words(150_000), words(100), words(100)
    rows = [(1, " ".join(passage + back)), (2, " ".join(front + passage)), (3, " ".join(words(300)))]
    out = near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_word, r.last_word, r.other_id, r.other_first, r.other_last, r.jaccard) for r in out} == {
        (2, 100, 150_099, 1, 0, 149_999, 1.0)}
