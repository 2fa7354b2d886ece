"""The contract queries' operators against brute force, on hand-made texts."""

import hashlib
import itertools
import random
from re import _constants as sre
from re import _parser as parser

import brute
import llm_fixtures as FIX
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from confluo.llm.decontaminate import contamination, benchmark_hits
from confluo.llm.exact_dedup import exact_dedup
from confluo.llm.licenses import license_detections, scan_licenses, signature_rules
from confluo.llm.ngram_join import jaccard_components
from confluo.llm.pii import find_pii
from confluo.llm.sharding import shard_rows
from confluo.llm.suffix_dedup import suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return FIX.documents(spark, [(i, t, None) for i, t in FIX.plain()]).cache()


def got(df, *columns):
    rows = df.select("doc_id", *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_shards(docs):
    rows = shard_rows(docs, 40)
    assert got(rows, "size", "text_crc32", "shard", "grown_shard") == brute.shards(FIX.plain(), 40)
    for r in rows.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert r.s == list(range(len(r.s)))


def test_jump_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for n in (1, 2, 7, 300):
        rows = shard_rows(ids, n).select("doc_id", "shard", "grown_shard").collect()
        assert all(r.shard == brute.jump(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16), n) for r in rows)
        moved = [r for r in rows if r.shard != r.grown_shard]
        assert all(r.grown_shard == n for r in moved)
        assert abs(len(moved) - 3000 / (n + 1)) < 5 * (3000 / (n + 1)) ** 0.5 + 5


def test_licenses(docs):
    rows = scan_licenses(docs)
    assert got(rows, "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.licenses(FIX.plain())
    labels = {r.doc_id: r for r in rows.collect()}
    text = {t: i for i, t in FIX.plain()}
    assert labels[text["This is released into the public domain."]].labels == "public-domain"
    assert "cc-by-nc-sa-4.0" in labels[text["CC BY-NC-SA 4.0 cc by"]].labels
    assert labels[text["Licensed under the Apache License, Version 2.0."]].labels == "apache,apache-2.0"
    assert labels[text["mit licenses and summit license"]].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in labels.values())


def spelled(regex):
    """Every text that one of the rules' regexes matches."""
    def options(node):
        op, arg = node
        if op is sre.LITERAL:
            return [chr(arg)]
        if op is sre.IN:
            return [chr(c) for _, c in arg]
        if op is sre.SUBPATTERN:
            return texts(arg[-1])
        if op is sre.BRANCH:
            return [t for b in arg[1] for t in texts(b)]
        if op is sre.MAX_REPEAT:
            return [""] * (arg[0] == 0) + texts(arg[2])
        assert op is sre.ASSERT
        return [""]

    def texts(nodes):
        return ["".join(t) for t in itertools.product(*map(options, nodes))]
    return texts(parser.parse(regex))


def test_every_license_rule_runs_whatever_separates_its_words(spark):
    rules = signature_rules()
    shortest = {}
    for r in rules:
        texts = sorted(spelled(r["regex"]), key=len)
        assert all(r["keyword"] in t for t in texts), r
        shortest[r["rule"]] = {texts[0], texts[-1], *texts[1:6]}
    rows = [(i, t.replace(" ", by).title() if by == "-" else t.replace(" ", by))
            for i, ts in shortest.items() for t in ts for by in ("\n", "-", "  ")]
    found = license_detections(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = found.where("rule = id and first = 0 and last = n_words").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in hit} == {i: 3 * len(t) for i, t in shortest.items()}


def test_license_suppression_keeps_what_nothing_better_contains(docs):
    rules = {r["rule"]: r for r in signature_rules()}
    assert len(rules) > 200
    found = {}
    for r in license_detections(docs).where("rule is not null").collect():
        found.setdefault(r.uid, []).append(r)
    for rows in found.values():
        for d in rows:
            rank = lambda x: (-(x.last - x.first), -x.priority, x.rule)
            inside = any(e.first <= d.first and d.last <= e.last and e.priority >= d.priority
                         and ((e.first, e.last) != (d.first, d.last) or rank(e) < rank(d)) for e in rows)
            assert d.suppressed == inside, (d, rows)


def test_ngram_join(docs):
    for width, percent in ((4, 85), (5, 80), (2, 95)):
        assert got(jaccard_components(docs, width=width, percent=percent), "n_shingles", "component_id") == \
            brute.joined(FIX.plain(), width, percent), (width, percent)


def test_ngram_join_of_a_cloud_of_near_copies(spark):
    """A hundred edits of one text at all distances: links only some of the way."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 10])):
            w[k] = f"v{i}.{k}" if rng.random() < 0.7 else f"u{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for counters in (1 << 20, 64):  # also when every counter is crowded
        assert got(jaccard_components(df, counters=counters), "n_shingles", "component_id") == brute.joined(rows, 4, 85)


def test_exact_dedup(docs):
    want = brute.copies(FIX.plain())
    for runs, fan_in in ((256, 16), (1, 2), (8, 2)):
        rows = exact_dedup(docs, runs=runs, fan_in=fan_in)
        assert got(rows, "keep_id", "group_size", "kept", "text_sha256") == want


def test_suffix_dedup(docs):
    want = brute.cut(FIX.plain(), 100)
    assert got(suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    # small batches: many levels and merges
    assert got(suffix_dedup(docs, batch_rows=7), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    # keys with many contexts go another way
    assert got(suffix_dedup(docs, most_together=1), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert got(suffix_dedup(docs, length=40, gram=16), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.cut(FIX.plain(), 40)


def test_suffix_dedup_across_slices(spark, monkeypatch):
    """Texts longer than a slice, one a shifted part of the other."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long), (2, long[700_123:900_456]), (3, "zz" + long[:300])]
    out = got(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "n_bytes", "n_removed", "n_spans")
    assert out == {1: (1_300_000, 0, 0), 2: (200_333, 200_333, 1), 3: (302, 300, 1)}


def test_pii(docs):
    want = brute.personal(FIX.plain())
    rows = find_pii(docs)
    assert got(rows, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {i: w[:5] for i, w in want.items()}
    for i, (spans,) in got(rows, "spans").items():
        assert [s for s in spans.split(",") if s.split(":")[0] in brute.KINDS] == want[i][5]


def test_pii_card_of_single_digits(spark):
    rows = [(1, "card 4 5 3 2 0 1 5 1 1 2 8 3 0 3 6 6 end"), (2, "4-5-3-2-0-1-5-1-1-2-8-3-0-3-6-6"), (3, "1 a 2"),
            (4, "4 5 3 2 0 1 5 1 1 2 8 3 0 3 6 7")]
    want = brute.personal(rows)
    assert want[1][2] == want[2][2] == 1 and want[4][2] == 0
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {i: w[:5] for i, w in want.items()}


def test_contamination(spark, docs):
    plain = FIX.plain()
    items = [("a", " ".join(plain[24][1].split()[45:75])), ("b", "the"), ("c", None), ("d", ""), ("e", "MIT License"),
             ("f", "ab" * 400), ("g", "no such words anywhere at all in any of these texts")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.contaminated(plain, items, 10)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(contamination(docs, bench), *columns) == want
    assert sum(w[4] for w in want.values()) >= 4
    # a benchmark that exceeds one automaton's bound is scanned in chunks
    assert got(contamination(docs, bench, chunk_bytes=300), *columns) == want
    for i, (spans,) in got(contamination(docs, bench), "spans").items():
        text = dict(plain)[i] or ""
        assert sum(len(brute.WORD.findall(brute.low(text[s.first:s.last]))) for s in spans) == want[i][1]


def test_contamination_without_items(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not benchmark_hits(docs, bench).where("size(__hits.words) > 0").count()


def test_contracts_on_the_given_tables(spark):
    from confluo.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    check = lambda name, want, *columns: got(QUERIES[name](spark, SF_SMALL), *columns) == want
    assert check("op2_licenses", brute.licenses(rows), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert check("op5_ngram_join", brute.joined(rows, 4, 85), "n_shingles", "component_id")
    assert check("op7_suffix_dedup", brute.cut(rows, 100), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert check("op8_pii", {i: w[:5] for i, w in brute.personal(rows).items()}, "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert check("op10_decontamination", brute.contaminated(rows, items, 10), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
