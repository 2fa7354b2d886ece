import math
import random

import numpy as np
import pytest

from confluo.operators import quality as Q
from confluo.operators.quantiles import approx_quantiles, exact_quantiles


def test_null_profile_forms(spark):
    rows = [(None, "1.5", 1.0), ("", "NaN", float("nan")), ("abc", "1d", 2.0), ("Infinity", "x", None)]
    df = spark.createDataFrame(rows, "s string, t string, d double")
    got = {r.column: r.nulls for r in Q.null_profile(df).collect()}
    assert got == {"s": 2, "t": 1, "d": 2}
    got = {r.column: r.nulls for r in Q.null_profile(df, empty_as_null=False).collect()}
    assert got["s"] == 1


def test_castable_counts_and_numeric(spark):
    df = spark.createDataFrame([("1", "a", "NaN", None), ("x", "b", "NaN", None)],
                               "n string, s string, nan string, z string")
    got = {r.column: (r.n_castable, r.is_numeric) for r in Q.castable_counts(df).collect()}
    assert got == {"n": (1, True), "s": (0, False), "nan": (2, True), "z": (0, False)}
    assert Q.numeric_columns(df).columns == ["n", "nan"]
    assert Q.categorical_columns(df).columns == ["s", "z"]


def _disc(vals, p):
    s = sorted(v for v in vals if v is not None and not math.isnan(v))
    return s[max(1, math.ceil(p * len(s))) - 1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quantiles_match_percentile_disc(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(50, 3000)
    hot = rnd.random()
    a = [hot if rnd.random() < 0.34 else rnd.gauss(0, 10) for _ in range(n)]   # a third on one value
    b = [float(rnd.randint(0, 5)) for _ in range(n)]
    c = [None if rnd.random() < 0.2 else (float("nan") if rnd.random() < 0.05 else rnd.random()) for _ in range(n)]
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    for name, vals in (("a", a), ("b", b), ("c", c)):
        assert got[name] == [_disc(vals, p) for p in probs], name
    spark_disc = df.selectExpr("percentile_disc(0.25) within group (order by a)").collect()[0][0]
    assert spark_disc == got["a"][1]


def test_approx_quantiles_within_error(spark):
    rnd = random.Random(7)
    vals = [rnd.random() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    q = approx_quantiles(df, ["v"], [0.25, 0.75], 0.05)["v"]
    s = sorted(vals)
    for p, got in zip([0.25, 0.75], q):
        rank = s.index(got) + 1
        assert abs(rank - p * len(s)) <= 0.05 * len(s) + 1


def test_all_nan_column_has_no_fences(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (None, 2.0)], "a double, b double")
    assert [r.column for r in Q.iqr_fences(df, exact=True).collect()] == ["b"]
    assert [r.column for r in Q.iqr_fences(df, exact=False).collect()] == ["b"]


def test_outliers_strict_and_nan(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, float("nan"), None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v double, i int")
    rep = Q.outlier_report(df, ["v"], exact=True).collect()[0]
    q1, q3 = _disc(vals, 0.25), _disc(vals, 0.75)
    assert (rep.q1, rep.q3) == (q1, q3)
    assert rep.n_outliers == 2   # 100 and NaN; null is not an outlier
    rows = Q.iqr_outliers(df, "v", exact=True).collect()
    assert sorted(r.i for r in rows) == [4, 5]


@pytest.mark.parametrize("kind", ["random", "constant", "integers"])
def test_histogram_matches_numpy(spark, kind):
    rnd = np.random.default_rng(3)
    if kind == "random":
        v = rnd.normal(0, 1, 4000)
    elif kind == "constant":
        v = np.full(50, 3.25)
    else:
        v = rnd.integers(1, 51, 6000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {(r.series, r.bin): r.n for r in Q.histogram(df, ["v"], exact=True).collect()}
    counts, _ = np.histogram(v, bins=30)
    assert {b: n for (s, b), n in got.items() if s == "all"} == {i: int(c) for i, c in enumerate(counts) if c}
    q1, q3 = _disc(list(v), 0.25), _disc(list(v), 0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    out = v[(v < lo) | (v > hi)]
    if len(out):
        oc, _ = np.histogram(out, bins=30)
        assert {b: n for (s, b), n in got.items() if s == "outliers"} == {i: int(c) for i, c in enumerate(oc) if c}
    else:
        assert not any(s == "outliers" for s, _ in got)


def test_outlier_report_only_null_columns(spark):
    df = spark.createDataFrame([("1", "1"), ("2", None), ("50", "3")], "a string, b string")
    cols = [r.column for r in Q.outlier_report(df, exact=True, only_null_columns=True).collect()]
    assert cols == ["b"]


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60),
       st.integers(1, 5))
def test_exact_quantiles_property(spark, vals, parts):
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(parts)
    got = exact_quantiles(df, ["v"], [0.25, 0.75])["v"]
    present = [v for v in vals if v is not None]
    if not present:
        assert got is None
    else:
        assert got == [_disc(vals, 0.25), _disc(vals, 0.75)]


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_exact_quantiles_by_digits_of_any_size(spark, monkeypatch, bins):
    from confluo.operators import quantiles
    monkeypatch.setattr(quantiles, "BINS", bins)
    rnd = random.Random(bins)
    a = [float(rnd.randint(0, 400)) for _ in range(3000)]
    b = [rnd.random() * 1000 for _ in range(3000)]
    c = [rnd.choice([1, -1]) * 10.0 ** rnd.uniform(-320, 308) for _ in range(3000)]
    d = [rnd.choice([0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308, math.nextafter(1, 2), 1.0]) for _ in range(3000)]
    df = spark.createDataFrame(list(zip(a, b, c, d)), "a double, b double, c double, d double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], probs)
    for name, vals in (("a", a), ("b", b), ("c", c), ("d", [x for x in d if not math.isnan(x)])):
        assert got[name] == [_disc(vals, p) for p in probs]


def test_exact_quantiles_take_a_fixed_number_of_scans(spark, monkeypatch):
    """Neighbouring doubles among far ones: the last digit is found after five scans."""
    from confluo.operators import quantiles
    scans, keep = [], quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda df, cells: scans.append(len(cells)) or keep(df, cells))
    near = [1.0]
    for _ in range(500):
        near.append(math.nextafter(near[-1], 2))
    vals = near + [1.04, 1e-300, 1e300] * 100
    df = spark.createDataFrame([(v, -v) for v in vals], "v double, w double")
    assert exact_quantiles(df, ["v", "w"], [0.5]) == {"v": [_disc(vals, 0.5)], "w": [_disc([-v for v in vals], 0.5)]}
    assert len(scans) <= 5


def test_infinities_have_no_bin(spark):
    vals = [float(i) for i in range(20)] + [math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    rows = [r for r in Q.histogram(df, ["v"], exact=True).collect() if r.series == "all"]
    assert sum(r.n for r in rows) == 20 and all(0 <= r.bin < 30 for r in rows)
    assert [tuple(r) for r in Q.non_finite_counts(df, ["v"]).collect()] == [("v", 1, 2)]
    wide = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)], "v double")
    assert sorted(r.bin for r in Q.histogram(wide, ["v"], exact=True).collect() if r.series == "all") == [0, 15, 29]


def test_number_pattern_lets_every_castable_value_through(spark):
    from pyspark.sql import functions as F
    from confluo.functions.nulls import NAN, NUMBER
    vals = ["1", " 1 ", "+1.5", "-.5", "1.", "1e5", "1E-5", "1d", "2F", "0x1p3", "NaN", "nan", "+NaN", "-NaN", "Infinity", "-inf",
            "+INF", "\t7\n", "1_000", "abc", "", " ", "1-URGENT", "1995-01-01", "e5", ".", "+", "1e", "nand", "1 2", "١"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for r in df.select("s", F.col("s").try_cast("double").alias("d"), F.col("s").rlike(NUMBER).alias("ok"),
                       F.col("s").rlike(NAN).alias("nan")).collect():
        assert r.ok or r.d is None, r
        assert r.nan == (r.d is not None and math.isnan(r.d)), r
