import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from confluo.functions.shapes import shape_to_regex, value_shape
from confluo.functions.text import normalize_text
from confluo.operators.profile import dominant_shapes, pattern_conformance, value_shapes

from conftest import SF_SMALL


def py_norm(t):
    t = unicodedata.normalize("NFKD", t).encode("ASCII", "ignore").decode("utf-8")
    return " ".join(t.lower().strip().split())


def py_shape(text):
    """Shape by grouping characters into classes: letter runs, numeric runs,
    and every other character on its own."""
    from itertools import groupby

    def cls(ch):
        return "L" if ch.isalpha() else ("N" if ch.isnumeric() else None)

    out = []
    for key, run in groupby(text, key=cls):
        if key == "L":
            out.append("[a-zA-Z]")
        elif key == "N":
            out.append("[0-9]")
        else:
            out.extend(run)
    return "".join(out)


FIXTURES = ["ﬁ", "½ cup", "Straße", "Ñandú", "été", "tab\there", "a\x1cb", "  x  y ", "Ⅻ…", "", "𝐀1"]
FIXTURES += ["x\ue000y", "x\ue000y\ufb01", "\x00\ufb01"]   # the sentinel and NUL in the input
FIXTURES += ["cafe\u0301 nin\u0303o", "A\u030a\u0327"]   # combining accents


def test_normalize_fixtures(spark):
    df = spark.createDataFrame([(t,) for t in FIXTURES], "t string")
    got = [r[0] for r in df.select(normalize_text(F.col("t"))).collect()]
    assert got == [py_norm(t) for t in FIXTURES]


def test_normalize_documents_whole_text(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for r in d.select("text", normalize_text(F.col("text")).alias("n")).collect():
        assert r.n == py_norm(r.text)


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=30))
def test_normalize_idempotent_and_matches_python(spark, s):
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(normalize_text(F.col("t")).alias("n")).select("n", normalize_text(F.col("n")).alias("nn")).collect()[0]
    assert r.n == py_norm(s)
    assert r.nn == r.n


def test_value_shape_matches_char_loop(spark):
    vals = ["Brand#13", "1-URGENT", "Customer#000000001", "http://x.example.com/en/25?p=2", "ab12cd", "é9", ""]
    d = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("url")
    vals += [r.url for r in d.collect()]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(value_shape(F.col("v"))).collect()]
    assert got == [py_shape(v) for v in vals]


def test_shape_regex_and_conformance(spark):
    assert shape_to_regex("[a-zA-Z]#[0-9]") == "^\\p{L}+\\Q#\\E\\p{N}+\\z"
    df = spark.createDataFrame([("Brand#1",), ("Brand#22",), ("x.y",), (None,)], "b string")
    dom = dominant_shapes(df, ["b"]).collect()[0]
    assert (dom.shape, dom.n) == ("[a-zA-Z]#[0-9]", 2)
    pc = pattern_conformance(df).collect()[0]
    assert (pc.n_values, pc.n_match) == (3, 2)
    pc2 = pattern_conformance(df, {"b": "y$"}).collect()[0]
    assert pc2.n_match == 1
    assert {(r.shape, r.n) for r in value_shapes(df, ["b"]).collect()} == {("[a-zA-Z]#[0-9]", 2), ("[a-zA-Z].[a-zA-Z]", 1)}


def test_multi_letter_forms(spark):
    import unicodedata
    values = ["wait…", "½ cup™ № 5 ﬁne ﬂow", "…" * 50, "ﷺ", "a¼b¾c", "plain", "é…é"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.n for r in df.select(normalize_text(F.col("s")).alias("n")).collect()]
    want = [" ".join(unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower().split()) for v in values]
    assert got == want


def test_conformance_does_not_take_a_last_newline(spark):
    from confluo.functions.shapes import shape_to_regex
    df = spark.createDataFrame([("ab1",), ("cd2",), ("ef3\n",)], "s string")
    assert df.where(F.col("s").rlike(shape_to_regex("[a-zA-Z][0-9]"))).count() == 2
