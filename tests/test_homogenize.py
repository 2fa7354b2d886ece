from hypothesis import given, settings, strategies as st

import pytest

from confluo.errors import MissingColumnsError
from confluo.operators.align import align_union, distinct_columns
from confluo.operators.homogenize import homogenize, mapping_rows


def _df(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_rename_and_merge(spark):
    a = _df(spark, ["n", "x", "y"], [("A", "1", None), ("B", None, None)])
    b = _df(spark, ["name", "v"], [("C", "9")])
    m = {"name": {"a": ["n"], "b": ["name"]}, "val": {"a": ["x", "y"], "b": ["v"]}}
    out = homogenize({"a": a, "b": b}, m)
    assert out.columns == ["name", "val"]
    assert sorted(map(tuple, out.collect())) == [("A", "1"), ("B", ""), ("C", "9")]


def test_mapping_hazards(spark):
    # shared source, a main named like one of its sources, swapped names
    a = _df(spark, ["p", "q", "r"], [("1", "2", "3")])
    m = {"p": {"a": ["q"]}, "q": {"a": ["p"]}, "both": {"a": ["p", "q"]}, "r": {"a": ["r", "p"]}}
    row = homogenize({"a": a}, m).collect()[0]
    assert row.asDict() == {"p": "2", "q": "1", "both": "1 2", "r": "3 1"}


def test_all_null_sources_give_empty(spark):
    a = _df(spark, ["x", "y"], [(None, None)])
    assert homogenize({"a": a}, {"m": {"a": ["x", "y"]}}).collect()[0].m == ""
    assert homogenize({"a": a}, {"m": {"a": ["x", "y"]}}, fill=None).collect()[0].m == ""
    assert homogenize({"a": a}, {"m": {"a": ["x"]}}, fill=None).collect()[0].m is None


def test_missing_columns_listed_before_select(spark):
    a = _df(spark, ["x"], [("1",)])
    with pytest.raises(MissingColumnsError) as e:
        homogenize({"a": a}, {"m": {"a": ["x", "nope", "gone"]}})
    assert e.value.missing == ["nope", "gone"]


def test_mapping_rows_forms(spark):
    m = {"k": {"f1": ["a", "b"], "f2": ["c"]}, "j": {"f2": ["d"]}}
    rows = mapping_rows(m)
    assert rows == [("k", "f1", 0, "a"), ("k", "f1", 1, "b"), ("k", "f2", 2, "c"), ("j", "f2", 3, "d")]
    df = spark.createDataFrame(rows, "main_col string, file string, ordinal int, source_col string")
    assert mapping_rows(df) == rows


def test_source_and_row_id(spark):
    a = _df(spark, ["x"], [("1",), ("2",)])
    b = _df(spark, ["y"], [("3",)])
    out = homogenize({"a": a, "b": b}, {"m": {"a": ["x"], "b": ["y"]}}, source_col="src", row_id_col="rid")
    got = out.collect()
    assert {(r.src, r.m) for r in got} == {("a", "1"), ("a", "2"), ("b", "3")}
    assert len({(r.src, r.rid) for r in got}) == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=4))
def test_union_row_count_is_sum(spark, sizes):
    tables = {f"t{i}": _df(spark, [f"c{i}", "z"], [(str(j), "v") for j in range(n)]) for i, n in enumerate(sizes)}
    u = align_union(tables)
    assert u.count() == sum(sizes)
    assert u.columns == distinct_columns(tables)
    m = {"z": {t: ["z"] for t in tables}}
    assert homogenize(tables, m).count() == sum(sizes)


def test_align_union_pads_with_null(spark):
    a = _df(spark, ["a", "b"], [("1", "2")])
    b = _df(spark, ["b", "c"], [("3", "4")])
    u = align_union({"a": a, "b": b}, source_col="src")
    assert u.columns == ["a", "b", "c", "src"]
    assert sorted(map(tuple, u.collect()), key=str) == sorted([("1", "2", None, "a"), (None, "3", "4", "b")], key=str)
