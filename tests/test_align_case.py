"""Headers that differ only in case."""

import pytest

from confluo.errors import HeaderCollisionError
from confluo.operators.align import align_union


def test_case_variants_raise_or_merge(spark):
    a = spark.createDataFrame([(1, "x")], "ID int, v string")
    b = spark.createDataFrame([(2, "y")], "id int, w string")
    with pytest.raises(HeaderCollisionError):
        align_union({"a": a, "b": b})
    out = align_union({"a": a, "b": b}, merge_case=True)
    assert out.columns == ["ID", "v", "w"]
    assert sorted(map(tuple, out.collect())) == [(1, "x", None), (2, None, "y")]
    twice = spark.createDataFrame([(1, 2)], "p int, q int").toDF("k", "K")
    with pytest.raises(HeaderCollisionError):
        align_union({"t": twice}, merge_case=True)


def test_types_that_differ_become_text(spark):
    a = spark.createDataFrame([(1,)], "v int")
    b = spark.createDataFrame([("x",)], "v string")
    assert sorted(r.v for r in align_union([a, b]).collect()) == ["1", "x"]
