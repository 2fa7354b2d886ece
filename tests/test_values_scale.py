"""Column similarity reads every token's columns off one row."""

from confluo.operators.values import column_similarity


def test_terms_meet_without_joins_of_vocabularies(spark):
    tables = {t: spark.createDataFrame([("aa bb cc",), ("bb dd",)], "t string") for t in ("x", "y", "z")}
    out = column_similarity(tables, threshold=0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString(), out._jdf.queryExecution().sparkPlan().toString()
    assert not any(j in p for p in plan for j in ("SortMergeJoin", "ShuffledHashJoin"))
    assert sorted((r.df1_name, r.df2_name, round(r.similarity, 9)) for r in out.collect()) == [
        ("x", "y", 1.0), ("x", "z", 1.0), ("y", "z", 1.0)]
