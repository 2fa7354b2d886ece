"""Scale properties of the physical plans (checked on the plan, not on timing)."""


import __spark_entry__ as E
from confluo.operators.names import name_pairs
from confluo.operators.quality import null_profile
from confluo.operators.values import column_similarity
from confluo.sources.catalogue import header_catalogue

from conftest import SF_SMALL

BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def load(spark, t):
    return spark.read.parquet(f"{SF_SMALL}/{t}.parquet")


def test_homogenize_is_narrow_and_pruned(spark):
    p = plan(E.entry(spark))
    assert "Exchange" not in p
    assert "ReadSchema: struct<c_name:string,c_acctbal:double,c_mktsegment:string>" in \
        E.entry(spark)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_null_profile_is_one_aggregate(spark):
    p = plan(null_profile(E.queries()["align_union"](spark, SF_SMALL)))
    assert p.count("Exchange SinglePartition") == 1
    assert not any(b in p for b in BAD_JOINS)


def test_similarity_and_name_pairs_use_equi_joins(spark):
    names = ["part", "customer", "documents"]
    tables = {t: load(spark, t) for t in names}
    for threshold in (0.8, None):
        assert not any(b in plan(column_similarity(tables, threshold=threshold)) for b in BAD_JOINS)
    from confluo.queries import TABLES
    cat = header_catalogue(spark, {t: load(spark, t) for t in TABLES})
    assert not any(b in plan(name_pairs(cat, 80)) for b in BAD_JOINS)


def test_exact_quantile_plan_has_no_cross_join(spark):
    from confluo.operators.quantiles import exact_quantiles_df
    p = plan(exact_quantiles_df(load(spark, "lineitem"), ["l_quantity", "l_tax"], [0.25, 0.75]))
    assert not any(b in p for b in BAD_JOINS)


def test_recommendations_have_no_one_task_window(spark):
    from confluo.operators.names import name_recommendations
    cat = header_catalogue(spark, {t: load(spark, t) for t in ("customer", "supplier", "part", "orders")})
    p = plan(name_recommendations(cat, 80))
    assert "SinglePartition" not in p and not any(b in p for b in BAD_JOINS)


def test_similarity_joins_on_many_keys(spark):
    import re
    tables = {t: load(spark, t) for t in ("part", "customer", "documents")}
    p = plan(column_similarity(tables, threshold=0.5))
    keys = [set(re.findall(r"(\w+)#", k)) for k in re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\]", p)]
    terms = [k for k in keys if k & {"ta", "tb", "tidx"}]
    assert terms and all(k & {"token", "bucket", "dfreq"} for k in terms), keys
