"""End-to-end session plans on a small CSV session."""

import os

import pytest

from confluo.errors import HeaderCollisionError
from confluo.plans.homogenize import homogenize_session
from confluo.plans.recommend import recommend_names, recommend_values
from confluo.plans.report import final_report
from confluo.sources.csv import read_csv

from conftest import write


def _session(d):
    write(os.path.join(d, "crm.csv"), "cust name,cust_city,amount\nAnn Lee,Oslo,10\nBo Kim,Rome,20\n"
                                      "Cy Park,Oslo,1000\nDee Ray,,15\n")
    write(os.path.join(d, "erp.csv"), "name cust,city,amount,note\nEd Fox,Oslo,12\nFay Gul,Rome,NaN,x\n"
                                      "Gus Ho,Lima,14,\n")
    return d


def test_recommend_homogenize_report(spark, tmpdir_csv):
    d = _session(tmpdir_csv)
    recs = recommend_names(spark, d, threshold=80)
    got = {(r.file_left, r.column, r.file_right, r.similar, r.kind) for r in recs.collect()}
    assert ("erp.csv", "name cust", "crm.csv", "cust name", "single") in got
    assert ("erp.csv_", "amount", "crm.csv", "amount", "equal") in got

    vals = recommend_values(spark, d, threshold=0.5, sample_fraction=None)
    pairs = {(r.column_df1, r.column_df2) for r in vals.collect()}
    assert ("cust_city", "city") in pairs

    mapping = {"name": {"crm.csv": ["cust name"], "erp.csv": ["name cust"]},
               "city": {"crm.csv": ["cust_city"], "erp.csv": ["city"]},
               "amount": {"crm.csv": ["amount"], "erp.csv": ["amount"]}}
    out = homogenize_session(spark, d, mapping, os.path.join(d, "out_csv"), fmt="csv", single_file=True)
    combined = read_csv(spark, out)
    assert combined.columns == ["name", "city", "amount"]
    assert combined.count() == 7

    rep = final_report(combined, exact=True)
    nulls = {r.column: r.nulls for r in rep["nulls"].collect()}
    assert nulls == {"city": 1, "amount": 1}
    out_rows = {r.column: r.n_outliers for r in rep["outliers"].collect()}
    assert out_rows == {"amount": 2}   # 1000 and the NaN cell
    hist = rep["histogram"].collect()
    assert sum(r.n for r in hist if r.series == "all") == 6


def test_service_tasks(spark, tmpdir_csv):
    from confluo.plans.session import (compare_inline, export_quote_all, preview_file, report_for_file,
                                       search_files, session_columns)
    d = _session(tmpdir_csv)
    assert session_columns(spark, d) == {"crm.csv": ["cust name", "cust_city", "amount"],
                                         "erp.csv": ["name cust", "city", "amount", "note"]}
    assert sorted(r.file for r in search_files(spark, d).collect()) == ["crm.csv", "erp.csv"]
    recs = [r.record for r in preview_file(spark, os.path.join(d, "crm.csv")).collect()]
    assert len(recs) == 4 and '"cust name":"Ann Lee"' in recs[0]
    out = export_quote_all(spark, d, "erp.csv", os.path.join(d, "export"))
    assert '"Ed Fox","Oslo","12",""' in [r.value for r in spark.read.text(out).collect()]
    left = {"name": "a", "columns": [{"column_name": "c", "data": ["red fox", "blue fox"]}]}
    right = {"name": "b", "columns": [{"column_name": "d", "data": ["fox red", "fox blue"]}]}
    sims = compare_inline(spark, left, right).collect()
    assert [(r.column_df1, r.column_df2, round(r.similarity, 9)) for r in sims] == [("c", "d", 1.0)]
    rep = report_for_file(spark, os.path.join(d, "crm.csv"), exact=True)
    assert {r.column: r.n_outliers for r in rep["outliers"].collect()} == {"amount": 1}   # 1000 > 20 + 1.5·10


def test_report_dict(spark, tmpdir_csv):
    from confluo.plans.report import report_dict
    d = _session(tmpdir_csv)
    rep = report_dict(final_report(read_csv(spark, os.path.join(d, "erp.csv")), exact=True))
    assert rep["amount"]["nulls"] == 1 and rep["note"]["nulls"] == 2
    assert rep["amount"]["outliers"]["n_outliers"] == 1          # the NaN cell
    assert sum(rep["amount"]["histogram"]["all"].values()) == 2


def test_same_layout_files_share_one_scan(spark, tmpdir_csv):
    from confluo.plans.homogenize import combine_session
    for day in range(3):
        write(os.path.join(tmpdir_csv, f"day{day}.csv"), f"id,amt\n{day}1,1\n{day}2,2\n")
    write(os.path.join(tmpdir_csv, "other.csv"), "key,value\n9,9\n")
    mapping = {"id": {f"day{d}.csv": ["id"] for d in range(3)} | {"other.csv": ["key"]},
               "amount": {f"day{d}.csv": ["amt"] for d in range(3)} | {"other.csv": ["value"]}}
    df = combine_session(spark, tmpdir_csv, mapping, source_col="source")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2
    got = sorted(map(tuple, df.collect()))
    assert got == sorted([(f"{d}{i}", str(i), f"day{d}.csv") for d in range(3) for i in (1, 2)]
                         + [("9", "9", "other.csv")])


def test_value_recommendations_go_by_sanitised_headers(spark, tmpdir_csv):
    write(os.path.join(tmpdir_csv, "a.csv"), "x...y ,k\nred green,1\nblue,2\n")
    write(os.path.join(tmpdir_csv, "b.csv"), "colour\nred green\nblue\n")
    pairs = lambda **how: {(r.column_df1, r.column_df2) for r in recommend_values(spark, tmpdir_csv, **how).collect()}
    assert pairs() == {("x_%&%_y", "colour")} and pairs(sanitize=False) == {("x...y ", "colour")}
    write(os.path.join(tmpdir_csv, "c.csv"), "v, v\n1,2\n")
    with pytest.raises(HeaderCollisionError):
        recommend_values(spark, tmpdir_csv)
