"""The wide column comparison reads every column of its tables."""

import duckdb
from confluo.oracle import ORACLE, WIDE_COLUMNS, _java_text
from confluo.queries import WIDE_TABLES, load, q_column_tfidf_wide

from conftest import SF_SMALL

BALANCES = [0.0, -0.0, 0.25, -17.5, 123.45, 9999999.5, 1e7, 12345678.9, -9.87654321e12, 0.001, 0.00099, 2.5e-7,
            1.5e300, 123456789012345678.0, 100.0, float("nan"), float("inf"), float("-inf"), None]


def test_every_column_of_the_wide_tables_is_compared(spark):
    assert {t: load(spark, SF_SMALL, t).columns for t in WIDE_TABLES} == WIDE_COLUMNS


def test_doubles_are_text_alike_in_both_engines(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in BALANCES])
    want = [r.s for r in spark.createDataFrame([(x,) for x in BALANCES], "x double").selectExpr("string(x) AS s").collect()]
    got = [s if s is None or float(s) else s.lstrip("-") for (s,) in con.execute(f"SELECT {_java_text('x')} FROM t").fetchall()]
    assert got == [s if s is None or float(s) else s.lstrip("-") for s in want]


def test_doubles_and_timestamps_are_compared(spark, tmp_path):
    con = duckdb.connect()
    for t in WIDE_TABLES:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet') LIMIT 40")
    for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal")):
        con.execute(f"DELETE FROM {t}")
        con.executemany(f"INSERT INTO {t} ({c}) VALUES (?)", [(x,) for x in BALANCES])
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        con.execute(f"UPDATE {t} SET {c} = TIMESTAMP '2001-02-03 04:05:06.78'")
    for t in WIDE_TABLES:
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, q_column_tfidf_wide(spark, str(tmp_path)).collect()))
    assert {r[:2] for r in got} >= {("c_acctbal", "s_acctbal"), ("o_orderdate", "l_shipdate")}
    assert got == sorted(con.execute(ORACLE["column_tfidf_wide"]).fetchall())
