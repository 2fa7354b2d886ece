import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["name", "balance", "category"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 20


def test_queries_give_the_rows_of_their_sql(spark):
    """Row counts and columns of every query with an oracle, on the smallest tables."""
    import duckdb
    con = duckdb.connect()
    from confluo.oracle import ORACLE, TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in ORACLE.items():
        want = con.execute(sql)
        columns = sorted(d[0] for d in want.description)
        df = E.queries()[name](spark, SF_SMALL)
        assert (sorted(df.columns), df.count()) == (columns, len(want.fetchall())), name
