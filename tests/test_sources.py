import os

import pytest

from confluo.errors import AmbiguousFileError, FileNotFound, HeaderCollisionError, InlineTableError, NoTablesError
from confluo.sources.catalogue import columns_by_file, header_catalogue
from confluo.sources.csv import find_file, list_csv_files, read_csv, read_session, sanitize_headers
from confluo.sources.inline import inline_table
from confluo.sources.sinks import preview_records, write_csv, write_csv_file

from conftest import write


def test_quoted_newline_multi_vs_single(spark, tmpdir_csv):
    p = write(os.path.join(tmpdir_csv, "q.csv"), 'a,b\n"x\ny",1\n')
    assert read_csv(spark, p, multi_line=True).count() == 1
    assert read_csv(spark, p, multi_line=False).count() == 2


def test_ragged_rows_pad_and_truncate(spark, tmpdir_csv):
    p = write(os.path.join(tmpdir_csv, "r.csv"), "a,b,c\n1,2\n1,2,3,4\n")
    rows = [tuple(r) for r in read_csv(spark, p).collect()]
    assert rows == [("1", "2", None), ("1", "2", "3")]


def test_duplicate_headers_and_sanitise(spark, tmpdir_csv):
    p = write(os.path.join(tmpdir_csv, "d.csv"), "a,A,,a,b \n1,2,3,4,5\n")
    df = read_csv(spark, p)
    assert df.columns == ["a0", "A1", "_c2", "a3", "b "]
    assert sanitize_headers(df).columns == ["a0", "A1", "_c2", "a3", "b"]
    p2 = write(os.path.join(tmpdir_csv, "e.csv"), "x...y, x_%&%_y\n1,2\n")
    with pytest.raises(HeaderCollisionError):
        sanitize_headers(read_csv(spark, p2))


def test_session_discovery(spark, tmpdir_csv):
    write(os.path.join(tmpdir_csv, "b.csv"), "k,v\n1,2\n")
    write(os.path.join(tmpdir_csv, "a.csv"), "k,w\n3,4\n")
    write(os.path.join(tmpdir_csv, "upper.CSV"), "k\n1\n")
    write(os.path.join(tmpdir_csv, "notes.txt"), "x\n")
    os.makedirs(os.path.join(tmpdir_csv, "sub"))
    write(os.path.join(tmpdir_csv, "sub", "c.csv"), "z\n9\n")
    top = sorted(r.file for r in list_csv_files(spark, tmpdir_csv).collect())
    assert top == ["a.csv", "b.csv"]
    deep = sorted(r.file for r in list_csv_files(spark, tmpdir_csv, recursive=True).collect())
    assert deep == ["a.csv", "b.csv", "c.csv"]
    tables = read_session(spark, tmpdir_csv)
    assert list(tables) == ["a.csv", "b.csv"]
    cat = header_catalogue(spark, tables)
    assert columns_by_file(cat) == {"a.csv": ["k", "w"], "b.csv": ["k", "v"]}
    assert find_file(spark, tmpdir_csv, "c.csv").endswith("sub/c.csv")
    with pytest.raises(FileNotFound):
        find_file(spark, tmpdir_csv, "zzz.csv")
    write(os.path.join(tmpdir_csv, "sub", "a.csv"), "k\n1\n")
    with pytest.raises(AmbiguousFileError):
        find_file(spark, tmpdir_csv, "a.csv")


def test_missing_path_is_typed(spark, tmpdir_csv):
    with pytest.raises(FileNotFound):
        read_csv(spark, os.path.join(tmpdir_csv, "nope.csv")).count()


def test_inline_table(spark):
    payload = {"name": "t", "columns": [{"column_name": "a", "data": ["1", "2"]},
                                         {"column_name": "b", "data": ["x", "y"]}]}
    assert [tuple(r) for r in inline_table(spark, payload).collect()] == [("1", "x"), ("2", "y")]
    for data in (["x"], ["x", "y", "z"]):
        payload["columns"][1]["data"] = data
        with pytest.raises(InlineTableError):
            inline_table(spark, payload)


def test_session_keeps_every_csv(spark, tmpdir_csv):
    write(os.path.join(tmpdir_csv, "a.csv"), "k\n1\n")
    write(os.path.join(tmpdir_csv, "sales_combined.csv"), "k\n2\n")
    assert list(read_session(spark, tmpdir_csv)) == ["a.csv", "sales_combined.csv"]


def test_sessions_read_records_over_several_lines(spark, tmpdir_csv):
    from confluo.plans.homogenize import combine_session, homogenize_session
    from confluo.plans.session import report_for_file
    write(os.path.join(tmpdir_csv, "my +file.csv"), 'k,v\n"x\ny",1\n"1,5"" pipe",2\n1.5" pipe,3\n')
    mapping = {"k": {"my +file.csv": ["k"]}}
    out = combine_session(spark, tmpdir_csv, mapping, source_col="src", row_id_col="row")
    assert sorted(map(tuple, out.collect())) == [('1,5" pipe', "my +file.csv", 1), ('1.5" pipe', "my +file.csv", 2),
                                                 ("x\ny", "my +file.csv", 0)]
    path = homogenize_session(spark, tmpdir_csv, mapping, os.path.join(tmpdir_csv, "out"), row_id_col="row")
    assert sorted(r.row for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    # a newline in a value makes no null of the next column
    report = report_for_file(spark, write(os.path.join(tmpdir_csv, "c.csv"), 'id,v\n1,"x\ny"\n2,3\n'), exact=True)
    assert report["nulls"].count() == 0


def test_quote_all_and_round_trip(spark, tmpdir_csv):
    df = spark.createDataFrame([("a", None), ("", "b,c")], "x string, y string")
    out = write_csv(df, os.path.join(tmpdir_csv, "out"), quote_all=True, single_file=True)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert '"x","y"' in lines and '"a",""' in lines and '"","b,c"' in lines
    back = read_csv(spark, out)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("a", None), (None, "b,c")], key=str)
    recs = [r.record for r in preview_records(df, 1, ["y"]).collect()]
    assert recs == ['{"x":"a"}']


def test_rfc4180_quotes_round_trip(spark, tmpdir_csv):
    p = write(os.path.join(tmpdir_csv, "q.csv"), 'a,b\n"say ""hi""\nthere",x\\y\n')
    rows = [tuple(r) for r in read_csv(spark, p).collect()]
    assert rows == [('say "hi"\nthere', "x\\y")]
    out = write_csv(read_csv(spark, p), os.path.join(tmpdir_csv, "q_out"))
    assert [tuple(r) for r in read_csv(spark, out).collect()] == rows


def test_session_headers_are_read_in_one_job(spark, tmpdir_csv):
    from confluo.sources.headers import column_names, session_headers
    headers = ["a,b", "a,A,,a", '"x\ny",z', ' "q" ,w', '"p ""1""",q"2', "one"]
    for i, h in enumerate(headers):
        write(os.path.join(tmpdir_csv, f"f {i}+.csv"), ("\n" if i == 1 else "") + h + "\n" + "1,2\n" * 50_000)
    write(os.path.join(tmpdir_csv, "empty.csv"), "")
    write(os.path.join(tmpdir_csv, "other.txt"), "no\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    got = session_headers(spark, tmpdir_csv).orderBy("file_idx", "ordinal").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for i in range(len(headers)):
        rows = [r for r in got if r.file_idx == i]
        assert {r.file for r in rows} == {f"f {i}+.csv"} and [r.ordinal for r in rows] == list(range(1, len(rows) + 1))
        assert [r.column_name for r in rows] == read_csv(spark, os.path.join(tmpdir_csv, f"f {i}+.csv")).columns
    assert {r.file_idx for r in got} == set(range(len(headers))) and column_names("") == []
    with pytest.raises(FileNotFound):
        session_headers(spark, os.path.join(tmpdir_csv, "none"))
    os.mkdir(os.path.join(tmpdir_csv, "no_csv"))
    write(os.path.join(tmpdir_csv, "no_csv", "x.txt"), "x")
    with pytest.raises(NoTablesError):
        session_headers(spark, os.path.join(tmpdir_csv, "no_csv"))


def test_one_file_is_written_in_parts(spark, tmpdir_csv):
    rows = [(i, None if i % 7 == 0 else f'v {i}, "q"\n{"x" * (i % 50 + 1)}') for i in range(5000)]
    df = spark.createDataFrame(rows, 'id long, `a "b", c` string').repartitionByRange(7, "id").sortWithinPartitions("id")
    for quote_all in (False, True):
        path = write_csv_file(df, os.path.join(tmpdir_csv, "one +file.csv"), quote_all)
        one = write_csv(df, os.path.join(tmpdir_csv, "folder"), quote_all, single_file=True)
        part = [f for f in os.listdir(one) if f.startswith("part-")]
        with open(path, "rb") as a, open(os.path.join(one, part[0]), "rb") as b:
            assert a.read() == b.read()  # what one task writes, byte by byte
        back = read_csv(spark, path)
        assert back.columns == df.columns and sorted((int(r[0]), r[1]) for r in back.collect()) == sorted(rows)
    assert sorted(os.listdir(tmpdir_csv)) == ["folder", "one +file.csv"]
    # written again, shorter: nothing of the old file stays; a table without rows leaves its header
    write_csv_file(df.limit(3), path)
    assert read_csv(spark, path).count() == 3
    write_csv_file(df.limit(0), path)
    assert read_csv(spark, path).columns == df.columns and read_csv(spark, path).count() == 0
