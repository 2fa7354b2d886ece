"""Multi-line CSV in parallel: the same rows as the one-task reader, whatever the splits."""

import random

import pytest
from conftest import write

from confluo.sources.csv import read_csv
from confluo.sources.records import ends_inside, scan_csv, splits_of


@pytest.fixture()
def small_splits(spark):
    """Splits of a few dozen bytes, set for a test."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('"a ""b"" c', True, False), ('5" pipe,x', False, False),
    ('1,5" pipe', False, False), ('x",y', False, False), ('"', True, False), ('""', False, True), ('a,"",c', False, True),
    ('"a"x"y,"b', True, True), ('"",', False, True), ('a,"b,c"",d', True, False), ("", False, True)])
def test_line_ends_inside_a_quoted_field(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)


def test_line_ends_inside_with_another_escape():
    assert ends_inside(r'"a\"b', False, escape="\\") and not ends_inside(r'"a\"b"', False, escape="\\")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SMALL = {
    "plain": "id,v\n1,a\n2,b\n",
    "quotes amid values": 'id,v\n1,5" pipe\n2,6" pipe "x"\n3,"a ""b"""\n',
    "newlines": 'id,v\n1,"x\ny"\n2,"a\n\n\nb ""c""\n,d"\n3,plain\n4,"1,5"" pipe\n"\n',
    "mixed": 'id,v\n1,5" pipe\n2,"x\ny"\n3,5" pipe\n4,"z\n5"" pipe\n"\n',
    "crlf": 'id,v\r\n1,"x\r\ny"\r\n2,b\r\n',
    "no end of line": 'id,v\n1,"x\ny"\n2,"z\nw"',
    "header of lines": '"i\nd",v\n1,"x\ny"\n',
    "ragged": 'id,v\n1\n2,"b\nc",d\n3,\n',
    "blank lines": '\nid,v\n\n1,"x\n\ny"\n\n\n2,b\n',
    "header only": '"i\nd",v\n',
    "a record over many splits": 'id,v\n1,"' + "line of text\n" * 60 + '"\n2,"' + "z" * 500 + '\n"\n3,c\n',
}


@pytest.mark.parametrize("name", SMALL)
def test_same_rows_as_the_one_task_reader(spark, tmpdir_csv, small_splits, name):
    path = write(f"{tmpdir_csv}/a b.csv", SMALL[name])
    one, many = read_csv(spark, path, multi_line=True), scan_csv(spark, path)
    assert many.columns == one.columns and rows(many) == rows(one)


def test_random_files_in_random_splits(spark, tmpdir_csv, small_splits):
    rng = random.Random(4)
    for k in range(6):
        n = rng.randrange(1, 60)
        text = "a,b,c\n"
        for _ in range(n):
            cells = ["".join(rng.choice('xy,"\né ') for _ in range(rng.randrange(0, 30))) for _ in range(3)]
            text += ",".join('"' + c.replace('"', '""') + '"' for c in cells) + "\n"
        path = write(f"{tmpdir_csv}/r{k}.csv", text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([7, 33, 150, 100_000])))
        assert rows(scan_csv(spark, path)) == rows(read_csv(spark, path, multi_line=True))


def test_several_files_and_their_names(spark, tmpdir_csv, small_splits):
    for i in range(3):
        write(f"{tmpdir_csv}/f {i}.csv", SMALL["newlines"] if i else SMALL["plain"])
    paths = [f"{tmpdir_csv}/f {i}.csv" for i in range(3)]
    got = scan_csv(spark, paths, source_col="file")
    assert rows(got.drop("file")) == rows(read_csv(spark, paths, multi_line=True))
    assert {r.file: r["count"] for r in got.groupBy("file").count().collect()} == {"f 0.csv": 2, "f 1.csv": 4, "f 2.csv": 4}


def test_one_file_is_read_in_many_tasks(spark, tmpdir_csv, small_splits):
    path = write(f"{tmpdir_csv}/big.csv", "id,v\n" + "".join(f'{i},"x\ny"\n' for i in range(200)))
    df = scan_csv(spark, path)
    assert df.count() == 200 and df.rdd.getNumPartitions() > 20
    assert sum(splits_of(spark, [path]).values()) > 3


def test_files_without_long_records_go_to_the_line_reader(spark, tmpdir_csv):
    path = write(f"{tmpdir_csv}/p.csv", SMALL["quotes amid values"])
    assert splits_of(spark, [path]) is None
    assert "MapInArrow" not in scan_csv(spark, path)._jdf.queryExecution().toString()


def test_an_open_quote_at_the_end_of_a_file(spark, tmpdir_csv, small_splits):
    path = write(f"{tmpdir_csv}/open.csv", 'id,v\n1,"x\ny"\n2,"z\nw\n')
    assert rows(scan_csv(spark, path)) == [("1", "x\ny"), ("2", "z\nw")]


@pytest.mark.parametrize("cell", ["v{}", '"v\n{}"', '"' + "long line\n" * 20 + '{}"'])
def test_row_numbers_are_places_in_the_file(spark, tmpdir_csv, small_splits, cell):
    for f in "ab":
        write(f"{tmpdir_csv}/{f}.csv", "id,v\n\n" + "".join(f"{i},{cell.format(i)}\n" for i in range(70)))
    paths = [f"{tmpdir_csv}/{f}.csv" for f in "ab"]
    want = sorted((f"{f}.csv", i, str(i)) for f in "ab" for i in range(70))
    for size in ("64", "200", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = scan_csv(spark, paths, source_col="file", row_col="row").repartition(3)
        assert sorted((r.file, r.row, r.id) for r in got.collect()) == want
