import os
import tempfile

from confluo.streaming.homogenize import csv_stream, homogenize_stream, start_parquet_sink
from confluo.streaming.profile import null_profile_stream

from conftest import write


def test_stream_homogenize_and_profile(spark, tmpdir_csv):
    src = os.path.join(tmpdir_csv, "in")
    os.makedirs(src)
    write(os.path.join(src, "day1.csv"), 'id,first,last,amt\n1,Ann,Lee,5\n2,,"Kim ""K"", jr",\n')
    write(os.path.join(src, "day2.csv"), "id,first,last,amt\n3,Bo,,NaN\n")
    stream = csv_stream(spark, src, ["id", "first", "last", "amt"])
    mapping = {"name": {"crm": ["first", "last"]}, "amount": {"crm": ["amt"]}}
    out = homogenize_stream(stream, "crm", mapping, source_col="source")
    sink = tempfile.mkdtemp(prefix="confluo-stream-out-")
    ck = tempfile.mkdtemp(prefix="confluo-stream-ck-")
    q = start_parquet_sink(out, sink, ck, trigger_once=True)
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert got == [("Ann Lee", "5", "crm"), ("Bo", "NaN", "crm"), ('Kim "K", jr', "", "crm")]

    prof = null_profile_stream(csv_stream(spark, src, ["id", "first", "last", "amt"]))
    q2 = prof.writeStream.outputMode("complete").format("memory").queryName("np_test").start()
    q2.processAllAvailable()
    q2.stop()
    got = {r.column: (r.nulls, r.rows) for r in spark.sql("select * from np_test").collect()}
    assert got == {"id": (0, 3), "first": (1, 3), "last": (1, 3), "amt": (2, 3)}
