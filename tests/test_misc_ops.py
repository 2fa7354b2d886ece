import numpy as np

from confluo.operators.pca import pca_variance
import pytest

from confluo.errors import InvalidRowsError
from confluo.operators.sampling import bernoulli_sample, hash_sample, hash_threshold

from conftest import SF_SMALL


def test_hash_sample_is_deterministic_and_close(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    a = {tuple(r) for r in hash_sample(li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber").collect()}
    b = {tuple(r) for r in hash_sample(li.repartition(5), ["l_orderkey", "l_linenumber"])
         .select("l_orderkey", "l_linenumber").collect()}
    assert a == b
    n = li.count()
    assert abs(len(a) - 0.05 * n) < 5 * np.sqrt(0.05 * n)
    assert hash_threshold(0.05) == 0x0ccccccd and hash_threshold(1.0) == 16 ** 8
    assert bernoulli_sample(li).count() <= n


def test_pca_curve_matches_numpy(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = pca_variance(li, cols, standardize=True).orderBy("k").collect()
    x = np.array([[r[c] for c in cols] for r in li.select(*cols).collect()])
    ev = np.sort(np.linalg.eigvalsh(np.corrcoef(x, rowvar=False)))[::-1]
    want = np.cumsum(ev / ev.sum())
    assert np.allclose([r.cumulative_variance for r in got], want, atol=1e-9)
    assert abs(got[-1].cumulative_variance - 1.0) < 1e-9


def test_full_sample_keeps_every_row(spark):
    df = spark.range(500)
    assert hash_sample(df, ["id"], 1.0).count() == 500
    assert hash_sample(df, ["id"], 1 - 1e-12).count() == 500  # the bound is above every prefix
    assert hash_sample(df, ["id"], 0.0).count() == 0


def test_pca_refuses_rows_that_it_would_skip(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None), (4.0, 7.0), (float("nan"), 1.0)], "a double, b double")
    with pytest.raises(InvalidRowsError, match="2 of 5"):
        pca_variance(df, ["a", "b"])
    assert pca_variance(df, ["a", "b"], skip_invalid=True).count() == 2


def test_pca_on_embedding_arrays(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = pca_variance(emb, vector_col="embedding", standardize=False).orderBy("k").collect()
    x = np.array([r.embedding for r in emb.collect()], dtype=float)
    ev = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1]
    assert np.allclose([r.explained_variance for r in got], ev / ev.sum(), atol=1e-8)


def test_correlation_matrix_matches_numpy(spark):
    from confluo.operators.pca import correlation_matrix
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = {(r.column_a, r.column_b): r.corr for r in correlation_matrix(li, cols).collect()}
    x = np.array([[r[c] for c in cols] for r in li.select(*cols).collect()])
    c = np.corrcoef(x, rowvar=False)
    assert len(got) == 6
    for (a, b), r in got.items():
        assert abs(r - c[cols.index(a), cols.index(b)]) < 1e-9


def test_hash_sample_without_keys_uses_whole_row(spark):
    df = spark.createDataFrame([(str(i), "x") for i in range(2000)], "a string, b string")
    a = {r.a for r in hash_sample(df, None, 0.2).collect()}
    b = {r.a for r in hash_sample(df.repartition(3), ["a", "b"], 0.2).collect()}
    assert a == b and 300 < len(a) < 500


def test_bernoulli_sample_goes_by_a_rows_place(spark, tmp_path):
    from confluo.operators.sampling import bernoulli_sample
    path = str(tmp_path / "t.parquet")
    # equal rows: each has its own chance
    spark.range(20_000).selectExpr("1 as v").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    n = bernoulli_sample(df, 0.1, 5).count()
    assert abs(n - 2000) < 5 * (20_000 * 0.09) ** 0.5
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # other splits, the same rows
    assert bernoulli_sample(spark.read.parquet(path), 0.1, 5).count() == n
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert bernoulli_sample(df, 0.1, 6).count() != n and bernoulli_sample(df, 1.0).count() == 20_000
    assert bernoulli_sample(df, 0.1, 5).columns == ["v"]


def test_bernoulli_sample_of_other_rows(spark):
    from confluo.operators.sampling import bernoulli_sample
    df = spark.range(5000).selectExpr("'f' as file", "id as row")
    by_place = bernoulli_sample(df, 0.2, 1, place=["file", "row"])
    assert sorted(r.row for r in by_place.collect()) == sorted(r.row for r in bernoulli_sample(df.repartition(7), 0.2, 1, ["file", "row"]).collect())
    assert 0 < bernoulli_sample(df, 0.2, 1).count() < 5000  # no file: Spark's own sample


def test_pca_of_an_empty_table(spark):
    from confluo.operators.pca import pca_variance
    assert pca_variance(spark.createDataFrame([], "a double, b double"), ["a", "b"]).count() == 0
    assert pca_variance(spark.createDataFrame([], "v array<double>"), vector_col="v").count() == 0
