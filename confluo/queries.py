"""The registered queries over the driver's parquet tables (see __spark_entry__)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.operators import quality as Q
from confluo.operators.align import align_union
from confluo.operators.homogenize import homogenize
from confluo.operators.names import factored_recommendations, name_pairs, name_recommendations, similar_name_groups
from confluo.operators.pca import pca_variance
from confluo.operators.profile import pattern_conformance, value_shapes
from confluo.operators.sampling import bernoulli_sample, hash_sample
from confluo.operators.values import column_similarity
from confluo.functions.text import normalize_text
from confluo.session import run_concurrently, scratch_path
from confluo.sources.catalogue import header_catalogue
from confluo.plans.homogenize import combine_session, homogenize_session
from confluo.plans.recommend import recommend_names, recommend_values
from confluo.plans.session import preview_file, report_for_file
from confluo.sources.csv import find_file, list_csv_files, read_csv
from confluo.sources.headers import session_headers
from confluo.sources.records import scan_csv
from confluo.sources.sinks import preview, write_csv, write_csv_file

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The flagship mapping: one list of every named thing with a balance and a category.
FLAGSHIP_MAPPING = {
    "name": {"customer": ["c_name"], "supplier": ["s_name"], "part": ["p_brand", "p_name"]},
    "balance": {"customer": ["c_acctbal"], "supplier": ["s_acctbal"], "part": ["p_retailprice"]},
    "category": {"customer": ["c_mktsegment"], "part": ["p_type"]},
}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
FENCE_TARGETS = [("events", ["value"]), ("documents", ["n_chars"]), ("lineitem", LINEITEM_NUMERIC)]
HISTOGRAM_TARGETS = [("lineitem", ["l_quantity"]), ("events", ["value"])]

TEXT_COLUMNS = {
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "customer": ["c_name", "c_mktsegment"],
    "documents": ["text", "lang", "source"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
    "events": ["event_type", "props"],
}
NORMALIZED_TEXT_COLUMNS = {"documents": ["text"], "benchmark": ["text"], "conversations": ["text"]}
SHAPE_TARGETS = [("part", ["p_brand"]), ("orders", ["o_orderpriority"]), ("customer", ["c_name"]),
                 ("pages", ["url"])]
# Wide comparison: every column of these, as Spark writes it.
WIDE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark",
               "labels", "conversations"]
PCA_LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tables(spark, sf_dir, names):
    """The named tables; their schema reads (one small job each) overlap."""
    return dict(zip(names, run_concurrently(lambda n: load(spark, sf_dir, n), list(names))))


def q_align_union(spark, sf_dir):
    return align_union(_tables(spark, sf_dir, ["customer", "supplier"]))


def q_homogenize(spark, sf_dir):
    return homogenize(_tables(spark, sf_dir, ["customer", "supplier", "part"]), FLAGSHIP_MAPPING)


def q_homogenize_with_source(spark, sf_dir):
    return homogenize(_tables(spark, sf_dir, ["customer", "supplier", "part"]), FLAGSHIP_MAPPING,
                      source_col="source_file")


def q_header_catalogue(spark, sf_dir):
    return header_catalogue(spark, _tables(spark, sf_dir, TABLES))


def q_null_profile(spark, sf_dir):
    return Q.null_profile(q_align_union(spark, sf_dir))


def q_null_profile_combined(spark, sf_dir):
    return Q.null_profile(q_homogenize(spark, sf_dir))


def q_numeric_columns(spark, sf_dir):
    orders = Q.castable_counts(Q.as_string_table(load(spark, sf_dir, "orders")))
    combined = Q.castable_counts(q_homogenize(spark, sf_dir))
    return (orders.select(F.lit("orders").alias("table"), "*")
            .unionByName(combined.select(F.lit("combined").alias("table"), "*")))


def q_categorical_columns(spark, sf_dir):
    return Q.categorical_columns(Q.as_string_table(load(spark, sf_dir, "part")))


def _per_table(spark, sf_dir, targets, fn):
    """One result per table, labelled and unioned; the tables' eager
    statistics jobs run concurrently (they are independent)."""
    def build(target):
        t, cols = target
        return fn(load(spark, sf_dir, t), cols).select(F.lit(t).alias("table"), "*")
    parts = run_concurrently(build, targets)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_final_report_outliers(spark, sf_dir):
    """The report of the combined table (E3), exact fences: its outlier section."""
    from confluo.plans.report import final_report
    return final_report(q_homogenize(spark, sf_dir), exact=True)["outliers"]


def q_iqr_fences(spark, sf_dir):
    return _per_table(spark, sf_dir, FENCE_TARGETS, lambda df, cols: Q.iqr_fences(df, cols, exact=True))


def q_iqr_fences_approx(spark, sf_dir):
    """The approximate quartiles, checked: whether each one's rank is within the
    relative error of its target."""
    def check(df, cols):
        stats = Q.fence_stats(df, cols, exact=False)
        targets = [(c, p, stats[c][i]) for c in cols for i, p in enumerate((0.25, 0.75))]
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) < q).alias(f"b{i}") for i, (c, _, q) in enumerate(targets)],
                     *[F.count_if(F.col(c) <= q).alias(f"u{i}") for i, (c, _, q) in enumerate(targets)])
        cells = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("p"),
                          ((F.col(f"b{i}") / F.col("n") <= p + Q.RELATIVE_ERROR)
                           & (F.col(f"u{i}") / F.col("n") >= p - Q.RELATIVE_ERROR)).alias("within"))
                 for i, (c, p, _) in enumerate(targets)]
        return row.select(F.inline(F.array(*cells)))
    return _per_table(spark, sf_dir, [("lineitem", LINEITEM_NUMERIC)], check)


def q_iqr_outliers(spark, sf_dir):
    return Q.iqr_outliers(load(spark, sf_dir, "events"), "value", exact=True)


def q_outlier_report(spark, sf_dir):
    return _per_table(spark, sf_dir, FENCE_TARGETS, lambda df, cols: Q.outlier_report(df, cols, exact=True))


def q_histogram(spark, sf_dir):
    return _per_table(spark, sf_dir, HISTOGRAM_TARGETS, lambda df, cols: Q.histogram(df, cols, exact=True))


def q_column_tfidf(spark, sf_dir):
    sims = column_similarity(_tables(spark, sf_dir, list(TEXT_COLUMNS)), TEXT_COLUMNS, 0.8)
    return sims.withColumn("similarity", F.round("similarity", 6))


def q_column_tfidf_normalized(spark, sf_dir):
    sims = column_similarity(_tables(spark, sf_dir, list(NORMALIZED_TEXT_COLUMNS)),
                             NORMALIZED_TEXT_COLUMNS, 0.8, normalize=True)
    return sims.withColumn("similarity", F.round("similarity", 6))


def _catalogue(spark, sf_dir):
    return header_catalogue(spark, _tables(spark, sf_dir, TABLES))


def q_name_pairs(spark, sf_dir):
    return name_pairs(_catalogue(spark, sf_dir), 80).select(
        "file_l", "column_l", "file_r", "column_r", F.col("score").cast("int").alias("score"))


def q_name_recommendations(spark, sf_dir):
    return name_recommendations(_catalogue(spark, sf_dir), 90)


def q_name_recommendations_factored(spark, sf_dir):
    """One row a column and file on the right, and one for a name that several files have."""
    rows = factored_recommendations(_catalogue(spark, sf_dir), 90)
    names = lambda xs, f: F.array_join(F.transform(xs, lambda x: x[f]), ",")
    return rows.select("column", "kind", "file_right", names("files", "file").alias("files"), names("similar", "column").alias("similar"))


def q_similar_name_groups(spark, sf_dir):
    return similar_name_groups(_catalogue(spark, sf_dir), 80)


def q_normalize_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("text_norm"))


def q_normalize_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", normalize_text(F.col("html")).alias("html_norm"))


def q_value_shapes(spark, sf_dir):
    return _per_table(spark, sf_dir, SHAPE_TARGETS, value_shapes)


def q_pattern_conformance(spark, sf_dir):
    def conf(df, cols):
        return pattern_conformance(df, None, cols).select(
            "column", "shape", "n_values", "n_match", F.round("match_rate", 6).alias("match_rate"))
    return _per_table(spark, sf_dir, SHAPE_TARGETS, conf)


def q_sample_hash(spark, sf_dir):
    return hash_sample(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_sample_bernoulli(spark, sf_dir):
    return bernoulli_sample(load(spark, sf_dir, "lineitem"))


def _rounded_curve(curve):
    return curve.select("k", F.round("explained_variance", 6).alias("explained_variance"),
                        F.round("cumulative_variance", 6).alias("cumulative_variance"))


def q_pca_variance(spark, sf_dir):
    return _rounded_curve(pca_variance(load(spark, sf_dir, "lineitem"), PCA_LINEITEM, standardize=True))


def q_pca_correlation(spark, sf_dir):
    from confluo.operators.pca import correlation_matrix
    corr = correlation_matrix(load(spark, sf_dir, "lineitem"), PCA_LINEITEM)
    return corr.withColumn("corr", F.round("corr", 9))


def q_pca_variance_embeddings(spark, sf_dir):
    return _rounded_curve(pca_variance(load(spark, sf_dir, "embeddings"), vector_col="embedding", standardize=False))


def q_csv_round_trip(spark, sf_dir):
    path = write_csv(load(spark, sf_dir, "customer"), scratch_path(spark, "customer-csv"))
    return read_csv(spark, path, multi_line=True)


def q_csv_quote_all(spark, sf_dir):
    path = write_csv(load(spark, sf_dir, "customer"), scratch_path(spark, "customer-qcsv"), quote_all=True)
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith('"c_custkey"')).select(F.col("value").alias("line"))


def q_distinct_headers(spark, sf_dir):
    from confluo.sources.catalogue import distinct_headers
    return distinct_headers(_catalogue(spark, sf_dir))


def q_csv_multiline_documents(spark, sf_dir):
    """Whole document texts (with newlines and quotes) through CSV and back."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_csv(spark, write_csv_file(docs, scratch_path(spark, "documents.csv")))


def q_csv_single_line(spark, sf_dir):
    path = write_csv(load(spark, sf_dir, "supplier"), scratch_path(spark, "supplier-csv"))
    return read_csv(spark, path, multi_line=False)


# One session of CSV files made of the tables: a name with a blank, one that
# looks like a combined output.
SESSION_FILES = {"customer": "customer list.csv", "supplier": "supplier_combined.csv", "part": "part.csv"}
SESSION_MAPPING = {m: {SESSION_FILES[t]: cols for t, cols in files.items()} for m, files in FLAGSHIP_MAPPING.items()}


def _session(spark, sf_dir):
    root = scratch_path(spark, "session")
    for t, file in SESSION_FILES.items():
        write_csv_file(load(spark, sf_dir, t), f"{root}/{file}")
    return root


def q_session_files(spark, sf_dir):
    root = _session(spark, sf_dir)
    one = find_file(spark, root, "list.csv")
    return list_csv_files(spark, root, recursive=True).select(
        F.url_decode("file").alias("file"), (F.col("path") == F.lit(one)).alias("found"))


def q_session_columns(spark, sf_dir):
    return session_headers(spark, _session(spark, sf_dir))


def q_session_homogenize(spark, sf_dir):
    return combine_session(spark, _session(spark, sf_dir), SESSION_MAPPING, source_col="source_file")


def q_session_homogenize_row_id(spark, sf_dir):
    combined = combine_session(spark, _session(spark, sf_dir), SESSION_MAPPING, source_col="source_file", row_id_col="row_id")
    return combined.repartition("name").select("source_file", "row_id", "name")


def q_session_recommend_names(spark, sf_dir):
    return recommend_names(spark, _session(spark, sf_dir), 70)


def q_session_recommend_values(spark, sf_dir):
    sims = recommend_values(spark, _session(spark, sf_dir), 0.3)
    return sims.withColumn("similarity", F.round("similarity", 6))


def _session_report(spark, sf_dir, section):
    out = homogenize_session(spark, _session(spark, sf_dir), SESSION_MAPPING, scratch_path(spark, "combined"), fmt="csv")
    return report_for_file(spark, out, exact=True)[section]


def q_session_report_nulls(spark, sf_dir):
    return _session_report(spark, sf_dir, "nulls")


def q_session_report_histogram(spark, sf_dir):
    return _session_report(spark, sf_dir, "histogram")


def q_session_preview_records(spark, sf_dir):
    return preview_file(spark, f"{_session(spark, sf_dir)}/{SESSION_FILES['supplier']}")


def q_align_union_case(spark, sf_dir):
    """Headers that differ only in case are one column."""
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("KEY"), F.col("c_name").alias("Name"))
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("NAME"), F.col("s_acctbal").alias("bal"),
                                                      F.col("s_suppkey").alias("key"))
    return align_union({"customer": customer, "supplier": supplier}, merge_case=True)


def _with_infinity(spark, sf_dir):
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).when(F.col("event_id") % 101 == 0, F.lit(float("-inf")))
    v = v.when(F.col("event_id") % 103 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", v.alias("value"))


def q_histogram_infinity(spark, sf_dir):
    return Q.histogram(_with_infinity(spark, sf_dir), ["value"], exact=True)


def q_non_finite_counts(spark, sf_dir):
    return Q.non_finite_counts(_with_infinity(spark, sf_dir), ["value"])


def q_pattern_conformance_newline(spark, sf_dir):
    """A value that ends in a newline is not of the shape without it."""
    brand = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("\n"))).otherwise(F.col("p_brand"))
    out = pattern_conformance(load(spark, sf_dir, "part").select(brand.alias("brand")), None, ["brand"])
    return out.select("column", "shape", "n_values", "n_match")


def q_column_tfidf_wide(spark, sf_dir):
    """More than fifty compared columns: all of the tables, numbers and timestamps as text."""
    tables = {t: Q.as_string_table(load(spark, sf_dir, t)) for t in WIDE_TABLES}
    return column_similarity(tables, threshold=0.5).withColumn("similarity", F.round("similarity", 6))


def q_preview(spark, sf_dir):
    return preview(load(spark, sf_dir, "customer"), 10, ["c_custkey"])


QUERIES = {
    "session_files": q_session_files,
    "session_columns": q_session_columns,
    "session_homogenize": q_session_homogenize,
    "session_homogenize_row_id": q_session_homogenize_row_id,
    "session_recommend_names": q_session_recommend_names,
    "session_recommend_values": q_session_recommend_values,
    "session_report_nulls": q_session_report_nulls,
    "session_report_histogram": q_session_report_histogram,
    "session_preview_records": q_session_preview_records,
    "align_union_case": q_align_union_case,
    "histogram_infinity": q_histogram_infinity,
    "non_finite_counts": q_non_finite_counts,
    "pattern_conformance_newline": q_pattern_conformance_newline,
    "column_tfidf_wide": q_column_tfidf_wide,
    "align_union": q_align_union,
    "homogenize": q_homogenize,
    "homogenize_with_source": q_homogenize_with_source,
    "header_catalogue": q_header_catalogue,
    "null_profile": q_null_profile,
    "null_profile_combined": q_null_profile_combined,
    "numeric_columns": q_numeric_columns,
    "categorical_columns": q_categorical_columns,
    "iqr_fences": q_iqr_fences,
    "final_report_outliers": q_final_report_outliers,
    "iqr_fences_approx": q_iqr_fences_approx,
    "iqr_outliers": q_iqr_outliers,
    "outlier_report": q_outlier_report,
    "histogram": q_histogram,
    "column_tfidf": q_column_tfidf,
    "column_tfidf_normalized": q_column_tfidf_normalized,
    "name_pairs": q_name_pairs,
    "name_recommendations": q_name_recommendations,
    "name_recommendations_factored": q_name_recommendations_factored,
    "similar_name_groups": q_similar_name_groups,
    "normalize_text": q_normalize_text,
    "normalize_pages": q_normalize_pages,
    "value_shapes": q_value_shapes,
    "pattern_conformance": q_pattern_conformance,
    "sample_hash": q_sample_hash,
    "sample_bernoulli": q_sample_bernoulli,
    "pca_variance": q_pca_variance,
    "pca_variance_embeddings": q_pca_variance_embeddings,
    "pca_correlation": q_pca_correlation,
    "csv_round_trip": q_csv_round_trip,
    "csv_quote_all": q_csv_quote_all,
    "preview": q_preview,
    "distinct_headers": q_distinct_headers,
    "csv_multiline_documents": q_csv_multiline_documents,
    "csv_single_line": q_csv_single_line,
}
