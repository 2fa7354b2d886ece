"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import toxicity
from confluo.llm.common import table
from confluo.llm.decontaminate import contamination
from confluo.llm.exact_dedup import exact_dedup
from confluo.llm.fingerprints import as_text, edited_neighbours
from confluo.llm.licenses import scan_licenses
from confluo.llm.merkle import fold, leaf_digest, merkle_proofs, path_digest
from confluo.llm.mixing import mix_sources
from confluo.llm.ngram_join import jaccard_components
from confluo.llm.passages import near_duplicate_passages
from confluo.llm.pii import find_pii
from confluo.llm.sharding import shard_rows
from confluo.llm.suffix_dedup import suffix_dedup
from confluo.llm.variants import spelling_variants

#: The number of shards of the sharding query and the pipeline.
SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def is_held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_weights(docs: DataFrame, labels: DataFrame) -> dict[int | None, float]:
    """The classifier of the query and the pipeline, from rows not held out."""
    return toxicity.fit(docs.where(~is_held_out("doc_id")), labels.where(~is_held_out("doc_id")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity_weights(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), toxicity.score(weights, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # passages of fifty words, whose first and last may be joined to other text
    return near_duplicate_passages(table(spark, sf_dir, "documents"), least_words=48)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    # what a verifier is shown: of every second document by hash, a text without its line ends
    damaged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(damaged, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = merkle_proofs(docs, columns=columns, carry={
        "shown_leaf": leaf_digest([shown if c == "text" else F.col(c) for c in columns])})
    out = proofs.withColumn("folded_root", fold(F.col("shown_leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, damage=199)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_neighbours(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("samples")).alias("fingerprint"),
                      as_text(F.col("edited_samples")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_licenses, op3_mixing, op4_toxicity, op5_ngram_join, op6_exact_dedup,
        op7_suffix_dedup, op8_pii, op9_passages, op10_decontamination, op11_merkle,
        op12_variants, op13_fingerprints)
}
