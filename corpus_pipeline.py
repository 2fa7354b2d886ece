"""A training-corpus pipeline over ``documents``.

Each stage reads all that its predecessor kept (written as parquet and read
again) and, but for the last, returns the columns of ``documents``:

1. toxicity: documents that the classifier calls toxic go;
2. ngram_join: of each group of near copies (word five-grams, similarity 0.8 or
   more) the document with the smallest id stays;
3. decontamination: documents holding a window of a benchmark item go;
4. mixing: the rows are laid out in the order of the source mix;
5. sharding: every row's shard, by jump consistent hashing, and its slot there in
   the order of the mix: each shard, read by slot, is a part of the mix in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import toxicity
from confluo.llm.common import table, written, written_order
from confluo.llm.decontaminate import decontaminated
from confluo.llm.mixing import mixed
from confluo.llm.ngram_join import without_near_copies
from confluo.llm.queries import SHARDS, toxicity_weights
from confluo.llm.sharding import shard_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from ``labels``, scores below 0.5.

    Null and empty texts are scored like any other.  Where labels teach nothing
    every document stays.  Columns keep their names and order.
    """
    weights = toxicity_weights(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(weights, F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id.

    Documents without words are no copies of anything and stay; rows repeated
    whole leave one.
    """
    return without_near_copies(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item; null and empty texts stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, laid out in the order of the source mix; a null source is a source of its own."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard for every row and its slot there, in the order that the rows of
    ``docs`` have in its files; null ids are one key, a null text has no bytes."""
    return shard_rows(docs, SHARDS, place=written_order(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Training and components have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per document that stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
