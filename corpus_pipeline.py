"""From documents to token ids: quality, toxicity, near duplicates, mixture, encoding.

Every stage works on all that the one before it kept, written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.llm import bpe, minhash, mixing, quality, toxicity
from garderobe.session import prepare, stage

USED = ("doc_id", "text", "lang", "source")


def through(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies an operator while all columns that it does not use go by names of their own, so that they cannot clash with columns it makes."""
    own = {c: f"_own_column_{i}" for i, c in enumerate(docs.columns) if c not in USED}
    return operator(docs.withColumnsRenamed(own)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers in their language and source.

    A null text fails the base rules; null languages and sources are groups of their own; repeated rows are judged alike and stay or go
    together. An empty table gives an empty result; all columns are kept, whatever their names.
    """
    prepare(spark)
    return through(docs, lambda d: quality.judged(d).filter("kept"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut; the machine is learned from labels of the documents given.

    A null text scores as an empty one; equal texts score alike; a null ``doc_id`` has no label. An empty table gives an empty result; all
    columns are kept, whatever their names.
    """
    prepare(spark)
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return through(docs, lambda d: toxicity.with_score(d, machine, "_toxicity").filter(F.col("_toxicity") < toxicity.CUT))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.

    Texts without a word are linked with nothing and stay; of rows that repeat one document one stays. An empty table gives an empty
    result; all columns are kept, whatever their names.
    """
    prepare(spark)
    return through(docs, minhash.one_of_each)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null text has no words and is placed like the others; a null source is a source; repeated rows are taken one by one. An empty
    table gives an empty result; all columns are kept, whatever their names.
    """
    sized = lambda d: d.withColumn("_words", mixing.size_in_words(F.col("text")))
    return through(docs, lambda d: mixing.repeated(mixing.mix(sized(d), "_words")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, with the digests of ids and decoded text.

    A null or empty text has no tokens; repeated rows give a row each; other columns are left out. An empty table gives an empty result.
    """
    prepare(spark)
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("toxicity", without_toxic), ("MinHash near-dedup", without_copies), ("mixing sources to target weights", mixture), ("BPE encoding and decoding", encoded)]
ORACLE_SQL = None  # estimates, a learned model and sketches are beyond SQL; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
