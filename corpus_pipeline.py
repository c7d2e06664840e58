"""From raw documents to shuffled shards: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns all of its documents; run() writes each
stage's result as Parquet into the shared folder and reads it again, so that a lost
executor costs one stage's tasks and not the lineage of all.

Defined cases: null, empty and very long texts pass every stage but those that their content concerns (texts without a word are never toxic,
duplicates or contaminated, and cost no tokens); rows equal in all columns are copies, of which near_duplicates keeps one; rows of one key and
different content are documents of their own; a null key or source is one as any other; other columns stay, those named as shards' columns are
replaced; empty tables give an empty result. Toxicity needs labels only to learn stems: without any, the seed lexicon decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import decontaminate, mixing, sharding, simhash, toxicity
from lexweave.llm.common import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those whose clauses score as toxic; the lexicon's stems come from the labelled documents."""
    stems = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, stems)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages of benchmark texts; a document that is nothing else goes."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budget buys at the sources' target weights."""
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with row_number, position, shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: SimHash groups and transducer scores have no SQL; a test runs all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
