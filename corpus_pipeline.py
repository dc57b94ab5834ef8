"""The corpus pipeline: quality rules, near-duplicates, decontamination,
personal data, packing. Each stage works on all that the one before it kept,
written as Parquet into the shared checkpoint folder and read again; what a
stage wrote on its way is deleted once its result is stored.

Defined results: null, empty and blank texts fail the quality rules and go;
rows that repeat an id stay apart as long as their texts do (near-duplicates
keep one row of each group, whatever the ids); a null id is kept like any other;
columns beside those of documents pass through all stages but the last; an
empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import decontaminate, packing, pii, quality_rules, simhash
from vitrine.llm.common import scratch, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data and disclosing terms replaced."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Expectation-maximisation, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), STAGES[-1][1]
    with scratch(spark) as done:
        for _, stage in STAGES[:-1]:
            with scratch(spark) as made:
                docs = stash(stage(spark, docs, sf_dir), "pipeline")
                done.append(made.pop())
        # the last stage's own tables are read when its result is
        with scratch(spark) as made:
            out = last(spark, docs, sf_dir)
            made.clear()
        done.pop()
    return out
