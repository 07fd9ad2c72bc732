"""The corpus pipeline: each stage works on the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from corpusloom.llm.common import cleaned, remove, scratch, table

#: Part of the tokens that arrive at mixing which it may keep.
SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is predicted toxic. Learns from the labels of rows outside the held-out fold.

    Null and empty texts are clean. Repeated rows and null ids are judged by their text like any other; without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, Jaccard 0.8 or more): that with the smallest doc_id.

    Null, empty and blank texts are one group. Null ids stand behind all others; ties of an id go to the smaller digest
    of the text; rows that repeat id and text count once.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of whose words at least a twentieth stand in passages of the benchmark.

    Texts without words are clean; each row is judged by its own text, whatever its id; without items nothing goes.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps SHARE of the tokens that arrive, drawn by domain, language and source; nulls are values of their own.

    Rows that repeat id and text go together. Texts without words cost nothing.
    """
    return mixing.keep_mixed(docs, SHARE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows that arrive into a compacted store, and reads them back with their shard and version. All rows stay."""
    return sharding.sharded(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: Training a classifier and XXH64 fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage has made on the way, and the table that it read, are deleted once its own is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
