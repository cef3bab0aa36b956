"""The corpus pipeline: rules, quality, line dedup, near-duplicates, packing.

Each stage reads all its predecessor kept and passes on the columns of documents;
the last returns the packing. ``run`` writes every stage as Parquet in the shared
folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import line_dedup, line_rules, packing, quality, simhash
from telemetra.llm.common import stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their over-frequent lines."""
    return line_rules.apply(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier, learned from the labelled ones among them, predicts 1 for."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one."""
    return line_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: 3-word shingles, 3 bits."""
    return simhash.keep_one(docs, words=3, max_bits=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    parts = packing.pieces(docs)
    return packing.pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality rules", rules), ("quality classifier", classify), ("line dedup", lines),
          ("SimHash near-dedup", near), ("best-fit packing", pack)]

# a fitted classifier and local search are no SQL; tests hold single stages to SQL or brute force, none run() as a whole
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
