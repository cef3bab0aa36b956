"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.plans.storage import job_path

# ASCII white space that separates words in every word-level operator
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage so that a lost executor re-reads files instead of recomputing,
    and gives later plans measured sizes and no inherited partitioning (a join on
    the result can be split by AQE when a key is hot).
    """
    spark = df.sparkSession
    path = job_path(spark, "llm", label, unique=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """Hash that tells apart rows of the same id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column, tx: Column) -> list[Column]:
    """Null-free equality key of a row: its id, whether that is null, and its text's hash."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias("key_id"), doc_id.isNull().alias("key_null"),
            tx.alias("key_text")]


KEY = ["key_id", "key_null", "key_text"]


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")


def with_column(columns: list[str], row: str, **replaced: Column) -> list[Column]:
    """The columns packed in struct ``row``, in order, some replaced."""
    return [(replaced[c] if c in replaced else F.col(row)[c]).alias(c) for c in columns]
