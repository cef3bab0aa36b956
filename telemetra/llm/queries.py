"""The registered queries of the corpus operators and, where SQL can state them, their oracle SQL.

Each query applies its operator with its default (production) parameters to the
whole table and derives the digest columns of the result from what it returns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from telemetra.llm import (filter_audit, license_scan, line_dedup, line_rules, neighbours, packing, quality, sharding, simhash,
                           token_alignment, tokens, toxicity, warc)
from telemetra.llm.common import table
from telemetra.llm.oracle import ORACLE_SQL  # noqa: F401  (part of this module's contract)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [str(i).encode() for i in range(1 << 16)]

    def digests(texts: pa.Array) -> list[pa.Array]:
        ids = tokens.encode_arrow(texts)
        data = tokens.decode_arrow(ids)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        shas = [hashlib.sha256(b" ".join([names[i] for i in flat[a:b].tolist()])).hexdigest() for a, b in zip(ends, ends[1:])]
        return [pa.array(ends[1:] - ends[:-1]), pa.array(shas), pa.array([hashlib.sha256(d.as_py()).hexdigest() for d in data])]

    return tokens.map_batches(table(spark, sf_dir, "documents"), "doc_id", "text", [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType())], digests)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"))
    digest = parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rules.annotate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *line_rules.METRICS, "base_failed", "kept", "removed_words")


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, count_col="lines_removed")


@query
def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard(docs, ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read(spark, warc.write(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))[0]


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(table(spark, sf_dir, "documents")))
