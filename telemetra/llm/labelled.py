"""Bounded samples of labelled documents, and the held-out rule the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import stored


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def present(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``labels`` whose document is among ``docs``; sample and class share are taken from these."""
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    return stored(labels.select("doc_id", label).join(ids, "doc_id", "left_semi"), "labels-present")


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``y`` of up to ``per_class`` labelled documents of each class.

    Only ids whose remainder is not ``held``; ids in hash order, so the sample does not
    depend on partitioning. Ids with null or contradicting labels are left out. The ids
    chosen number 2 * ``per_class`` at most, so joining them is a bounded broadcast.
    """
    ids = (labels.where(F.col(label).isin(0, 1)).where(remainder(F.col("doc_id"), mod) != held)
           .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max")).where("y = y_max"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = [ids.where(F.col("y") == y).orderBy(*order).limit(per_class).select(F.col("doc_id").alias("lab_id"), "y")
              for y in (0, 1)]
    sample = chosen[0].union(chosen[1])
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.join(F.broadcast(sample), src.doc_id == sample.lab_id).select("doc_id", "text", "y")


def cut_level(s: np.ndarray, y: np.ndarray, prior: float) -> float:
    """Quantile level of the scores ``s`` that misjudges least, each class counted at its share
    (``prior`` is that of label 1); the middle of the best levels."""
    weight = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1))
    order = np.argsort(s, kind="stable")
    # misjudged weight when the cut lies below the k-th score: label 1 under it, label 0 from it on
    ones, zeros = np.where(y[order] == 1, weight[order], 0), np.where(y[order] == 0, weight[order], 0)
    wrong = np.append(0, np.cumsum(ones)) + np.append(np.cumsum(zeros[::-1])[::-1], 0)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(np.clip((best[0] + best[-1]) / 2 - 0.5, 0, len(s) - 1)) / max(len(s) - 1, 1)


def class_share(labels: DataFrame, label: str, mod: int, held: int) -> float:
    """Share of label 1 among the rows learned from."""
    ones, rows = labels.where(F.col(label).isin(0, 1)).where(remainder(F.col("doc_id"), mod) != held).agg(
        F.sum(F.col(label)), F.count("*")).first()
    return (ones or 0) / max(rows, 1)
