"""Audit of how document filters interact, over every order of applying them (operator 11).

A document's row of filter results is a mask: bit i is set when it fails the i-th
filter. Everything the audit asks depends on the mask alone, so documents are first
counted per (part, mask), with how many of them are good or toxic: at most 2^filters
cells a part, however hot the part. Each cell is then folded over the array of all
orders, a literal every task holds: ``transform`` takes the orders, ``aggregate`` walks
an order's filters and carries whether the cell's documents are still there, giving one
struct per order and step, weighted by the cell's counts. The arrays of a part's cells
are merged by elementwise sums, and Shapley totals are summed per filter.

``duplicate`` names the one filter that looks across documents: a text equal to that of
a smaller id, whatever its part. Texts meet as SHA-256, counted per hash before they are
joined, so copies cost one row per (text, part), not one per document.

Defined cases: null texts are empty (and equal to each other); null parts are the part
''; a null id is larger than all others, and rows with equal ids aren't copies of each
other; a document is good (toxic) if any label row of its id says 1, rows without a
label are neither. An empty table has no parts, so no rows. Other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import let, words_of

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 2,
                 symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """Filters A to D; true where the text fails. ``min_distinct`` and ``max_capitals`` are per cent."""
    def counts(t):
        return let(words_of(t), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))

    words = counts(text)
    return {
        "A": words["words"] < min_words,
        "B": 100 * words["distinct"].cast("long") < min_distinct * words["words"].cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > max_capitals * F.length(text).cast("long"),
        "D": text.rlike(symbols),
    }


def _masked(docs: DataFrame, labels: DataFrame, filters, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per (text, mask, part, labels, id): how many documents, ``mask`` without the duplicate bit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters(text).values())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), sum(bits[1:], bits[0]).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").alias("lab_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    # one join for every size: labels grow with the table
    joined = rows.join(marks.hint("merge"), rows.doc_id == marks.lab_id, "left")
    return joined.groupBy("doc_id", "same", "mask", "part", F.coalesce("q", F.lit(0)).alias("good"),
                          F.coalesce("t", F.lit(0)).alias("toxic")).agg(F.count("*").alias("rows"))


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """Per (part, mask): documents ``n``, and how many are ``good`` and ``toxic``; the duplicate bit is the last."""
    k = len(filters(F.lit("")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    keys = ["same", "mask", "part", "good", "toxic"]
    groups = _masked(docs, labels, filters, id_col, text_col, part_col).groupBy(*keys).agg(
        F.min(F.struct(order.alias("at"), F.col("rows"))).alias("least"), F.sum("rows").alias("rows"))
    first = groups.groupBy("same").agg(F.min("least.at").alias("first"))
    both = groups.join(first.hint("merge"), "same")
    # of a group of equal texts only the rows of the smallest id pass
    passing = F.when(F.col("least.at") == F.col("first"), F.col("least.rows")).otherwise(F.lit(0))
    split = both.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), passing.alias("n")),
        F.struct((F.col("mask") + (1 << k)).alias("mask"), (F.col("rows") - passing).alias("n")))).alias("c"))
    return split.where("c.n > 0").groupBy("part", "c.mask").agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"),
        F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def _fold(cell: Column, orders: Column) -> Column:
    """One struct per order and step: what the cell's documents add to each count."""
    zero = F.lit(0).cast("long")

    def step(state, bit):
        fails = cell["mask"].bitwiseAND(bit) != 0
        lost = state["here"] & fails
        row = F.struct(
            F.when(state["here"] & ~fails, cell["n"]).otherwise(zero).alias("kept"),
            F.when(lost, cell["n"]).otherwise(zero).alias("removed"),
            F.when(fails & ~state["here"], cell["n"]).otherwise(zero).alias("redundant"),
            F.when(cell["mask"] == bit, cell["n"]).otherwise(zero).alias("unique_fails"),
            F.when(lost, cell["good"]).otherwise(zero).alias("good_lost"),
            F.when(lost, cell["toxic"]).otherwise(zero).alias("toxic_lost"))
        return F.struct((state["here"] & ~fails).alias("here"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(True).alias("here"), F.array().cast(f"array<struct<{','.join(c + ':bigint' for c in COUNTS)}>>").alias("rows"))
    return F.flatten(F.transform(orders, lambda o: F.aggregate(o, start, step, lambda s: s["rows"])))


def _plus(a: Column, b: Column) -> Column:
    return F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, filters=text_filters, duplicate: str = "E", **columns) -> DataFrame:
    """Per part, ``filter_order`` (every permutation of the filters' names) and ``step`` (from 1):
    the counts after that step and the step's filter's ``shapley`` (its removals over all orders)."""
    names = [*filters(F.lit("")), duplicate]
    k, orders = len(names), list(permutations(range(len(names))))

    def constant(flat):
        return F.lit(np.array(flat, dtype="int32"))

    place = F.sequence(F.lit(0), F.lit(len(orders) - 1))
    steps = F.transform(place, lambda i: F.slice(constant([1 << b for o in orders for b in o]), i * k + 1, k))
    at = constant([b for o in orders for b in o])
    spelled = F.split(F.lit(" ".join("".join(names[b] for b in o) for o in orders)), " ")
    zeros = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), len(orders) * k)

    def removals(rows):
        """Per filter: what it removes over all orders."""
        return F.array(*(F.aggregate(F.zip_with(rows, at, lambda r, b: F.when(b == i, r["removed"]).otherwise(F.lit(0))),
                                     F.lit(0).cast("long"), lambda a, x: a + x) for i in range(k)))

    def named(rows):
        return let(removals(rows), lambda total: F.transform(rows, lambda r, i: F.struct(
            F.get(spelled, F.floor(i / k).cast("int")).alias("filter_order"), (i % k + 1).alias("step"),
            *(r[c].alias(c) for c in COUNTS), F.get(total, F.get(at, i)).alias("shapley"))))

    # a part has at most 2^filters cells
    parts = cells(docs, labels, filters, **columns).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    merged = F.aggregate("cells", zeros, lambda acc, c: F.zip_with(acc, _fold(c, steps), _plus))
    return parts.select("part", F.inline(let(merged, named)))
