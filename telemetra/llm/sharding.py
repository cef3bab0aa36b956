"""Sharding by a hypergeometric communication matrix (operator 3). DataFrame functions only.

A uniform random permutation of all rows, cut into shards of exact size (counts at
most one apart), without a global sort:

1. rows fall into source partitions by a hash and are permuted inside each;
2. the communication matrix says how many rows each source sends to each shard. It
   is drawn exactly: given the source sizes and shard sizes, a uniform permutation
   has multivariate hypergeometric rows, drawn one entry at a time;
3. the first entries of each permuted source go to shard 0, the next to shard 1, and
   so on: the exchange;
4. every shard is permuted again by a fresh hash, cell by cell (a cell is a range of
   hash values), which numbers its slots without gaps.

Sources and cells hold about ``CELL_ROWS`` rows each, so tasks stay equal at any
size. The driver holds the matrix only: one row of ``shards`` counts per source.
The rows are written once with a number each; every later step is a function of
them and ``seed``, so a lost executor's work is redone alike.

Defined cases: rows are spread by id and text hash together; rows that repeat
both are told apart by their place among equals, so a text or null id that fills
a third of the table spreads like any other. Null text has no bytes. Extra columns
pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import stored

CELL_ROWS = 20_000
SEED = 42


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    lg = math.lgamma

    def log_choose(n, k):
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u, down, up, pd, pu = rng.random() - p, mode, mode, p, p
    while u > 0 and (down > low or up < high):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def matrix(sources: list[int], shards: list[int], seed: int = SEED) -> Iterator[list[int]]:
    """Rows of the communication matrix: counts from each source to each shard."""
    rng, left = random.Random(seed), list(shards)
    for size in sources:
        row, rest, draws = [], sum(left), size
        for free in left:
            rest -= free
            row.append(hypergeometric(rng, free, rest, draws) if draws else 0)
            draws -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        yield row


def _unit(h: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges of hash values ``h`` is in."""
    return F.floor(F.shiftrightunsigned(h, 32) * F.lit(parts) / F.lit(float(1 << 32))).cast("int")


def shard(df: DataFrame, keys: list[str], shards: int = 8, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``keys`` are the columns that identify a row; rows equal in all of them are interchangeable.
    """
    spark = df.sparkSession
    # the rows are fixed on disk with a number each, so every later step sees the same ones
    rows = stored(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("no"),
                            F.xxhash64(F.lit(seed), *keys).alias("key")), "shard-rows")
    narrow = rows.select("no", F.xxhash64("key", "no").alias("h"))
    total = narrow.count()
    parts = max(1, -(-total // cell_rows))
    sized = narrow.withColumn("source", _unit(F.col("h"), parts))
    counts = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row per source
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(counts)
    sends = [(src, s, sum(row[:s]), sum(row[:s + 1])) for src, row in zip(order, matrix([counts[x] for x in order], sizes, seed))
             for s in range(shards) if row[s]]
    plan = spark.createDataFrame(sends, "source int, shard int, low long, high long")

    # permute inside each source, and exchange by the matrix
    rank = F.row_number().over(Window.partitionBy("source").orderBy("h", "no")) - 1
    ranked = sized.select("no", "source", F.xxhash64(F.lit(seed + 1), "h").alias("h2"), rank.alias("rank"))
    by_source = plan.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("high", "shard"))).alias("sends"))
    sent = ranked.join(by_source, "source").select("no", "h2", F.filter("sends", lambda x: x["high"] > F.col("rank"))[0]["shard"].alias("shard"))

    # permute inside each shard, cell by cell
    cells = max(1, -(-total // (shards * cell_rows)))
    placed = stored(sent.withColumn("cell", _unit(F.col("h2"), cells)), "shard-cells")
    counted = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = counted.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    slots = placed.join(starts, ["shard", "cell"]).select(
        "no", "shard", (F.col("start") + F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h2", "no")) - 1).alias("slot"))
    return rows.join(slots, "no").select("row.*", "shard", "slot")


def write(df: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Rows of :func:`shard` as Parquet, a folder per shard, in slot order."""
    span = F.floor(F.col("slot") * files_per_shard / F.greatest(F.max("slot").over(Window.partitionBy("shard")) + 1, F.lit(1)))
    out = df.withColumn("span", span) if files_per_shard > 1 else df.withColumn("span", F.lit(0))
    out.repartition("shard", "span").sortWithinPartitions("shard", "slot").drop("span").write.partitionBy("shard").parquet(path)
