"""SimHash near-duplicates by pigeonhole blocks (operator 10).

A document's fingerprint has bit b set if b is set in more than half of its
shingle hashes. Two fingerprints link when they differ in at most ``max_bits``
bits. With ``max_bits`` = 3 and five blocks, a linked pair agrees on at least two
whole blocks, so a join on each of the ten block pairs finds every link; the
Hamming distance is then verified. Copies collapse to one fingerprint first.

A block value shared by more than ``CHUNK`` fingerprints is compared in pairs of
chunks, one chunk pair per group of rows, and each group returns a spanning
forest of its links instead of the links, so output is linear in the rows
compared while no connection is lost. Components follow by alternating star
contraction on tables in the shared folder; nothing is gathered on the driver
but one count and checksum per round.

Defined cases: null or wordless text has fingerprint zero, which links like any
other; repeated rows are copies of each other; null ids are ignored by the
smallest id (null if a component has no other). Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from telemetra.llm.common import KEY, packed, row_key, stored, text_key

SEED = 42
CHUNK = 512           # fingerprints of one block value compared at once
UNPACK = 1 << 16      # shingle hashes unpacked to bits at once


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of one text (UTF-8), as an unsigned integer."""
    toks = (text or b"").lower().split()      # bytes: A-Z and \x20 \x09-\x0D only
    if not toks:
        return 0
    if len(toks) > words:
        shingles = map(b" ".join, zip(*(toks[i:] for i in range(words))))
    else:
        shingles = iter((b" ".join(toks),))
    total, ones = max(len(toks) - words + 1, 1), np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, total)
    for i in range(0, total, UNPACK):
        bits = np.unpackbits(hashes[i:i + UNPACK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``df``: ``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long)."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = StructType([src.schema["doc_id"], StructField("fp", LongType())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(run, out)


def _masks(max_bits: int, blocks: int) -> list[int]:
    """Bit masks of the block combinations of which a linked pair shares one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(block, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fps``."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    todo, edges = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            u = stack.pop()
            new = np.flatnonzero(near[u] & todo)
            todo[new] = False
            edges.extend((u, v) for v in new)
            stack.extend(new)
    return edges


def links(fps: DataFrame, max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """Links ``(a, b)`` that connect every two of the distinct fingerprints ``fps.fp`` within reach."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
              for t, m in enumerate(_masks(max_bits, blocks))]
    keys = fps.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", "b.t", "b.k")
    shared = stored(keys.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-blocks")
    # chunk pairs (lo, hi): one pair for a block of up to CHUNK fingerprints
    chunks = F.ceil(F.col("n") / CHUNK)
    own = F.pmod(F.xxhash64("fp"), chunks)
    cand = (keys.join(shared, ["t", "k"]).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
            .select("t", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp"))

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            n = len(cols[0])
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            starts = np.concatenate(([0], np.flatnonzero(change), ))
            for s, e in zip(starts[:-1], starts[1:]):
                yield from emit(cols[4][s:e])
            rest = [c[starts[-1]:] for c in cols]
        if rest is not None:
            yield from emit(rest[4])

    def emit(group):
        fp = group.astype(np.int64).view(np.uint64)
        if len(fp) == 2:
            edges = [(0, 1)] if int(fp[0] ^ fp[1]).bit_count() <= max_bits else []
        else:
            edges = _forest(fp, max_bits) if len(fp) > 1 else []
        if edges:
            a, b = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(group[a]), pa.array(group[b])], ["a", "b"])

    by = ["t", "k", "lo", "hi"]
    return cand.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable, for every node of ``edges(a, b)``.

    Alternates large-star and small-star contraction until the edges are stars.
    """
    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e, keep: Column, add_self: bool):
        sym = both(e).where("a != b")
        if add_self:
            sym = sym.where("b < a")
        low = stored(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "simhash-low")
        out = sym.join(low, "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if add_self:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return stored(out.where("a != b").distinct(), "simhash-star")

    def state(e):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    cur = stored(edges.select("a", "b").where("a != b"), "simhash-edges")
    was = None
    while (now := state(cur)) != was:
        was = now
        cur = star(star(cur, F.expr("b > a"), False), F.expr("true"), True)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """Per row of ``df``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id of its component) and ``component_fingerprint`` (the component's own key)."""
    fps = stored(fingerprints(df, id_col, text_col, words), "simhash-fps")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("low_id"))
    roots = components(links(reps.select("fp"), max_bits, blocks))
    rooted = stored(reps.join(roots, reps.fp == roots.node, "left")
                    .select("fp", F.coalesce("root", "fp").alias("root"), "low_id"), "simhash-roots")
    lows = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    known = stored(rooted.select("fp", "root").join(lows, "root"), "simhash-components")
    return (fps.join(known, "fp")
            .select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id",
                    hex64(F.col("root")).alias("component_fingerprint")))


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``df`` with one row of each component: its smallest (id, fingerprint); of repeated rows, one."""
    tx = text_key(F.col(text_col))
    keyed = df.select(F.struct(F.col(id_col).alias("doc_id"), tx.alias("tx")).alias("key"), F.col(text_col).alias("text"))
    near = near_duplicates(keyed, "key", "text", **params)
    # an unknown id comes last: a null id represents a group only if no row has another
    first = near.groupBy("component_fingerprint").agg(
        F.min(F.struct(F.col("doc_id.doc_id").isNull(), F.col("doc_id.doc_id").alias("doc_id"),
                       F.col("doc_id.tx").alias("tx"))).alias("k")).select("k.doc_id", "k.tx")
    # join and grouping share one null-free key, so the texts are shuffled once
    first = stored(first, "simhash-kept").select(*row_key(F.col("doc_id"), F.col("tx")))
    rows = df.select(packed(df), *row_key(F.col(id_col), tx))
    hit = rows.join(first, KEY, "left_semi")
    return hit.groupBy(*KEY).agg(F.first("row").alias("row")).select("row.*")
