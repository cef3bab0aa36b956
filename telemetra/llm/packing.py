"""Best-fit packing by swap-based local search (operator 5).

Documents become token ids with an end id; only those longer than a sequence are
cut, into whole sequences and a rest. Rests are dealt at random into groups of
about ``GROUP_TOKENS`` tokens. In each group a best-fit-decreasing start is
improved by local search: documents move, or swap one-for-one or two-for-one,
from the emptiest bin into fuller ones whenever that raises the sum of squared
fills, until bins run empty or no such exchange is left. Bins that end underfull
are pooled over all groups, dealt anew into groups of the same size and packed
again, until one group has held them or a round no longer lowers their number;
then they stay as the round before left them.

A group's size is fixed by its token count in every round, so tasks stay bounded
and equal whatever ids, texts or lengths are frequent; only ids, counts and
lengths are shuffled.

Defined cases: null or empty text is the end id alone; repeated rows are separate
documents; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from telemetra.llm.common import stored
from telemetra.llm.tokens import WORDS, word_bpe

CAPACITY = 4096
END_ID = 1
GROUP_TOKENS = 4_000_000
ROWS = 256                  # documents encoded at once


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           vocab: str = WORDS, end_id: int = END_ID) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian 32-bit)."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([src.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()),
                         StructField("length", LongType()), StructField("ids", BinaryType())])
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        bpe = word_bpe(vocab)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                row, piece, data = [], [], []
                for r, ids in enumerate(bpe.encode(part.column(1).to_pylist())):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), step)):
                        row.append(r)
                        piece.append(p)
                        data.append(ids[at:at + step])
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
                    pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(data, pa.binary())], schema.names)

    return src.mapInArrow(run, schema)


def local_search(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length, no bin over ``capacity``."""
    lengths = np.asarray(lengths, np.int64)
    bin_of = np.zeros(len(lengths), np.int64)
    # start: best fit, longest first; ``open_`` holds (space, bin) in order
    fill, open_ = [], []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(open_, (n, -1))
        b = open_.pop(at)[1] if at < len(open_) else len(fill)
        if b == len(fill):
            fill.append(0)
        fill[b] += n
        bin_of[i] = b
        if fill[b] < capacity:
            insort(open_, (capacity - fill[b], b))
    fill = np.array(fill, np.int64)
    least = -(-int(lengths.sum()) // capacity)
    # a bin without an exchange waits until all have been tried, then again if any was changed since
    stuck, changed = np.zeros(len(fill), bool), False
    while (fill > 0).sum() > least:
        left = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if len(left):
            src = left[fill[left].argmin()]
            stuck[src] = not _improve(lengths, bin_of, fill, capacity, src)
            changed |= not stuck[src]
        elif changed:
            stuck[:], changed = False, False
        else:
            break
    return bin_of


def _improve(lengths, bin_of, fill, capacity, src) -> bool:
    """One exchange out of bin ``src`` that raises the sum of squared fills most, if there is one."""
    own = np.flatnonzero(bin_of == src)
    target = (fill >= fill[src]) & (fill < capacity)
    target[src] = False
    space = np.where(target, capacity - fill, 0)
    # one distinct length is enough: documents of equal length are interchangeable
    own = own[np.unique(lengths[own], return_index=True)[1]]
    others = np.flatnonzero(target[bin_of])
    o_len, o_bin = lengths[others], bin_of[others]
    best = (0, None)

    def gain(delta, b):
        return 2 * delta * (fill[b] - fill[src] + delta)

    def consider(moved, delta, b, back):
        nonlocal best
        score = np.where((delta > 0) & (delta <= space[b]), gain(delta, b), 0)
        if len(score) and score[k := int(score.argmax())] > best[0]:
            best = (int(score[k]), (moved, int(b[k]), None if back is None else int(back[k])))

    bins = np.flatnonzero(target)
    for a in own:
        consider((a,), np.full(len(bins), lengths[a]), bins, None)
        consider((a,), lengths[a] - o_len, o_bin, others)
    if best[1] is None:
        all_own = np.flatnonzero(bin_of == src)
        for x in range(len(all_own)):
            for y in range(x):
                pair = (all_own[x], all_own[y])
                consider(pair, lengths[pair[0]] + lengths[pair[1]] - o_len, o_bin, others)
            if best[1] is not None:
                break
    if best[1] is None:
        return False
    moved, b, back = best[1]
    for a in moved:
        bin_of[a] = b
        fill[src] -= lengths[a]
        fill[b] += lengths[a]
    if back is not None:
        bin_of[back] = src
        fill[b] -= lengths[back]
        fill[src] += lengths[back]
    return True


def pack(parts: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``parts`` (with ``length`` of at most ``capacity``) plus ``sequence_id`` and ``offset``."""
    parts = stored(parts.withColumn("_piece_no", F.monotonically_increasing_id()), "pack-pieces")
    todo = parts.where(F.col("length") < capacity).select("_piece_no", "length")
    done = parts.where(F.col("length") >= capacity).select(
        "_piece_no", F.col("_piece_no").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_piece_no"], ascending=[False, True], ignore_index=True)
        pdf["bin"] = local_search(pdf["length"].to_numpy(), capacity)
        by = pdf.groupby("bin")
        # a bin is named by its smallest piece, so names differ over groups and rounds
        return pd.DataFrame({"_piece_no": pdf["_piece_no"], "length": pdf["length"],
                             "sequence_id": by["_piece_no"].transform("min"),
                             "offset": by["length"].cumsum() - pdf["length"], "fill": by["length"].transform("sum")})

    under = F.col("fill") < capacity
    first = F.col("_piece_no") == F.col("sequence_id")
    total, out, left, rest = todo.agg(F.sum("length")).first()[0] or 0, [], None, None
    while True:
        groups = max(1, -(-total // group_tokens))
        packed = stored(todo.withColumn("g", F.pmod(F.xxhash64("_piece_no", F.lit(len(out))), F.lit(groups)))
                        .groupBy("g").applyInPandas(lambda pdf: search(pdf),
                                                    "_piece_no long, length long, sequence_id long, offset long, fill long"),
                        "pack-round")
        # ``left`` bins came into this round; those of a round that doesn't lower their number stay as they were
        bins, left_now, total = packed.agg(F.count_if(first), F.count_if(first & under),
                                           F.sum(F.when(under, F.col("length")))).first()
        if left is not None and bins >= left:
            out.append(rest)
            break
        if groups == 1:
            out.append(packed)
            break
        out.append(packed.where(~under))
        left, rest, total = left_now, packed.where(under), total or 0
        todo = rest.select("_piece_no", "length")
    for p in out:
        done = done.union(p.select("_piece_no", "sequence_id", "offset"))
    return parts.join(done, "_piece_no").drop("_piece_no")
