"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts (operator 12).

Every text is tokenised whole, a space and the text by the byte-level tokenizer (A), the
text by the piece tokenizer (B, which adds the space itself), and both token sequences
must spell the same bytes. A document is then split at its anchors: offsets where both
sequences have a token that begins with a space, so both end a token just before. What
lies between two anchors is a window, a pair of tuples of ids. Windows recur all over a
corpus, so within a run of documents an alignment is made once per pair of tuples and
remembered. It cuts the window into groups where tokens of both sides end, and links the
tokens of A and B that share bytes.

Corpus counts: workers read runs of documents of about ``CHUNK`` characters and write, per
document, which windows it has and how often, and per chunk its windows, its distinct
pairs of ids and how many of the chunk's documents hold each. Spark sums the pairs over
all chunks, finds the highest count of each A id and sends the figures back to the chunks
that asked, where documents add them up. A pair held by every document is one row a chunk,
and a group holds one chunk: at most its windows and distinct pairs, however large the table.

Defined cases: null and empty texts, and texts whose tokens don't spell them (a literal
U+2581, say), have no tokens: counts of zero and an empty digest. A text is never cut; one
longer than ``CHUNK`` is a chunk of its own, and one without anchors one window. Rows that
repeat an id or a text are documents of their own. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from telemetra.llm.common import stored
from telemetra.llm.tokens import byte_alphabet, resolve

BYTES = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
CHUNK = 8_000_000            # characters of one run of documents
RUN = 500_000                # characters tokenised at once
PARTS = 300_000              # parts of texts whose pieces a worker keeps
RUN_CHARS = 2_000            # longest run of one kind that the fast byte tokenizer gets
LONG_GAP = re.compile(r"\s{%d}" % RUN_CHARS)
SEP = (1 << 32) - 1          # between the A and the B ids of a window
SHIFT = 32                   # a pair of ids is A << SHIFT | B


class ByteTokens:
    """The byte-level tokenizer of a tokenizer file whose ids are in the order of its merges, as tiktoken ranks;
    runs too long for it (it takes quadratic time) go through the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(resolve(path), encoding="utf-8") as f:
            spec = json.load(f) | {"added_tokens": []}    # their strings in a text are ordinary text
        back = {c: i for i, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids aren't in the order of the merges")
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_str(json.dumps(spec))

    def encode(self, text: str) -> list[int]:
        words = text.split()
        gaps = len(text) - sum(map(len, words)) - len(words)
        if max(map(len, words), default=0) > RUN_CHARS or (gaps > RUN_CHARS and LONG_GAP.search(text)):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """The piece tokenizer. No piece holds a space but at its start, so where single spaces separate a text's
    parts each is encoded alone, and once per worker (up to ``PARTS`` of them are kept)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=resolve(path))
        pieces = list(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                         for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.split(" ") if self.apart and "  " not in t and t[0] != " " and t[-1] != " " else [t] for t in texts]
        every = set().union(*cut)
        new = every.difference(self.ids)
        if len(self.ids) + len(new) > PARTS:
            self.ids.clear()
            new = every
        new = list(new)
        made = self.model.encode(new, num_threads=1)
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made))).tolist()
        flat = np.fromiter(chain.from_iterable(made), "<u4").tobytes()
        self.ids.update(zip(new, (flat[4 * i:4 * j] for i, j in zip([0, *ends], ends))))
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, c)), "<u4") for c in cut]


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.spelt = self.a.bytes_of, self.b.bytes_of
        self.length = [np.array([len(x) for x in s], np.int64) for s in self.spelt]
        self.spaced = [np.array([x[:1] == b" " for x in s]) for s in self.spelt]
        # an id as it stands in a group's text: inside and at the end of the A ids, of the B ids
        self.shown = [b"%d%s" % (i, mark) for s, marks in zip(self.spelt, (b",|", b",;"))
                      for mark in (marks[:1], marks[1:]) for i in range(len(s))]
        # the bytes of all tokens end to end, and where each begins
        self.data = [np.frombuffer(b"".join(x), np.uint8) for x in self.spelt]
        self.at = [np.cumsum(n) - n for n in self.length]

    def spell(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids of one side stand for."""
        return self.data[side][_ranges(self.at[side][ids], self.length[side][ids])]

    def tokens(self, texts: list[str | None]):
        """Per text its A and B ids, or None where either doesn't spell a space and the text."""
        pieces = iter(self.b.encode([t for t in texts if t]))
        for t in texts:
            if not t:
                yield None
                continue
            sides = np.array(self.a.encode(" " + t), "<u4"), next(pieces)
            want = np.frombuffer(b" " + t.encode(), np.uint8)
            yield sides if all(np.array_equal(self.spell(k, ids), want) for k, ids in enumerate(sides)) else None

    def windows(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The windows of documents laid end to end, in order, each as the bytes of its A ids, SEP and its
        B ids; and the document of each. ``starts``: the A tokens that begin a document."""
        size_a, size_b = self.length[0][a], self.length[1][b]
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        begins = np.zeros(int(start_a[-1] + size_a[-1]), bool)
        begins[start_b[self.spaced[1][b]]] = True
        # the anchors: both sides begin a spaced token there; a document begins with one
        lo_a = np.flatnonzero(self.spaced[0][a] & begins[start_a])
        lo_b = np.searchsorted(start_b, start_a[lo_a])
        n = np.arange(len(lo_a))
        hi_a, hi_b = np.append(lo_a[1:], len(a)), np.append(lo_b[1:], len(b))
        # one buffer of all windows: A ids, SEP, B ids
        flat = np.empty(len(a) + len(b) + len(n), "<u4")
        flat[np.arange(len(a)) + np.repeat(lo_b + n, hi_a - lo_a)] = a
        flat[hi_a + lo_b + n] = SEP
        flat[np.arange(len(b)) + np.repeat(hi_a + n + 1, hi_b - lo_b)] = b
        data, ends = flat.tobytes(), (4 * (hi_a + hi_b + n + 1)).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)], np.searchsorted(starts, lo_a, "right") - 1

    def align(self, windows: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each window its groups as text, their number and its number of links; and the linked pairs' codes in order."""
        # both sides of a window have equally many bytes, so windows can be laid end to end
        flat = np.frombuffer(b"".join(windows), "<u4")
        sep = np.flatnonzero(flat == SEP)
        ends = np.cumsum([len(w) // 4 for w in windows])
        n_a, n_b = sep - np.append(0, ends[:-1]), ends - sep - 1
        is_a = np.repeat(np.tile([True, False], len(sep)), np.stack([n_a, n_b + 1], 1).ravel())
        a = flat[is_a].astype(np.int64)
        is_a[sep] = True
        b = flat[~is_a].astype(np.int64)
        end_a, end_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        both = np.zeros(int(end_a[-1]) + 1, np.int8)
        both[end_a] = 1
        both[end_b] += 2
        # where any token ends a stretch ends that lies in one token of either side: a link
        cut = np.flatnonzero(both)
        shared = np.flatnonzero(both == 3)
        codes = a[np.searchsorted(end_a, cut)] << SHIFT | b[np.searchsorted(end_b, cut)]
        stop = end_a[np.cumsum(n_a) - 1]
        at_code, at_group = np.searchsorted(cut, stop, "right"), np.searchsorted(shared, stop, "right")
        # groups in order, their A ids before their B ids
        of_a, of_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        upto_a, upto_b = np.searchsorted(end_a, shared, "right"), np.searchsorted(end_b, shared, "right")
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.append(0, upto_b)[of_a]] = a + len(self.spelt[0]) * (both[end_a] == 3)
        shown[np.arange(len(b)) + upto_a[of_b]] = b + 2 * len(self.spelt[0]) + len(self.spelt[1]) * (both[end_b] == 3)
        text = list(map(self.shown.__getitem__, shown.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        return ([b"".join(text[i:j])[:-1] for i, j in zip([0, *ends], ends)],
                np.diff(at_group, prepend=0), np.diff(at_code, prepend=0), codes)


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``lo[0], lo[0] + 1, ...`` (``size[0]`` numbers), then those from ``lo[1]``, and so on."""
    return np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)


class Chunk:
    """The documents of one run: rows of their own and one row of what they share."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.window, self.texts = {}, []                          # the number and the text of each window
        self.groups, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)   # per window: groups, and where its links end
        self.links, self.pair = np.zeros(0, np.uint32), {}        # numbers of linked pairs, window by window; each pair's number
        self.docs = np.zeros(0, np.int64)                         # per pair: documents that hold it
        self.rows = []

    def add(self, ids: list, tokens: list, al: Aligner) -> None:
        """Some documents with their tokens (None: without)."""
        have = [t for t in tokens if t is not None]
        done = iter(self._aligned(have, al)) if have else iter(())
        for i, t in zip(ids, tokens):
            self.rows.append((i, 0, 0, 0, 0, "", b"", b"") if t is None else (i, len(t[0]), len(t[1]), *next(done)))

    def _number(self, keys: list[bytes], al: Aligner) -> np.ndarray:
        """The number of each window; new ones get the next."""
        seen = list(map(self.window.get, keys))
        if None in seen:
            new = list(dict.fromkeys(k for k, w in zip(keys, seen) if w is None))
            texts, groups, sizes, codes = al.align(new)
            self.window.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
            self.texts += texts
            self.groups = np.append(self.groups, groups)
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))
            codes, place = np.unique(codes, return_inverse=True)
            numbers = np.array([self.pair.setdefault(c, len(self.pair)) for c in codes.tolist()], np.uint32)
            self.links = np.append(self.links, numbers[place])
            self.docs = np.append(self.docs, np.zeros(len(self.pair) - len(self.docs), np.int64))
            seen = list(map(self.window.__getitem__, keys))
        return np.array(seen, np.int64)

    def _aligned(self, tokens: list, al: Aligner):
        a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
        keys, doc = al.windows(a, b, np.cumsum([0, *(len(t[0]) for t in tokens)])[:-1])
        seen, n = self._number(keys, al), len(tokens)
        sizes = np.diff(self.ends)
        groups, links = (np.bincount(doc, x[seen], n).astype(np.int64).tolist() for x in (self.groups, sizes))
        ends = np.cumsum(np.bincount(doc, minlength=n)).tolist()
        order = seen.tolist()
        digests = [hashlib.sha256(b";".join(map(self.texts.__getitem__, order[i:j]))).hexdigest() for i, j in zip([0, *ends], ends)]
        # the windows of each document once, with how often it has them
        own, times = np.unique(doc * len(sizes) + seen, return_counts=True)
        of, own = np.divmod(own, len(sizes))
        held = np.unique(np.repeat(of, sizes[own]) * len(self.pair) + self.links[_ranges(self.ends[own], sizes[own])])
        self.docs += np.bincount(held % len(self.pair), minlength=len(self.pair))
        upto = np.searchsorted(of, np.arange(n), "right").tolist()
        own, times = own.astype("<u4"), times.astype("<u4")
        for k, (i, j) in enumerate(zip([0, *upto], upto)):
            yield groups[k], links[k], digests[k], own[i:j].tobytes(), times[i:j].tobytes()

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        cols = [list(c) + [None] for c in zip(*self.rows)]
        shared = [self.links.astype("<u4").tobytes(), self.ends.astype("<u4").tobytes(), list(self.pair), self.docs.tolist()]
        last = [[None] * len(self.rows) + [x] for x in shared]
        cols = [[self.number] * (len(self.rows) + 1), *cols, *last]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _chunks(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of documents, and per chunk one row (``codes`` not null) of its windows and pairs."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([
        StructField("chunk", LongType()), src.schema["doc_id"], *(StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
        StructField("groups_sha256", StringType()), StructField("windows", BinaryType()), StructField("times", BinaryType()),
        StructField("links", BinaryType()), StructField("ends", BinaryType()),
        StructField("codes", ArrayType(LongType())), StructField("docs", ArrayType(LongType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        al, arrow = aligner(byte_path, piece_path), to_arrow_schema(schema)
        base = TaskContext.get().partitionId() << 32
        chunk = Chunk(base)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < RUN or end == at):
                    size += len(texts[end] or "")
                    end += 1
                chunk.add(ids[at:end], list(al.tokens(texts[at:end])), al)
                chunk.chars += size
                at = end
                if chunk.chars >= CHUNK:
                    yield chunk.batch(arrow)
                    chunk = Chunk(chunk.number + 1)
        if chunk.rows:
            yield chunk.batch(arrow)

    return src.mapInArrow(run, schema)


def _sums(schema: StructType):
    """Adds the corpus figures of a chunk's pairs up over its documents' windows."""
    def run(own: pa.Table, figures: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        shared = own.filter(pc.is_valid(own["codes"]))
        rows = own.filter(pc.is_null(own["codes"]))
        links, ends = (np.frombuffer(shared[c][0].as_py(), "<u4") for c in ("links", "ends"))
        count, best = np.zeros(figures.num_rows, np.int64), np.zeros(figures.num_rows, np.int64)
        pos = figures["pos"].to_numpy()
        count[pos], best[pos] = figures["n"].to_numpy(), figures["best"].to_numpy()

        def per_window(x):
            total = np.append(0, np.cumsum(x[links]))
            return total[ends[1:]] - total[ends[:-1]]

        sums, highs = per_window(count), per_window(best)
        out = [[], []]
        for w, t in zip(rows["windows"].to_pylist(), rows["times"].to_pylist()):
            at, times = np.frombuffer(w, "<u4"), np.frombuffer(t, "<u4").astype(np.int64)
            for to, x in zip(out, (highs, sums)):
                to.append(int(np.dot(x[at], times)))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        arrow = to_arrow_schema(schema)
        cols = [*(rows[c].combine_chunks() for c in names), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                rows["groups_sha256"].combine_chunks()]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str = BYTES,
          piece_path: str = PIECES) -> tuple[DataFrame, DataFrame]:
    """Two tables. Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``. Per linked pair of ids: ``a_id``, ``b_id``, ``docs`` (how many
    documents hold it) and ``best`` (no other B id has more for this A id)."""
    chunks = stored(_chunks(docs, id_col, text_col, byte_path, piece_path), "alignment-chunks")
    asked = chunks.where(F.col("codes").isNotNull()).select(
        "chunk", F.posexplode(F.arrays_zip("codes", "docs")).alias("pos", "x")).select("chunk", "pos", "x.codes", "x.docs")
    totals = asked.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("n"))
    a_id = F.shiftright("code", SHIFT).alias("a_id")
    highest = totals.groupBy(a_id).agg(F.max("n").alias("high"))
    # joins of one kind at every size: pairs grow with the table
    pairs = stored(totals.select("code", "n", a_id).join(highest.hint("merge"), "a_id")
                   .select("code", "n", (F.col("n") == F.col("high")).cast("long").alias("best")), "alignment-pairs")
    figures = asked.select("chunk", "pos", F.col("codes").alias("code")).join(pairs.hint("merge"), "code").select(
        F.col("chunk").alias("of"), "pos", "n", "best")
    schema = StructType([chunks.schema["doc_id"], *(StructField(n, LongType()) for n in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), StructField("groups_sha256", StringType())])
    out = chunks.groupBy("chunk").cogroup(figures.groupBy("of")).applyInArrow(_sums(schema), schema)
    return out, pairs.select(F.shiftright("code", SHIFT).alias("a_id"), F.col("code").bitwiseAND((1 << SHIFT) - 1).alias("b_id"),
                             F.col("n").alias("docs"), (F.col("best") == 1).alias("best"))
