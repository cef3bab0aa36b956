"""Byte-level BPE encoding and decoding over Arrow batches (operator 4), and the word tokenizer packing uses.

``ByteBPE`` is built from a rank file: every byte string becomes a string of the
byte-to-character alphabet, every way to split a token into two tokens becomes a
merge at the token's rank. Texts are cut where a space follows a non-space; no
match of the split pattern crosses such a place, so parts encode independently,
and each distinct part is encoded once per worker (a bounded cache). Offsets are
character spans; tokens that split one character carry that character's span.
Decoding maps ids back to bytes; ``decode_stream`` holds back an incomplete
character until its last byte arrives.

Defined cases: null text encodes as empty (no ids); a text of any length is
encoded whole; tokens spelled like special ones are ordinary text. Repeated rows
give repeated results, an empty table an empty one, and extra columns aren't read.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"
CACHE = 500_000                         # distinct parts kept per worker (about 100 MB)
WORD_CACHE = 100_000_000                # bytes of parts and ids the word tokenizer keeps per worker (estimated)
WORD_GROUP = 500_000                    # characters it encodes at once
SEPARATOR = "\ue000"
CUT = re.compile(r"(?<=\S) ")           # a space after a non-space
AFTER_SYMBOL = re.compile(r"(?:[^\w \t\n\x0b\x0c\r]|_)[.,]")
PLAIN = b"abcdefghijklmnopqrstuvwxyz0123456789 \t\n\x0b\x0c\r.,"   # no symbol but the two themselves
DOUBLE = re.compile(rb"[.,][.,]")
NOT_PLAIN = re.compile(r"\A |\s ")      # a text without this can be cut at every space


def resolve(name: str) -> str:
    """A path as it is; a bare name is looked up where this worker has the public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def id_bytes(tok, text: str) -> bytes:
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Parts:
    """Ids of distinct parts, kept up to ``CACHE`` entries.

    ``core(part)`` splits a part into a word and the full stops and commas after it, if
    these encode independently (else it returns None); the word is then a part of its own.
    New parts are encoded many to a call, with a private-use character between them that
    ``joined`` (a tokenizer like ``plain``) knows as a token of its own; parts that hold
    that character themselves are encoded one by one by ``plain``.

    ``learn`` is ``missing`` and ``add``. Only ``missing`` empties the cache, so all parts
    of one call are known after it, however many they are.
    """

    def __init__(self, plain, joined, core, text=lambda p: p):
        self.plain, self.joined, self.core, self.text = plain, joined, core, text
        self.ids, self.tails = {}, {"": b"", b"": b""}
        self.sep = joined.token_to_id(SEPARATOR)

    def learn(self, parts: set) -> dict:
        """``parts`` all known: part -> ids as little-endian 32-bit bytes."""
        self.add(self.missing(parts))
        return self.ids

    def missing(self, parts: set) -> set:
        """Those of ``parts`` not known; all of them, the cache being emptied, if they don't fit."""
        new = parts.difference(self.ids)
        if len(self.ids) + len(new) > CACHE:
            self.ids.clear()
            return parts
        return new

    def add(self, new: set) -> None:
        ids, core = self.ids, self.core
        cut = [(p, core(p)) for p in new]
        words = {c[0] for _, c in cut if c}
        self.learn_words(list(words.difference(ids)))
        self._encode([p for p, c in cut if not c])
        for p, c in cut:
            if c and c[0] != p:
                ids[p] = ids[c[0]] + self._tail(c[1])

    def _tail(self, tail) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = id_bytes(self.plain, tail if isinstance(tail, str) else tail.decode())
        return self.tails[tail]

    def learn_words(self, words: list) -> None:
        self._encode(words)

    def _encode(self, new: list) -> None:
        text = self.text
        odd = {p for p in new if SEPARATOR in text(p)}
        for p in odd:
            self.ids[p] = id_bytes(self.plain, text(p))
        new = [p for p in new if p not in odd]
        for run, ids in self._runs(self.joined, new, SEPARATOR):
            cuts = (4 * np.flatnonzero(ids == self.sep)).tolist()
            self._keep(run, ids.tobytes(), [0, *(c + 4 for c in cuts)], [*cuts, 4 * len(ids)])

    def _keep(self, run, data, starts, ends) -> None:
        self.ids.update(zip(run, [data[a:b] for a, b in zip(starts, ends)]))

    def _runs(self, tok, new, between):
        runs = [new[i:i + 200] for i in range(0, len(new), 200)]
        for i in range(0, len(runs), 100):
            some = runs[i:i + 100]
            encoded = tok.encode_batch_fast([between.join(map(self.text, r)) for r in some], add_special_tokens=False)
            for run, e in zip(some, encoded):
                yield run, np.array(e.ids, "<u4")


class WordParts(Parts):
    """Parts of the word tokenizer: plain words need no normalizer or split pattern, and their last id ends a word.

    Its cache is bounded in bytes, as a part (a text without white space) may be of any length.
    """

    def __init__(self, plain, joined, core, text, words):
        super().__init__(plain, joined, core, text)
        vocab = words.get_vocab()
        self.words, self.ends = words, np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.size = 0

    def missing(self, parts: set) -> set:
        def size(some):
            # the objects and dictionary entry of a part, its bytes and up to an id (4 bytes) for each of them
            return 200 * len(some) + 5 * sum(map(len, some))

        new = parts.difference(self.ids)
        self.size += size(new)
        if self.size > WORD_CACHE:
            self.ids.clear()
            new, self.size = parts, size(parts)
        return new

    def learn_words(self, words: list) -> None:
        for run, ids in self._runs(self.words, words, " "):
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self._keep(run, ids.tobytes(), [0, *ends[:-1]], ends)


def byte_core(part: str) -> tuple[str, str] | None:
    """A word of letters and the full stops and commas after it: separate matches of the pattern."""
    word = part.rstrip(".,")
    return (word, part[len(word):]) if word.isalpha() else None


def word_core(part: bytes) -> tuple[bytes, bytes] | None:
    """As ``byte_core``, lower case; Latin letters below U+0130 are their own normal form."""
    word = part.rstrip(b".,")
    if word.isalpha():                 # ASCII
        return word.lower(), part[len(word):]
    word = word.decode()
    if not word.isalpha() or max(word) >= "\u0130":
        return None
    return word.lower().encode(), part[len(word.encode()):]


class ByteBPE:
    def __init__(self, ranks: str = RANKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(resolve(ranks), "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        char = byte_alphabet()
        shown = {t: "".join(char[b] for b in t) for t in rank}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(rank, key=rank.get) for i in range(1, len(t))
                  if t[:i] in rank and t[i:] in rank]

        def build():
            tok = Tokenizer(models.BPE({shown[t]: r for t, r in rank.items()}, merges, ignore_merges=True))
            tok.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
            return tok

        self.tok, joined = build(), build()
        joined.add_special_tokens([SEPARATOR])
        back = {c: b for b, c in enumerate(char)}
        self.bytes_of = [b""] * (max(rank.values()) + 1)
        for t, r in rank.items():
            self.bytes_of[r] = bytes(back[c] for c in shown[t])
        self.first = Parts(self.tok, joined, byte_core)
        self.rest = Parts(self.tok, joined, byte_core, lambda p: " " + p)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        out = []
        for group in _groups(texts):
            # the parts after the first begin with the space they were cut at
            cut = [(CUT.split(t) if NOT_PLAIN.search(t) else t.split(" ")) if t else [""] for t in group]
            heads = [c.pop(0) for c in cut]
            first = self.first.learn(set(heads))
            rest = self.rest.learn(set().union(*cut))
            out += [np.frombuffer(b"".join([first[h], *[rest[p] for p in c]]), "<u4") for h, c in zip(heads, cut)]
        return out

    def offsets(self, text: str | None) -> list[tuple[int, int]]:
        """Character span of each token of one text."""
        return self.tok.encode(text or "", add_special_tokens=False).offsets

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def decode_stream(self, ids):
        """Text of each id in turn; an incomplete character is held back, malformed bytes become U+FFFD."""
        dec = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield dec.decode(self.bytes_of[i])
        yield dec.decode(b"", True)


def _groups(texts, chars: int = 2_000_000):
    """``texts`` in runs of about ``chars`` characters (one text may be longer)."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) if t else 0
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


class WordBPE:
    """The lower-casing word tokenizer. Its pieces never span white space, so ASCII-separated
    parts encode independently (bytes.split cuts at exactly \\x20 and \\x09-\\x0D). A full stop
    or comma after a letter or digit begins a piece, so a text in which none follows another
    symbol is also cut there; it is lower-cased first where that is plain ASCII."""

    def __init__(self, path: str = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = library = Tokenizer.from_file(resolve(path))

        def build(normalizer, split):
            # the tokenizers share one model (vocabulary and merges), and so its memory
            tok = Tokenizer(library.model)
            if normalizer is not None:
                tok.normalizer = normalizer
            if split is not None:
                tok.pre_tokenizer = split
            return tok

        # a text with a special token's string, or with a letter that lower-cases to two, is encoded whole
        self.odd = ["\u0130", *(t.content[:2] for t in library.get_added_tokens_decoder().values())]
        self.tok, joined = (build(library.normalizer, library.pre_tokenizer) for _ in range(2))
        joined.add_special_tokens([SEPARATOR])
        words = build(None, pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)]))
        self.parts = WordParts(self.tok, joined, word_core, bytes.decode, words)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes (null: none)."""
        out, ids = [], self.parts.ids
        for group in _groups(texts, WORD_GROUP):
            flat, ends, whole = [], [0], {}
            for k, t in enumerate(group):
                if t and any(map(t.__contains__, self.odd)):
                    whole[k] = id_bytes(self.library, t)
                elif t:
                    data = t.encode().lower()
                    if (t.isascii() and not data.translate(None, PLAIN) and not DOUBLE.search(data)) or not AFTER_SYMBOL.search(t):
                        data = data.replace(b".", b" .").replace(b",", b" ,")
                    flat += data.split()
                ends.append(len(flat))
            missing = self.parts.missing(set(flat))
            plain = {p for p in missing if p.isalpha()}
            self.parts.learn_words(list(plain))
            self.parts.add(missing - plain)
            known = list(map(ids.__getitem__, flat))
            out += [whole.get(k) or b"".join(known[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
        return out


@lru_cache(maxsize=2)
def byte_bpe(ranks: str) -> ByteBPE:
    return ByteBPE(ranks)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode_arrow(texts: pa.Array, ranks: str = RANKS) -> pa.Array:
    """Texts to lists of ids, one Arrow array at a time."""
    ids = byte_bpe(ranks).encode(texts.to_pylist())
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode_arrow(ids: pa.Array, ranks: str = RANKS) -> pa.Array:
    """Lists of ids back to bytes."""
    bpe, flat, ends = byte_bpe(ranks), ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([bpe.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.large_binary())


def map_batches(df: DataFrame, id_col: str, text_col: str, fields: list[StructField], build) -> DataFrame:
    """``doc_id`` and the columns ``build(texts: pa.Array) -> list[pa.Array]`` per Arrow batch."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([src.schema["doc_id"], *fields])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *build(b.column(1))], schema.names)

    return src.mapInArrow(run, schema)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
           offsets: bool = False) -> DataFrame:
    """Per row: ``doc_id`` and ``ids``; with ``offsets`` also ``starts`` and ``ends`` (character spans)."""
    ints = ArrayType(IntegerType())
    fields = [StructField("ids", ints)] + [StructField(n, ints) for n in ("starts", "ends") if offsets]

    def build(texts):
        cols = [encode_arrow(texts, ranks).cast(pa.list_(pa.int32()))]
        if offsets:
            spans = [byte_bpe(ranks).offsets(t) for t in texts.to_pylist()]
            cols += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
        return cols

    return map_batches(df, id_col, text_col, fields, build)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """Per row of ``df(ids)``: ``doc_id`` and the decoded ``data`` (bytes)."""
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    schema = StructType([src.schema["doc_id"], StructField("data", BinaryType())])

    def run(batches):
        for b in batches:
            data = decode_arrow(b.column(1).cast(pa.large_list(pa.int32())), ranks).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], schema.names)

    return src.mapInArrow(run, schema)
