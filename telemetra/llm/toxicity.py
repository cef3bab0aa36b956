"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 7).

A text is a sequence of words. A word's input is a hashed word embedding beside the
mean of its hashed character 4-gram embeddings. Windows of ``WINDOW`` words, each
overlapping the last by half, run through a GRU in both directions; attention
pools the states of a window to one logit. A document scores its highest window,
so every word of every text is read, twice over.

Training is plain numpy on the driver: ``PER_CLASS`` labelled documents of each
class and ``FIT_WINDOWS`` evenly spaced windows of each are all that is gathered to learn from, and one score of each whole
text to set the cut: the quantile of their scores that misjudges least becomes 0.3.
A toxic document need not be toxic in every window, so after the first epoch only
its windows the network believes in (its best one at least) count as positive.
Scoring runs in Arrow batches; each distinct word of a batch is embedded once.

Defined cases: null, empty and wordless text scores as one empty window; repeated
rows get equal scores; without rows of both labels every score is 0; a null id is
not held out and not learned from. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from telemetra.llm.labelled import class_share, cut_level, labelled, present
from telemetra.llm.quality import THRESHOLD, verdict

PER_CLASS = 2000
FIT_WINDOWS = 4
EPOCHS = 6
WINDOW, STRIDE = 64, 32
HIDDEN, DIM, SLOTS = 8, 8, 1 << 14
MOD, HELD = 4, 2
EDGE = b".,!?;:\"'()*-"
CHUNK = 2048             # windows run through the network at once


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each word; slots of all character 4-grams, and where each word's begin."""
    clean = [w.strip(EDGE).lower() for w in words]
    slots = np.array([zlib.crc32(w) % SLOTS for w in clean], np.int64)
    data = np.frombuffer(b"".join(b"^" + w + b"$   " for w in clean), np.uint8).astype(np.uint32)
    size = np.array([len(w) + 5 for w in clean], np.int64)
    ends = np.cumsum(size)
    gram = np.zeros(len(data), np.uint32)
    gram[:-3] = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    # a word of n bytes has n - 1 grams over ^word$ (one at least)
    count = np.maximum(size - 6, 1)
    starts = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(starts, count) + np.repeat(ends - size, count)
    return slots, (gram[at] * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64), starts


def windows(n: int) -> range:
    """Starts of the overlapping windows that cover ``n`` words."""
    return range(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else range(1)


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * DIM
        self.p = {"word": r.normal(0, 0.1, (SLOTS, DIM)), "char": r.normal(0, 0.3, (SLOTS, DIM)),
                  "att": r.normal(0, 0.5, (2 * h, h)), "attv": r.normal(0, 0.5, h),
                  "out": r.normal(0, 0.5, 2 * h), "bias": np.array([-1.0])}
        for way in "fb":
            self.p |= {"w" + way: r.normal(0, d ** -0.5, (d, 3 * h)), "b" + way: np.zeros(3 * h),
                       "u" + way: r.normal(0, h ** -0.5, (h, 3 * h))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.ready, self.cut = False, 0.0

    # ---- inputs
    def inputs(self, hashes) -> np.ndarray:
        slots, grams, starts = hashes
        sums = np.add.reduceat(self.p["char"][grams], starts, axis=0)
        n = np.diff(np.append(starts, len(grams)))[:, None]
        return np.concatenate([self.p["word"][slots], sums / n], axis=1).astype(np.float32)

    def _gates(self, x, way):
        """Input part of the gates for each word, and a last row for padding that leaves the state as it is."""
        g = x @ self.p["w" + way] + self.p["b" + way]
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = 30
        return np.concatenate([g, pad])

    def _run(self, gates, seq, way, tape=None):
        """States (time, window, hidden) of one direction; ``tape`` collects what backward needs."""
        h, u = HIDDEN, self.p["u" + way]
        n, t_max = seq.shape
        state, out = np.zeros((n, h), np.float32), np.empty((t_max, n, h), np.float32)
        for t in (range(t_max) if way == "f" else range(t_max - 1, -1, -1)):
            g = gates[seq[:, t]]
            v = state @ u
            zr = 1 / (1 + np.exp(-(g[:, :2 * h] + v[:, :2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h:] + r * v[:, 2 * h:])
            if tape is not None:
                tape.append((t, state, z, r, c, v[:, 2 * h:]))
            state = c + z * (state - c)
            out[t] = state
        return out

    def _pool(self, states, mask):
        a = np.tanh(states @ self.p["att"])
        e = np.where(mask.T, a @ self.p["attv"], np.float32(-1e4))
        e = np.exp(e - e.max(0))
        att = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", att, states)
        return a, att, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, gates, seq, words: int) -> np.ndarray:
        out = np.empty(len(seq), np.float32)
        for i in range(0, len(seq), CHUNK):
            s = seq[i:i + CHUNK]
            s = s[:, :max(1, int((s < words).sum(1).max()))]
            states = np.concatenate([self._run(gates[way], s, way) for way in "fb"], axis=2)
            out[i:i + CHUNK] = self._pool(states, s < words)[3]
        return out

    # ---- scoring whole texts
    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """0 to 1; the cut is at ``THRESHOLD``."""
        if not self.ready:
            return np.zeros(len(texts))
        return sigmoid(self.logit(texts) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))

    def logit(self, texts: list[bytes | None]) -> np.ndarray:
        """The highest window of each text."""
        if not texts:
            return np.zeros(0)
        vocab: dict[bytes, int] = {}
        seen = vocab.setdefault
        docs = [np.array([seen(w, len(vocab)) for w in t.split()], np.int32) if t else np.zeros(0, np.int32) for t in texts]
        words = len(vocab)
        x = self.inputs(hashed(list(vocab))) if words else np.zeros((0, 2 * DIM), np.float32)
        gates = {way: self._gates(x, way) for way in "fb"}
        per = np.array([len(windows(len(d))) for d in docs])
        seq = np.full((int(per.sum()), WINDOW), words, np.int32)
        k = 0
        for d in docs:
            for s in windows(len(d)):
                part = d[s:s + WINDOW]
                seq[k, :len(part)] = part
                k += 1
        return np.maximum.reduceat(self.logits(gates, seq, words), np.cumsum(per) - per).astype(np.float64)

    # ---- training
    def _grads(self, hashes, seq, words, y, weight):
        h, p = HIDDEN, self.p
        x = self.inputs(hashes)
        gates = {way: self._gates(x, way) for way in "fb"}
        tapes = {"f": [], "b": []}
        states = np.concatenate([self._run(gates[way], seq, way, tapes[way]) for way in "fb"], axis=2)
        a, att, pooled, logit = self._pool(states, seq < words)
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
        dp = d[:, None] * p["out"]
        ds = att[:, :, None] * dp
        da = np.einsum("nh,tnh->tn", dp, states)
        de = att * (da - (att * da).sum(0))
        g["attv"] = np.einsum("tn,tnh->h", de, a)
        dpre = de[:, :, None] * p["attv"] * (1 - a * a)
        g["att"] = np.einsum("tnk,tnh->kh", states, dpre)
        ds = ds + dpre @ p["att"].T
        dx = np.zeros_like(x)
        for w, way in enumerate("fb"):
            u, back = p["u" + way], np.zeros((len(seq), h), np.float32)
            du, dgate = np.zeros_like(u), np.zeros((words + 1, 3 * h), np.float32)
            flat, at = [], []
            for t, prev, z, r, c, vn in reversed(tapes[way]):
                dh = back + ds[t, :, w * h:(w + 1) * h]
                dc = dh * (1 - z) * (1 - c * c)
                dz, dr = dh * (prev - c) * z * (1 - z), dc * vn * r * (1 - r)
                hid = np.concatenate([dz, dr, dc * r], axis=1)
                back = dh * z + hid @ u.T
                du += prev.T @ hid
                flat.append(np.concatenate([dz, dr, dc], axis=1))
                at.append(seq[:, t])
            at, flat = np.concatenate(at), np.concatenate(flat)
            for k in range(3 * h):
                dgate[:, k] = np.bincount(at, flat[:, k], words + 1)
            dgate = dgate[:words]
            g["u" + way], g["b" + way], g["w" + way] = du, dgate.sum(0), x.T @ dgate
            dx += dgate @ p["w" + way].T
        slots, grams, starts = hashes
        n = np.diff(np.append(starts, len(grams)))
        each = np.repeat(dx[:, DIM:] / n[:, None], n, axis=0)
        g["word"] = np.stack([np.bincount(slots, dx[:, k], SLOTS) for k in range(DIM)], axis=1)
        g["char"] = np.stack([np.bincount(grams, each[:, k], SLOTS) for k in range(DIM)], axis=1)
        return g

    def fit(self, docs: list[list[list[bytes]]], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128,
            rate: float = 0.01, seed: int = 5) -> "Network":
        """``docs``: per document its windows, each a list of words."""
        if len(docs) == 0 or y.min() == y.max():
            return self
        rng = np.random.default_rng(seed)
        flat, doc = [w for d in docs for w in d], np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        label = y[doc].astype(np.float32)
        use = np.ones(len(flat), bool)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(np.flatnonzero(use))
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                hashes, seq, words = _encode([flat[k] for k in part])
                grads = self._grads(hashes, seq, words, label[part], np.ones(len(part)))
                step += 1
                for k, g in grads.items():
                    m1, m2 = m[k]
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    self.p[k] -= (rate / (1 + epoch / 2) * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            logit = np.concatenate([self._logits_of(flat[i:i + CHUNK]) for i in range(0, len(flat), CHUNK)])
            top = np.full(len(docs), -np.inf)
            np.maximum.at(top, doc, logit)
            use = (label == 0) | (logit > 0) | (logit == top[doc])
        self.ready = True
        return self

    def _logits_of(self, group):
        hashes, seq, words = _encode(group)
        x = self.inputs(hashes)
        return self.logits({way: self._gates(x, way) for way in "fb"}, seq, words)


def _encode(group: list[list[bytes]]):
    vocab: dict[bytes, int] = {b"": 0}
    ids = [[vocab.setdefault(w, len(vocab)) for w in words] for words in group]
    seq = np.full((len(group), max(1, max(map(len, ids)))), len(vocab), np.int64)
    for k, row in enumerate(ids):
        seq[k, :len(row)] = row
    return hashed(list(vocab)), seq, len(vocab)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
        id_col: str = "doc_id", text_col: str = "text") -> Network:
    labels = present(docs, labels, label, id_col)
    rows = labelled(docs, labels, label, MOD, HELD, per_class, id_col, text_col)
    src = rows.select("doc_id", "y", F.col("text").cast("string").cast("binary").alias("text"))
    schema = StructType([src.schema["doc_id"], StructField("y", IntegerType()), StructField("parts", ArrayType(BinaryType()))])

    def cut(batches):
        for b in batches:
            parts = []
            for t in b.column(2):
                words = (t.as_py() or b"").split()
                starts = windows(len(words))
                some = sorted({starts[round(k * (len(starts) - 1) / (FIT_WINDOWS - 1))] for k in range(FIT_WINDOWS)})
                parts.append([b" ".join(words[s:s + WINDOW]) for s in some])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(parts, pa.list_(pa.binary()))], schema.names)

    got = src.mapInArrow(cut, schema).dropDuplicates(["doc_id"]).orderBy("doc_id").select("y", "parts").collect()
    net = Network().fit([[bytes(p).split() for p in r.parts] for r in got], np.array([r.y for r in got]))
    if net.ready:
        seen = _map(src, ["doc_id", "y"], net.logit).dropDuplicates(["doc_id"]).select("y", "value").collect()
        s, y = np.array([r["value"] for r in seen]), np.array([r.y for r in seen])
        net.cut = float(np.quantile(s, cut_level(s, y, class_share(labels, label, MOD, HELD))))
    return net


def _map(src: DataFrame, keep: list[str], value) -> DataFrame:
    """Columns ``keep`` and ``value(texts)`` of ``src(text)``."""
    schema = StructType([*(src.schema[c] for c in keep), StructField("value", DoubleType())])
    src = src.select(*keep, "text")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                out = value([t.as_py() for t in part.column(len(keep))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out)], schema.names)

    return src.mapInArrow(run, schema)


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, held_out, score, predicted."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return verdict(_map(src, ["doc_id"], net.score).withColumnRenamed("value", "score"), MOD, HELD)
