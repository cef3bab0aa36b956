"""Quality classifier by Bradley-Terry pairwise ranking (operator 1).

Features of a whole text (word counts and lengths, shares of symbols, capitals,
digits and punctuation, repeated words, word pairs and lines) are computed in
Arrow batches. On the driver, a bounded sample of labelled feature rows
(``PER_CLASS`` documents of each label, the only rows gathered) gives preference
pairs: a document labelled 1 is preferred to one labelled 0. The score w.x is fitted
by logistic loss on feature differences. The cut is a quantile of the sample's
scores: the level that misjudges fewest sample documents, each class counted at
its share among the labelled rows. Sample and shares are of rows whose document is
in the table given. Scores are then squashed so that the cut is 0.3.

Defined cases: null text counts as empty; repeated rows get equal scores; without
rows of both labels nothing can be ranked and every score is 0.5; a null id is not
held out and not learned from. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from telemetra.llm.labelled import class_share, cut_level, labelled, present, remainder

PER_CLASS = 6000
PAIRS = 60_000
THRESHOLD = 0.3
MOD, HELD = 5, 0

SYMBOLS, MARKS, STOPS = b"#*$%&|<>@^~=_{}[]\\/", b"!?", b".,;:\"'()-"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def features(text: bytes | None) -> list[float]:
    t = text or b""
    words, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
    n, size = max(len(words), 1), max(len(t), 1)
    chars = sum(map(len, words))
    share = [(len(t) - len(t.translate(None, c))) / size for c in (SYMBOLS, MARKS, STOPS, UPPER, DIGITS)]
    return [
        math.log1p(len(words)), chars / n, math.log1p(max(map(len, words), default=0)),
        *share, *map(math.sqrt, share),
        1 - len(set(words)) / n if words else 0.0,
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0,
        math.sqrt(1 - len(set(zip(words, words[1:]))) / (n - 1)) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(lines) / n, float(len(words) < 50),
    ]


class Ranker:
    """Linear score with its cut; ``score`` maps the cut to ``THRESHOLD``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, pairs: int = PAIRS, seed: int = 7):
        self.w = None
        if not len(x) or y.min() == y.max():
            return
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = self._scaled(x)
        rng = np.random.default_rng(seed)
        diff = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
        w, ridge = np.zeros(z.shape[1]), 1e-3
        for _ in range(30):                   # Newton steps of the logistic loss on differences
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff * p[:, None]).mean(0) + ridge * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w, s = w, z @ w
        self.cut = float(np.quantile(s, cut_level(s, y, prior)))
        self.scale = float(np.std(s)) / 4 + 1e-9

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.std, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        m = (self._scaled(x) @ self.w - self.cut) / self.scale + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _features(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    src = df.select(*keep, F.col(text_col).cast("string").cast("binary").alias("__text"))
    schema = StructType([*(src.schema[c] for c in keep), StructField("x", ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], schema.names)

    return src.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS,
        id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    labels = present(docs, labels, label, id_col)
    rows = labelled(docs, labels, label, MOD, HELD, per_class, id_col, text_col)
    got = _features(rows, ["doc_id", "y"], "text").dropDuplicates(["doc_id"]).select("y", "x").collect()
    return Ranker(np.array([r.x for r in got]), np.array([r.y for r in got]), class_share(labels, label, MOD, HELD))


def score(df: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, held_out, score, predicted."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = StructType([src.schema["doc_id"], StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranker.score(x))], schema.names)

    return verdict(src.mapInArrow(run, schema), MOD, HELD)


def verdict(scored: DataFrame, mod: int, held: int) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), mod) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(df: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` predicted 1, all columns."""
    schema = df.schema
    text = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py()) for t in b.column(text).cast(pa.binary())])
                yield b.filter(pa.array(ranker.score(x) >= THRESHOLD))

    return df.mapInArrow(run, schema)
