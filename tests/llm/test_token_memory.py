"""What a worker keeps for the word tokenizer is bounded, whatever the texts."""

import subprocess
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from telemetra.llm import tokens

BUILD = """
import re
from telemetra.llm import tokens
import public_tokenizers, tokenizers
def mb(): return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before = mb()
kept = tokens.WordBPE()
print(mb() - before)
"""


def same_as_library(texts, got):
    tok = Tokenizer.from_file(public_tokenizers.path(tokens.WORDS))
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_long_parts_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(tokens, "WORD_CACHE", 2_000_000, raising=False)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdé-"), 60_000)) for _ in range(24)]
    bpe = tokens.WordBPE()
    same_as_library(texts, [bpe.encode([t])[0] for t in texts])
    assert sum(len(p) + len(i) for p, i in bpe.parts.ids.items()) <= 2_000_000


def test_more_distinct_parts_in_a_text_than_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 1000)
    monkeypatch.setattr(tokens, "WORD_CACHE", 200_000, raising=False)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(2000)]
    texts = [" ".join(f"{w} {w}-{k}" for k, w in enumerate(words)), " ".join(words[::-1]), "", " ".join(words[:9])]
    bpe = tokens.WordBPE()
    same_as_library(texts, bpe.encode(texts))
    same_as_library(texts[::-1], bpe.encode(texts[::-1]))


def test_the_tokenizers_of_a_worker_share_one_model():
    out = subprocess.run([sys.executable, "-c", BUILD], check=True, capture_output=True, text=True, env={"PYTHONPATH": ":".join(sys.path)})
    assert float(out.stdout) < 55       # MB; one model takes about 30
