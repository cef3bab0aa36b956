"""Operators without oracle SQL against plain brute force on small tables."""

import base64

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemetra.llm import neighbours, packing, simhash, tokens, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("dims", [64, 256, 768])
def test_recall_at_5(spark, monkeypatch, dims):
    monkeypatch.setattr(neighbours, "BLOCK", 2048)    # more than one block
    rng = np.random.default_rng(3)
    table = rng.normal(size=(6000, dims))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    unit = table / np.linalg.norm(table, axis=1)[:, None]
    found = 0
    for q in range(0, 6000, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        best = set(np.argsort(-cos)[:5].tolist())
        assert len(got[q]) == 5 and all(abs(cos[i] - s) < 1e-9 for i, s in got[q].items())
        found += len(best & set(got[q]))
    assert found >= 0.9 * 5 * 120, found


def test_exact_mode_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    rng = np.random.default_rng(4)
    table = rng.normal(size=(1000, 32)) * 10.0 ** rng.integers(-150, 150, size=(1000, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
    unit = table / np.abs(table).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for exact in (True, False):
        got = {}
        for r in neighbours.nearest(rows, F.col("vec_id") % 50 == 0, exact=exact).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in range(0, 1000, 50):
            cos = unit @ unit[q]
            cos[q] = -2
            assert len(got[q]) == 5 and all(abs(cos[i] - s) < 1e-9 for _, i, s in got[q])
            if exact:
                assert [i for _, i, _ in sorted(got[q])] == np.argsort(-cos)[:5].tolist()


def test_byte_ids_are_tiktokens(docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path(tokens.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in tokens.encode(docs).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]), r.doc_id


def test_packed_ids_are_the_tokenizers(docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(tokens.WORDS))
    got = {}
    for r in packing.pack(packing.pieces(docs)).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert got.keys() == texts.keys()
    for i, parts in got.items():
        flat = [x for _, ids in sorted(parts) for x in ids]
        assert flat == [*tok.encode(texts[i], add_special_tokens=False).ids, packing.END_ID], i


def test_word_ids_of_made_texts_are_the_librarys():
    rng = np.random.default_rng(8)
    alphabet = ["a", "B", "\u0130", "i\u0307", " ", "\n", ".", ",", "_", "é", "e\u0301", "日", "ß", "<|endoftext|>", "<|startoftext|>",
                "<|", "'s", "1", "\u212a", "Ǆ", "\u0345", "!"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 12))) for _ in range(4000)] + ["\u0130.", "\u0130,", "x <|endoftext|> y"]
    tok = Tokenizer.from_file(public_tokenizers.path(tokens.WORDS))
    got = tokens.word_bpe(tokens.WORDS).encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_simhash_components(docs):
    rows = simhash.near_duplicates(docs).collect()
    fps = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3):
            comp[root(i)] = root(int(j))
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [low[root(i)] for i in range(len(rows))]


def test_warc_refers_to_the_largest_page_of_equal_payloads(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    # every page again twice under other ids: the shipped ones are all different
    copies = [pages.withColumn("page_id", F.col("page_id") + k) for k in (10_000, 5_000)]
    pages = pages.unionByName(copies[0]).unionByName(copies[1].where("page_id % 2 = 0"))
    html = {r.page_id: (r.html or "").encode() for r in pages.select("page_id", "html").collect()}
    first = {html[i]: i for i in sorted(html)}
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, warc.write(pages)).collect()}
    assert got == {i: (len(h), "response", None) if first[h] == i else (len(h), "revisit", first[h]) for i, h in html.items()}
