"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.llm import (line_dedup, line_rules, neighbours, packing, quality, sharding, simhash, tokens,
                           toxicity, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, h long, words string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
BASE = " ".join(f"term{i}" for i in range(70))
ROWS = [
    (1, BASE, "en", "a", 1, 0.5, "k", 1, "w"),
    (2, None, "en", "a", None, None, None, None, None),
    (3, "", None, None, 0, 0.5, "k", 1, "w"),
    (4, BASE, "en", "a", 1, 0.5, "k", 1, "w"),
    (4, BASE, "en", "a", 1, 0.5, "k", 1, "w"),
    (None, "null id\n" + BASE, "en", "b", 1, 0.5, "k", 1, "w"),
    (5, LONG, "en", "b", 1, 0.5, "k", 1, "w"),
    (6, "  \t \n\n \r\n", "en", "b", 1, 0.5, "k", 1, "w"),
    (7, "\n".join([BASE, "short one", BASE.replace("term3 ", ""), "ünï cödé 日本 🙂"]), "en", "b", 1, 0.5, "k", 1, "w"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))


ALL = ids([type("R", (), {"doc_id": r[0]}) for r in ROWS])


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert ids(rows) == ALL and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    none = quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0
    assert quality.keep(docs, none).columns == docs.columns and quality.keep(docs, none).count() == len(ROWS)


def test_sample_and_share_are_of_documents_present(spark):
    from telemetra.llm import labelled

    labels = spark.range(1000).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(id % 2) AS toxic")
    rows = [(i, BASE if i % 2 else "@@ ## !! \n" * 20, i % 2) for i in range(1000) if i % 2 and i % 29 == 0 or i % 58 == 0 and i % 4 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    learn = [(i, y) for i, _, y in rows if labelled_id(i, quality.MOD, quality.HELD)]
    got = labelled.present(docs, labels, "quality")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows)
    assert labelled.class_share(got, "quality", quality.MOD, quality.HELD) == sum(y for _, y in learn) / len(learn)
    # two a class, whichever of the 1,000 labelled ids come first in hash order
    ranker = quality.fit(docs, labels, per_class=2)
    assert {r.predicted == r.doc_id % 2 for r in quality.score(docs, ranker).collect()} == {True}
    assert toxicity.fit(docs, labels, per_class=2).ready


def labelled_id(i, mod, held):
    return zlib.crc32(str(i).encode()) % mod != held


def test_line_dedup(docs, empty):
    out = line_dedup.dedup(docs, count_col="gone")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS) and out.columns == [*docs.columns, "gone"]
    assert rows[1].text == BASE and rows[4].text == "" and rows[4].gone == 1
    assert rows[2].text is None and rows[3].text == "" and rows[6].text == ROWS[7][1] and rows[5].text == LONG
    # the exact copy and the line one word shorter go, short and unlike lines stay
    assert rows[7].text == "short one\nünï cödé 日本 🙂" and rows[None].text == "null id"
    assert line_dedup.dedup(empty).count() == 0


def test_shards(docs, empty):
    out = sharding.shard(docs, ["doc_id", "text"], shards=4, cell_rows=2)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"] and ids(rows) == ALL
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert sizes == [list(range(len(s))) for s in sizes] and {len(s) for s in sizes} <= {2, 3}
    assert sharding.shard(empty, ["doc_id"]).count() == 0


def test_byte_bpe(docs, empty):
    enc = tokens.encode(docs)
    got = enc.collect()
    want = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert ids(got) == ALL and tokens.encode(empty).count() == 0
    assert all(bytes(r.data) == want[r.doc_id] for r in tokens.decode(enc).collect())


def test_packing(docs, empty):
    rows = packing.pack(packing.pieces(docs)).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id}) == list(range(1, 8))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= packing.CAPACITY
    assert [r.length for r in rows if r.doc_id in (2, 3, 6)] == [1, 1, 1]
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_packing_groups_stay_bounded(spark, monkeypatch):
    # lengths that never add up to a full sequence: no round empties the pool, and none may gather it in one group
    def search(lengths, capacity):
        assert lengths.sum() <= 45_000, "a group far over group_tokens"
        return local_search(lengths, capacity)

    local_search = packing.local_search
    parts = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(2500).cast("long").alias("length"))
    monkeypatch.setattr(packing, "local_search", search)
    rows = packing.pack(parts, group_tokens=20_000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300))
    assert len({r.sequence_id for r in rows}) == 300 and {r.offset for r in rows} == {0}


def test_packing_rounds_lower_the_number_of_bins(spark):
    lengths = [2500] * 120 + [1596, 900, 696] * 40
    parts = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(parts, group_tokens=20_000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for bin_ in by.values():
        ends = [0, *(off + n for off, n in sorted(bin_))]
        assert [off for off, _ in sorted(bin_)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    assert len(by) <= 122        # 120 at least: no two of 2500 fit


def test_local_search_leaves_no_exchange():
    for seed in range(20):
        lengths, cap = np.random.default_rng(seed).integers(20, 60, 60), 100
        bin_of = packing.local_search(lengths, cap)
        fill = np.bincount(bin_of, lengths).astype(np.int64)
        if (fill > 0).sum() > -(-lengths.sum() // cap):
            for src in np.flatnonzero((fill > 0) & (fill < cap)):
                assert not packing._improve(lengths, bin_of.copy(), fill.copy(), cap, src)


def test_neighbours(spark):
    v = [1.0, 0.5, 0.25]
    rows = [(0, v, 9.0), (1, v, 9.0), (1, v, 9.0), (None, v, 9.0), (2, None, 9.0), (3, [0.0, 0.0, 0.0], 9.0), (4, [1.0, None, 0.0], 9.0),
            (5, [1.0, float("nan"), 0.0], 9.0), (6, [], 9.0), (7, [-1.0, 0.5, 0.25], 9.0), (8, [1.0, 2.0], 9.0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    out = neighbours.nearest(t, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in out] == [(1, 1), (2, 1), (3, None)] and all(abs(r.score - 1) < 1e-12 for r in out)
    assert neighbours.nearest(t.limit(0), F.col("vec_id") == 0).count() == 0
    all_of = neighbours.nearest(t, F.col("vec_id") == 0, k=10).collect()
    assert [r.vec_id for r in sorted(all_of, key=lambda r: r.rank)] == [1, 1, None, 7]


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0} and toxicity.score(empty, none).count() == 0


def test_warc(spark):
    rows = [(1, "u", "a", "x"), (2, "u u\n", "a", "x"), (3, None, None, "x"), (None, "x", "a", None), (5, "x", "", "x"),
            (5, "x", "", "x"), (6, "é", "ü" * 400_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = warc.write(pages)
    got = warc.read(spark, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 5), (5, "response", None),
        (5, "response", None), (6, "response", None)]
    assert {r.payload_bytes for r in got} == {0, 1, 800_000}
    one = warc.lookup(spark, folder, spark.createDataFrame([("<urn:page:6>",)], "record_id string")).collect()
    assert len(one) == 1 and one[0].block.endswith(("ü" * 400_000).encode())
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_warc_min_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(spark, warc.write(pages, min_bytes=2)).collect()}
    assert got == {1: "revisit", 2: "response", 3: "response", 4: "response"}


def test_rules(docs, empty):
    rows = {r.doc_id: r for r in line_rules.annotate(docs).collect()}
    assert rows[1].kept and rows[2].base_failed and rows[3].n_words == 0 and rows[6].n_words == 0
    out = line_rules.apply(docs, min_docs=2, max_share=0.1)
    assert out.columns == docs.columns
    # BASE is over the limit in host a: only its earliest document keeps it, the copies are depleted
    assert sorted(r.doc_id for r in out.collect() if r.source == "a") == [1]
    assert line_rules.apply(empty).count() == 0 and line_rules.annotate(empty).count() == 0


def test_simhash(docs, empty):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[4].component_id == 1 and {rows[i].component_id for i in (2, 3, 6)} == {2}
    assert rows[2].fingerprint == "0" * 16
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.component_fingerprint for r in rows.values()})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_held_out_rule(spark):
    got = quality.verdict(spark.createDataFrame([(i, 0.5) for i in range(40)], "doc_id long, score double"), 5, 0).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_forest_connects():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(3)]))
    edges = simhash._forest(fps, 3)
    assert len(edges) == len(fps) - 40
