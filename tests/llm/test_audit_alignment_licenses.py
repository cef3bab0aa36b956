"""Filter audit, token alignment and license scan: brute force, and nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemetra.llm import filter_audit, license_scan, token_alignment
from telemetra.llm.tokens import byte_alphabet

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, mask int, part string, chunk long, codes string, n long, matches string, `a.b` int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
TEXTS = [(1, "The MIT License and more", "a"), (2, None, "a"), (3, "", None), (4, "The MIT License and more", "b"),
         (4, "The MIT License and more", "b"), (None, "The MIT License and more", "b"), (5, LONG, ""), (6, " \t\n ", "b"),
         (7, "ünï cödé 日本 🙂 & under the MIT-license", "b"), (8, "x" * 30_000, "b"), (9, "a▁b <s> <|endoftext|>", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 1, "p", 2, "c", 3, "m", 4) for i, t, s in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def audit_of(rows, labels):
    """Plain Python audit of ``(doc_id, text, source)`` rows; ids may be null (larger than all others)."""
    least, marks = {}, defaultdict(lambda: [0, 0])
    for i, t, _ in rows:
        key = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", key), key)
    for i, q, x in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    out = {}
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)), (i is None, i or 0) > least[t])) if bad}
        good, toxic = marks[i] if i is not None else (0, 0)
        for order in itertools.permutations("ABCDE"):
            here = True
            for step, f in enumerate(order, 1):
                c = out.setdefault((s or "", "".join(order), step), Counter())
                c["kept"] += here and f not in fails
                c["removed"] += here and f in fails
                c["redundant"] += not here and f in fails
                c["unique_fails"] += fails == {f}
                c["good_lost"] += good if here and f in fails else 0
                c["toxic_lost"] += toxic if here and f in fails else 0
                here = here and f not in fails
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {k: {**{n: c[n] for n in filter_audit.COUNTS}, "shapley": shapley[k[0], k[1][k[2] - 1]]} for k, c in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): {n: r[n] for n in [*filter_audit.COUNTS, "shapley"]}
            for r in filter_audit.audit(docs, labels).collect()}


def test_audit_is_the_plain_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert audited(docs, labels) == audit_of(rows, [tuple(r) for r in labels.collect()])


def test_audit_edges(spark, docs, empty):
    marks = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (5, None, 1), (77, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert audited(docs, labels) == audit_of(TEXTS, marks)
    assert audited(empty, labels) == {}
    assert audited(docs, labels.where("false")) == audit_of(TEXTS, [])


def test_audit_survives_a_text_in_every_part(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}", f"h{i % 50}") for i in range(600)]
    got = filter_audit.cells(spark.createDataFrame(rows, "doc_id long, text string, source string"),
                             spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sum(r.n for r in got) == 600 and sum(r.n for r in got if r["mask"] & 16) == 399


def spelt():
    t = Tokenizer.from_file(public_tokenizers.path(token_alignment.BYTES))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.PIECES))
    back = {c: i for i, c in enumerate(byte_alphabet())}

    def both(text):
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode())
             for i in s.encode(text) for p in [s.id_to_piece(i)]]
        return a, b
    return both


def alignment_of(rows):
    """Plain Python alignment: one owner per byte on either side, links where bytes meet."""
    both, found, held = spelt(), [], Counter()
    for i, text in rows:
        a, b = both(text) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if not text or any(b"".join(x for _, x in side) != want for side in (a, b)):
            found.append((i, None))
            continue
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = [(a[x][0], b[y][0]) for x, y in dict.fromkeys(zip(*owner))]
        ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut, k) + 1 for e, k in zip(ends, at)]
            groups.append("|".join(",".join(str(x) for x, _ in side[f:u]) for side, f, u in zip((a, b), at, to)))
            at = to
        found.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
        held.update(set(links))
    high = defaultdict(int)
    for (x, _), n in held.items():
        high[x] = max(high[x], n)
    rows = [(i, 0, 0, 0, 0, 0, 0, "") if f is None else
            (i, *f[:3], len(f[3]), sum(held[p] == high[p[0]] for p in f[3]), sum(held[p] for p in f[3]), f[4]) for i, f in found]
    return sorted(rows, key=str), {(*p, n, n == high[p[0]]) for p, n in held.items()}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check_alignment(df, rows):
    out, pairs = token_alignment.align(df)
    want, counts = alignment_of(rows)
    assert out.columns == COLUMNS
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert {tuple(r) for r in pairs.select("a_id", "b_id", "docs", "best").collect()} == counts


def test_alignment_is_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    check_alignment(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_edges(docs, empty):
    check_alignment(docs.drop("a.b"), [(i, t) for i, t, _ in TEXTS])
    check_alignment(empty, [])
    check_alignment(docs.where("text is null"), [(2, None)])


def test_alignment_of_made_texts_and_small_chunks(spark):
    rng = random.Random(5)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "日", "🙂", "▁", "<0x41>", "</s>", "ing", " the", " ", "́", "0", "'s"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(400)]
    al = token_alignment.Aligner(token_alignment.BYTES, token_alignment.PIECES)
    for _, t in rows:                          # windows put together are the document
        for tokens in al.tokens([t]):
            if tokens is not None:
                parts = [x.split(b"\xff\xff\xff\xff") for x in al.windows(*tokens, [0])[0]]
                assert b"".join(p[0] for p in parts) == tokens[0].tobytes() and b"".join(p[1] for p in parts) == tokens[1].tobytes()
    check_alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_alignment_of_long_runs():
    al = token_alignment.Aligner(token_alignment.BYTES, token_alignment.PIECES)
    library = Tokenizer.from_file(public_tokenizers.path(token_alignment.BYTES))
    for text in ("x" * 5000, "a " + " " * 5000 + "b", "1" * 4000 + "\n" * 4000, "日本" * 3000):
        assert al.a.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_chunks_of_any_size_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    al = token_alignment.Aligner(token_alignment.BYTES, token_alignment.PIECES)
    whole, parts = token_alignment.Chunk(0), token_alignment.Chunk(1)
    tokens = list(al.tokens([t for _, t in rows]))
    whole.add([i for i, _ in rows], tokens, al)
    for (i, _), t in zip(rows, tokens):
        parts.add([i], [t], al)
    assert [r[:6] for r in whole.rows] == [r[:6] for r in parts.rows]
    assert {c: whole.docs[n] for c, n in whole.pair.items()} == {c: parts.docs[n] for c, n in parts.pair.items()}


def plain_matches(text, notice, k):
    """Smallest number of edits of a run of whole words within ``k`` of the notice; None if none is."""
    words = re.findall(r"[0-9a-z]+", text.lower())
    best = None
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 3 + 2 * notice.count(" ")) + 1):
            run = " ".join(words[i:j])
            if abs(len(run) - len(notice)) <= k:
                row = list(range(len(notice) + 1))
                for x, c in enumerate(run, 1):
                    last, row = row, [x]
                    for y, d in enumerate(notice, 1):
                        row.append(min(last[y] + 1, row[-1] + 1, last[y - 1] + (c != d)))
                if row[-1] <= k and (best is None or row[-1] < best):
                    best = row[-1]
    return best


def test_fuzzy_notices_are_all_found():
    rng = random.Random(11)
    notices = tuple((f"l{n}", words) for n, words in enumerate((
        "under the old oak license", "granted free of charge to any person", "some general public terms version two")))
    filler = "this text says nothing of use and was free under version any".split()
    for _ in range(150):
        label, notice = rng.choice(notices)
        made = list(notice)
        for _ in range(rng.randrange(6)):
            at, how = rng.randrange(len(made)), rng.randrange(3)
            made[at:at + (how != 0)] = [] if how == 1 else [rng.choice("abc xyz")]
        text = " ".join([*rng.choices(filler, k=rng.randrange(8)), "".join(made), *rng.choices(filler, k=rng.randrange(8))])
        one = license_scan.Scanner((), ((label, notice),), 10)
        _, found = one.scan(text)
        got = min((m["errors"] for m in found), default=None)
        assert got == plain_matches(text, notice, len(notice) // 10), (text, notice)


def base_of(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = sorted((i, label) for label, phrase in license_scan.PHRASES for p in [phrase.split(" ")]
                    for i in range(len(words)) if words[i:i + len(p)] == p)
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


def check_licenses(df, rows):
    got = license_scan.report(license_scan.scan(df)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == \
        sorted(str((i, *base_of(t))) for i, t in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "") and (r.score == 1 if r.n_base else True)
    return {r.doc_id: r for r in got}


def test_licenses_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_licenses(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_licenses_edges(spark, docs, empty):
    rows = check_licenses(docs, [(i, t) for i, t, _ in TEXTS])
    assert rows[7].labels == "mit" and rows[7].n_base == 1 and rows[1].n_base == 0
    check_licenses(empty, [])
    texts = [(1, "CC BY NC by nc cc-by-nc" * 2), (2, "under the MIT License, " * 3000), (3, "İ under the mit license K"),
             (4, "released undr the MIT licence"), (5, "under the BIT license"), (6, "gnu general public license version 3 or 2"),
             (7, "Apache License, Version 3.0"), (8, "cc by nd"), (9, "GNU LESSER general publik license")]
    rows = check_licenses(spark.createDataFrame(texts, "doc_id long, text string"), texts)
    assert rows[2].n_base == 3000 and rows[4].labels == "mit" and 0.9 <= rows[4].score < 1
    assert [rows[i].labels for i in (5, 6, 7, 8, 9)] == ["", "gpl-3", "", "", "lgpl"]


def test_spans_are_of_the_text_given(spark):
    text = "Ünder — Under  the\nMIT (license): yes. Lcensed under CC BY-NC 4.0"
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.explode("matches")).select("col.*")
    spans = {(r.label, text[r.start:r.end], r.errors) for r in found.collect()}
    assert spans == {("mit", "Under  the\nMIT (license", 0), ("cc-by-nc", "Lcensed under CC BY-NC", 1), ("cc-by-nc", "CC BY-NC", 0)}
