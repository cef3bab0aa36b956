"""License scans: fuzzy search for short notices (operator 13).

Texts are read as words: ``A-Z`` lower-cased, split at everything in ASCII that is neither
letter nor digit, joined by one space. Two things are searched for in that form:

* phrases, found where their words stand consecutively, and
* notices, found with up to ``len(notice) // EDIT_EVERY`` edits of one character.

A notice with ``k`` edits allowed is cut into ``k + 1`` pieces. Wherever it occurs with at
most ``k`` edits, one piece occurs unchanged (pigeonhole), so one pass of an Aho-Corasick
automaton over phrases and pieces finds every place that can match. Around each piece
found, the ``regex`` library matches the notice with its error bound in a stretch of the
notice's length and ``k`` characters more on either side, and gives errors and span. A
match has to begin and end with whole words and hold the notice's key words unchanged: the
words that tell one license from the next (``mit``, a version number), marked by ``*``.
Of matches of different licenses that share a word only those with the fewest errors stay.

Per document: its number of words and ``matches``, each with label, notice, ``errors``,
``exact`` (a phrase), its first word and number of words (counted from 0), and its span in
the text as given (code points).

Defined cases: null and empty texts have no words and no match; texts of any length are
read whole; a repeated place counts each time, a phrase and a notice at one place are both
listed; rows that repeat give repeated results, an empty table an empty one. Other columns
aren't read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType)

EDIT_EVERY = 10        # one edit is allowed per so many characters of a notice
MEMO = 50_000          # distinct stretches whose matches a worker remembers

# Label and words of each phrase.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Label and words of each short notice; * marks words that have to be unchanged.
NOTICES = (
    ("mit", "under the *mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "*apache license version *2"),
    ("apache-2", "under the *apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "under the *bsd license"),
    ("gpl-2", "gnu general public license version *2"),
    ("gpl-3", "gnu general public license version *3"),
    ("lgpl", "gnu *lesser general public license"),
    ("agpl", "gnu *affero general public license"),
    ("mpl-2", "*mozilla public license version *2"),
    ("cc-by-nc", "licensed under cc by *nc"),
    ("cc-by-nc", "creative commons attribution *noncommercial"),
    ("cc-by-sa", "creative commons attribution *sharealike"),
    ("cc0", "dedicated to the *public domain under *cc0"),
)

# upper case to lower case, every other ASCII character that isn't a letter or digit to a space
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

MATCH = StructType([
    StructField("label", StringType()), StructField("notice", StringType()), StructField("errors", IntegerType()),
    StructField("exact", BooleanType()), StructField("first_word", LongType()), StructField("words", LongType()),
    StructField("start", LongType()), StructField("end", LongType())])


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` stretches that make up the notice, of nearly equal length, with their offsets."""
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(i, notice[i:j]) for i, j in zip(cut, cut[1:])]


class Scanner:
    def __init__(self, phrases, notices, edit_every: int):
        import ahocorasick
        import regex

        self.phrases, self.notices, seeds = phrases, [], {}
        for n, (_, words) in enumerate(phrases):
            seeds.setdefault(f" {words} ", []).append((True, n, 1))
        for n, (label, marked) in enumerate(notices):
            words = marked.replace("*", "")
            k = len(words) // edit_every
            fuzzy = regex.compile(rf"(?<![^ ])(?:{regex.escape(words, literal_spaces=True)}){{e<={k}}}(?![^ ])", regex.BESTMATCH)
            self.notices.append((label, words, k, fuzzy, [w[1:] for w in marked.split() if w[0] == "*"]))
            for at, piece in pieces(words, k):
                seeds.setdefault(piece, []).append((False, n, at))
        self.find = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.find.add_word(seed, (len(seed), uses))
        self.find.make_automaton()
        self.memo = {}

    def near(self, n: int, stretch: str) -> list[tuple[int, int, int]]:
        """Errors and span of each match of notice ``n`` in a stretch."""
        found = self.memo.get((n, stretch))
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            keys = self.notices[n][4]
            found = self.memo[n, stretch] = [
                (sum(m.fuzzy_counts), *m.span()) for m in self.notices[n][3].finditer(stretch, overlapped=True)
                if all(w in m.group().split(" ") for w in keys)]
        return found

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        words = (text or "").encode().translate(FOLD).split()
        if not words:
            return 0, []
        line = f" {b' '.join(words).decode()} "
        hits, tried = {}, set()
        for last, (size, uses) in self.find.iter(line):
            begin = last + 1 - size
            for exact, n, at in uses:
                if exact:
                    label, phrase = self.phrases[n]
                    hits[True, label, phrase, begin + 1, last] = 0
                elif (n, begin - at) not in tried:
                    tried.add((n, begin - at))
                    label, notice, k, _, _ = self.notices[n]
                    low = max(begin - at - k, 0)
                    high = min(begin - at + len(notice) + k, len(line))
                    # one character more on each side shows whether a word ends there
                    low, high = max(low - 1, 0), min(high + 1, len(line))
                    for errors, i, j in self.near(n, line[low:high]):
                        if (i or not low or line[low - 1] == " ") and (low + j == len(line) or line[low + j] == " "):
                            key = False, label, notice, low + i, low + j
                            hits[key] = min(errors, hits.get(key, errors))
        return len(words), self.placed(text, line, self.fewest(hits))

    @staticmethod
    def fewest(hits: dict) -> list[tuple]:
        """Phrases, and the notices' matches that no better match overlaps: one of the same notice with
        no more errors, or one of another license with fewer."""
        runs, end = [], 0
        for key in sorted(hits, key=lambda h: h[3:]):
            if not runs or key[3] >= end:
                runs.append([])
            runs[-1].append(key)
            end = max(end, key[4]) if len(runs[-1]) > 1 else key[4]
        kept = []
        for run in runs:                      # matches of different runs share no character
            taken = []
            for key in sorted(run, key=lambda h: (hits[h], not h[0], h)):
                exact, label, words, i, j = key
                better = any(x < j and i < y and (w == words if who == label else e < hits[key])
                             for who, w, x, y, e in taken)
                if exact or not better:
                    kept.append((i, j, label, words, hits[key], exact))
                    taken.append((label, None if exact else words, i, j, hits[key]))
        return sorted(kept)

    @staticmethod
    def placed(text: str, line: str, kept: list[tuple]) -> list[dict]:
        if not kept:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        out, at, first = [], 0, 0
        for i, j, label, words, errors, exact in kept:
            first += line.count(" ", at, i)      # word x begins after x + 1 spaces
            at = i
            n = line.count(" ", i, j) + 1
            out.append({"label": label, "notice": words, "errors": errors, "exact": exact, "first_word": first - 1,
                        "words": n, "start": spans[first - 1][0], "end": spans[first + n - 2][1]})
        return out


@lru_cache(maxsize=2)
def scanner(phrases: tuple, notices: tuple, edit_every: int) -> Scanner:
    return Scanner(phrases, notices, edit_every)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES,
         notices: tuple = NOTICES, edit_every: int = EDIT_EVERY) -> DataFrame:
    """Per row: ``doc_id``, ``n_words`` and ``matches``."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([src.schema["doc_id"], StructField("n_words", LongType()), StructField("matches", ArrayType(MATCH))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, find = to_arrow_schema(schema), scanner(phrases, notices, edit_every)
        for b in batches:
            found = [find.scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *(
                pa.array([x[i] for x in found], arrow.field(i + 1).type) for i in (0, 1))], schema=arrow)

    return src.mapInArrow(run, schema)


def report(scanned: DataFrame) -> DataFrame:
    """Per row of ``scan``: places of phrases, their first and last word, labels, and ``score``: the
    largest share of characters a match has unchanged (0 without a match)."""
    exact = F.filter("matches", lambda m: m["exact"])

    def joined(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform(exact, lambda m: m["first_word"])
    alike = F.transform("matches", lambda m: 1 - m["errors"] / F.length(m["notice"]))
    return scanned.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(exact).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(alike), F.lit(0.0)).alias("score"))
