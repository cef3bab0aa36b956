"""Quality rules with cross-document line frequency (operator 9). DataFrame functions only.

Per document: word and symbol counts, repeated lines and repeated 3-word windows.
A document fails the base rules with under ``MIN_WORDS`` words or with more than
half its words in repeated windows.

Per host: each line is normalised (lower case, white space collapsed, digits to 0)
and hashed, and the documents of the host that hold it are counted (once each). A
line is over the limit when at least ``min_docs`` documents and more than
``max_share`` of the host's documents hold it. It is then removed from all of them
but the earliest (smallest id), so that one copy of any text survives. A document
that loses more than ``max_removed`` of its words is depleted and rejected.

Counting groups by (host, line) with map-side combination, so a host with a third
of all rows, or a line in every document, costs one row per task. Only ids and
hashes are shuffled by ``annotate``; ``apply`` joins the decisions to the texts.

Defined cases: null text has no words (and fails the base rules); null hosts form
one host; rows that repeat both id and text count as one document; lines without
a word are never removed. Extra columns pass through ``apply`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import KEY, let, packed, row_key, stored, text_key, with_column, words_of

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_DOCS = 10
MAX_SHARE = 0.01
MAX_REMOVED = 0.7


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in ``words``."""
    def windows(w):
        three = F.slice(F.arrays_zip(w.alias("x"), F.slice(w, 2, F.size(w)).alias("y"), F.slice(w, 3, F.size(w)).alias("z")),
                        1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(F.transform(three, lambda s, i: F.struct(F.xxhash64(s["x"], s["y"], s["z"]).alias("h"), i.alias("i"))))

    def twice(s):
        at = F.transform(s, lambda x, i: F.when(
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def covered(at):
        each = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(let(words, windows), twice), covered)


def base_metrics(text: Column) -> dict[str, Column]:
    """The per-document counts and ``base_failed`` of one text column."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lined = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lined, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def normalised(line: Column) -> Column:
    """Lower case, white space collapsed, digits to 0."""
    collapsed = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.translate(F.lower(collapsed), "123456789", "000000000")


def _lines(text: Column) -> Column:
    """Per line: hash of its normalised form (null without a word) and its words."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: let(
        normalised(x), lambda n: F.when(n != "", F.struct(
            F.xxhash64(n).alias("h"), (F.length(n) - F.length(F.translate(n, " ", "")) + 1).alias("w")))))


def _flags(df: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, max_share: float) -> DataFrame:
    """Per document that loses lines: its key, the hashes removed and the words in them."""
    docs = df.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tx"),
                     F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                     F.col(host_col).isNull().alias("no_host"), F.col(text_col).alias("text"))
    held = stored(docs.select("doc_id", "tx", "host", "no_host", F.explode(F.filter(_lines(F.col("text")), lambda x: x.isNotNull())).alias("l"))
                  .select("doc_id", "tx", "host", "no_host", "l.h", "l.w")
                  .groupBy("doc_id", "tx", "host", "no_host", "h").agg(F.sum("w").alias("w")), "rules-lines")
    hosts = docs.select("doc_id", "tx", "host", "no_host").distinct().groupBy("host", "no_host").agg(F.count("*").alias("docs"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tx"))
    counted = held.groupBy("host", "no_host", "h").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") >= min_docs)
    over = stored(counted.join(hosts, ["host", "no_host"]).where(F.col("n") > max_share * F.col("docs"))
                  .select("host", "no_host", "h", F.col("first.doc_id").alias("f_id"), F.col("first.tx").alias("f_tx")), "rules-over")
    hit = held.join(over, ["host", "no_host", "h"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tx") == F.col("f_tx"))))
    return hit.select(*row_key(F.col("doc_id"), F.col("tx")), "h", "w").groupBy(*KEY).agg(
        F.collect_set("h").alias("removed"), F.sum("w").alias("removed_words"))


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED,
             payload: bool = False) -> DataFrame:
    """Per row of ``df``: doc_id, the counts, ``base_failed``, ``removed`` (hashes of the lines
    it loses, or null), ``removed_words`` and ``kept``; with ``payload`` also the input ``row``."""
    flags = stored(_flags(df, id_col, text_col, host_col, min_docs, max_share), "rules-flags")
    metrics = base_metrics(F.col(text_col))
    rows = df.select(F.col(id_col).alias("doc_id"), *row_key(F.col(id_col), text_key(F.col(text_col))),
                     *(c.alias(n) for n, c in metrics.items()),
                     *([packed(df)] if payload else []))
    # one join for every size: the flags grow with the table, so small ones aren't broadcast either
    joined = rows.join(flags.hint("merge"), KEY, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    depleted = F.col("removed_words") > max_removed * F.col("n_words")
    return (joined.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~depleted).drop(*KEY))


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows kept, with ``df``'s columns and the lines over the limit taken out of the text."""
    rows = annotate(df, id_col, text_col, host_col, payload=True, **limits).where("kept")
    text = F.col("row")[text_col]
    lines = F.arrays_zip(F.split(text, "\n").alias("line"), _lines(text).alias("of"))
    left = let(F.col("removed"), lambda gone: F.filter(lines, lambda x: ~F.coalesce(
        F.array_contains(gone, x["of"]["h"]), F.lit(False))))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    out = rows.select("row", cleaned.alias("cleaned")).select(
        *with_column(df.columns, "row", **{text_col: F.col("cleaned")}))
    return out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out
