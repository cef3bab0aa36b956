"""Line dedup by a deletion-neighbourhood join (operator 2). DataFrame functions only.

Lines are compared normalised (lower case, white space collapsed), word by word. A
line of ``MIN_WORDS`` words or more goes if an earlier line equals it, or if both
have ``EDIT_WORDS`` words or more and differ by at most one word inserted, deleted or
replaced. Earlier: by document id, then line number; the earliest line stays, even
if a line between them goes too. Shorter lines always stay.

The neighbourhood of a line is itself and its variants with one word deleted. Two
lines are within one edit exactly if their variants at the same place are equal, or
one line equals a variant of the other. Variants are keyed by their length and a
position-dependent hash, from running XORs over the line's words, so a line of n
words costs n rows however long it is. Equal keys are joined to the earliest line
of the key, never pairwise, and the words are compared to verify the distance.

Only lines that could have a neighbour emit variants: within one edit, two lines
share either the first or the last half of the shorter one, so a line none of whose
halves occurs in another line is out. Copies collapse to one line first, and all
counting combines map-side, so a line in every document costs one row per task. The
texts of the remaining lines are fetched through a bit table of fixed size
(``BITS``), broadcast, that lets through few others; an exact join follows.

Defined cases: null text has no lines and stays null; rows that repeat id and text
are one document and change alike; null ids come last. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import KEY, let, packed, row_key, stored, text_key, with_column

MIN_WORDS = 3
EDIT_WORDS = 10
BITS = 1 << 22


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, tx, pos, h, halves`` of the lines that may go: their hash and, from ``EDIT_WORDS`` words on, the keys
    of the halves a line shares with any line within one edit: as the shorter, as the longer."""
    line, n, space = F.col("line"), F.col("n"), F.lit(" ")

    def up_to(text, words):
        return F.call_function("substring_index", text, space, words.cast("int"))

    def key(side, size, half):
        return F.xxhash64(F.lit(side), size, half)

    def shorter(half, sign):  # of a line with one word less; for an odd number of words the same half
        return F.when(n % 2 == 1, half).otherwise(up_to(half, sign * (F.floor(n / 2) - 1)))

    # each step is a column of its own, so that words are counted and halves cut once a line
    lines = _occurrences(docs).where(F.octet_length(up_to(line, F.lit(MIN_WORDS - 1))) < F.octet_length(line))
    lines = lines.withColumn("n", _n_words(line))
    lines = lines.withColumns({"head": F.when(n >= EDIT_WORDS, up_to(line, F.floor(n / 2))),
                               "end": F.when(n >= EDIT_WORDS, up_to(line, -F.floor(n / 2)))})
    keys = [key(0, n, F.col("head")), key(1, n, F.col("end")),
            key(0, n - 1, shorter(F.col("head"), 1)), key(1, n - 1, shorter(F.col("end"), -1))]
    return lines.select("doc_id", "tx", "pos", F.xxhash64("line").alias("h"), F.when(n >= EDIT_WORDS, F.array(*keys)).alias("halves"))


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, tx, pos, line`` (normalised: words with one space between) of every line with a word."""
    # the pattern is tried only on texts where white space is more than single spaces and line ends
    def spaced(low):
        odd = F.contains(low, F.lit("  "))
        for c in ("\t", "\x0b", "\x0c", "\r"):
            odd = odd | F.contains(low, F.lit(c))
        return F.when(odd, F.regexp_replace(low, "[ \t\x0B\x0C\r]+", " ")).otherwise(low)

    text = let(F.lower("text"), spaced)
    lines = docs.select("doc_id", "tx", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where("line != ''")


def _drop_at(words: Column, i: Column) -> Column:
    return F.when(i == 0, words).otherwise(
        F.concat(F.slice(words, 1, F.greatest(i - 1, F.lit(0))), F.slice(words, i + 1, F.size(words))))


def _near(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Hashes ``h`` of the distinct lines ``reps`` that have an earlier line within one edit."""
    halves = reps.where("halves is not null").select("h", F.explode("halves").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("half"), "lines-halves")
    cand = stored(halves.join(shared, "half", "left_semi").select("h").distinct(), "lines-candidates")

    # the words of the candidates: a bit table of fixed size first, then exactly
    def slot(h):
        return F.pmod(h, F.lit(BITS))

    bits = cand.groupBy(F.shiftright(slot(F.col("h")), 6).alias("slot")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) & 63 as int))")).alias("bits"))  # BITS / 64 rows at most
    lines = _occurrences(docs).select(F.xxhash64("line").alias("h"), "line")
    likely = (lines.withColumn("slot", F.shiftright(slot(F.col("h")), 6)).join(F.broadcast(bits), "slot")
              .where(f"getbit(bits, cast(pmod(h, {BITS}) & 63 as int)) = 1").select("h", "line"))
    # an inner join: a semi-join would be pushed below the bit table
    texts = stored(likely.join(cand, "h").groupBy("h").agg(F.first("line").alias("line"))
                   .select("h", F.split("line", " ").alias("words")), "lines-words")

    # one row per variant: key (length, hash) and the place deleted; place 0 is the line itself
    at = F.posexplode("words").alias("i0", "w")
    words = texts.select("h", F.size("words").alias("n"), at).withColumn("i", F.col("i0") + 1)
    words = words.select("h", "n", "i", F.xxhash64("w", "i").alias("g"), F.xxhash64("w", F.col("i") - 1).alias("left"))
    whole, run = Window.partitionBy("h"), Window.partitionBy("h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    keyed = words.select("h", "n", "i", "g", F.bit_xor("g").over(run).alias("head"), F.bit_xor("g").over(whole).alias("all"),
                         F.bit_xor("left").over(whole).bitwiseXOR(F.bit_xor("left").over(run)).alias("tail"))
    deleted = keyed.select("h", (F.col("n") - 1).alias("n"), "i",
                           F.col("head").bitwiseXOR(F.col("g")).bitwiseXOR(F.col("tail")).alias("v"))
    itself = keyed.where("i = 1").select("h", "n", F.lit(0).alias("i"), F.col("all").alias("v"))
    every = stored(deleted.union(itself), "lines-variants")
    shared = stored(every.groupBy("n", "v").agg(F.count("*").alias("c")).where("c > 1").select("n", "v"), "lines-shared")
    variants = stored(every.join(shared, ["n", "v"]).join(reps.select("h", "first"), "h"), "lines-first")

    some = variants.where("i > 0")
    place = stored(some.groupBy("n", "v", "i").agg(F.min(F.struct("first", "h")).alias("m"), F.count("*").alias("c"))
                   .where("c > 1").select("n", "v", "i", F.col("m.h").alias("e")), "lines-places")
    plain = variants.where("i = 0").select("n", "v", F.col("h").alias("e"), F.col("first").alias("e_first"))
    met = stored(some.join(plain, ["n", "v"]), "lines-met")
    pairs = (some.join(place, ["n", "v", "i"]).where("h != e").select("h", "i", "e", F.col("i").alias("j"))
             .union(met.where("e_first < first").select("h", "i", "e", F.lit(0)))
             .union(met.groupBy("e", "e_first").agg(F.min(F.struct("first", "h", "i")).alias("m")).where("m.first < e_first")
                    .select(F.col("e").alias("h"), F.lit(0).alias("i"), F.col("m.h").alias("e"), F.col("m.i").alias("j"))))
    pairs = stored(pairs.distinct(), "lines-pairs")
    checked = (pairs.join(texts, "h").withColumnRenamed("words", "own")
               .join(texts.select(F.col("h").alias("e"), F.col("words").alias("other")), "e"))
    return checked.where(_drop_at(F.col("own"), F.col("i")) == _drop_at(F.col("other"), F.col("j"))).select("h").distinct()


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key_id, key_null, key_text`` and ``removed`` (line numbers from 0) of each document that loses lines."""
    docs = df.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tx"), F.col(text_col).alias("text"))
    lines = stored(_lines(docs), "lines-all")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tx", "pos")
    reps = stored(lines.groupBy("h").agg(F.min(order).alias("first"), F.count("*").alias("c"), F.first("halves").alias("halves")), "lines-distinct")
    near = _near(docs, reps).withColumn("near", F.lit(True))
    dups = stored(reps.select("h", "first", "c").join(near, "h", "left").where("c > 1 or near")
                  .select("h", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-repeated")
    gone = lines.select("h", "doc_id", "tx", "pos", order.alias("at")).join(dups, "h").where("near or at != first")
    return gone.groupBy(*row_key(F.col("doc_id"), F.col("tx"))).agg(F.collect_set("pos").alias("removed"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with the repeated lines taken out of its texts; ``count_col`` adds how many went."""
    gone = stored(removed_lines(df, id_col, text_col), "lines-removed")
    rows = df.select(packed(df), *row_key(F.col(id_col), text_key(F.col(text_col))))
    # one join for every size: what goes grows with the table, so a small part isn't broadcast either
    joined = rows.join(gone.hint("merge"), KEY, "left")
    text = F.col("row")[text_col]
    stay = let(F.split(text, "\n"), lambda x: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(stay, "\n"))
    new = {text_col: F.col("cleaned")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.length("cleaned").cast(df.schema["n_chars"].dataType)
    extra = [F.coalesce(F.size("removed"), F.lit(0)).alias(count_col)] if count_col else []
    return joined.select("row", "removed", cleaned.alias("cleaned")).select(*with_column(df.columns, "row", **new), *extra)
