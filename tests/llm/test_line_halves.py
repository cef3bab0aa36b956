"""The keys of a line's halves: cut once a line, and the same for every two lines within one edit."""

from pyspark.sql import functions as F

from telemetra.llm import line_dedup
from telemetra.llm.common import text_key


def test_words_are_counted_and_halves_cut_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("tx", text_key(F.col("text")))
    plan = line_dedup._lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("octet_length(replace(") == 1 and plan.count("substring_index(") <= 5


def test_lines_within_one_edit_share_a_half(spark):
    texts = []
    for n in (10, 11, 12, 13):
        words = [f"w{i}" for i in range(n)]
        for i in range(n):
            texts += [words[:i] + words[i + 1:], words[:i] + ["x"] + words[i + 1:], words[:i] + ["x"] + words[i:]]
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(-1, "one two"), (-2, " a  b c ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tx", text_key(F.col("text")))
    got = {r.doc_id: r.halves for r in line_dedup._lines(docs).collect()}
    assert -1 not in got and got[-2] is None
    assert all((got[i] is None) == (len(t) < 10) for i, t in enumerate(texts))

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    for i, a in enumerate(texts):
        for j in range(i):
            if got[i] and got[j] and near(a, texts[j]):
                assert set(got[i]) & set(got[j])
