"""Lines that are frequent on their host leave the texts, and the pipeline goes on without them."""

import corpus_pipeline
from pyspark.sql import functions as F

from flowgraph.llm import quality

NOTICE = "all rights reserved by the owners of this site and its many friends"


def own(i):
    return " ".join(f"word{i}x{k}" for k in range(20))


def rows():
    out = [(i, f"{own(i)}\n\n  {NOTICE.upper()} \n{own(-i - 1)}\n{NOTICE}\n", "a", -1) for i in range(30)]
    out += [(100, f"{NOTICE}\n{NOTICE}\nshort rest", "a", -1), (101, f"{own(101)}\n{NOTICE}", "b", -1)]
    return [*out, (102, f" {own(102)}\n\n\t\n", "a", 7), (3, out[3][1], "a", -1), (103, None, "a", None), (104, f"{NOTICE}\n{own(104)}", "a", -1)]


def test_frequent_lines_leave_the_text(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, n_chars long")
    found = corpus_pipeline.quality_rules(spark, docs, "").collect()
    got = {r.doc_id: (r.text, r.n_chars) for r in found}
    assert len(found) == len(got) + 1 and set(got) == {*range(30), 101, 102, 104}  # a repeated row stays repeated
    for i in range(30):
        text = f"{own(i)}\n\n{own(-i - 1)}\n"
        assert got[i] == (text, len(text))
    assert got[101] == (f"{own(101)}\n{NOTICE}", -1) and got[102] == (f" {own(102)}\n\n\t\n", 7)
    assert got[104] == (own(104), len(own(104)))


def test_measures_follow_the_clean_text(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, n_chars long")
    found = quality.quality(docs)
    left = F.size(quality.words(F.coalesce("clean_text", F.lit(""))))
    assert found.filter(F.col("n_words") - F.col("n_frequent_words") != left).count() == 0
    assert found.filter("doc_id = 103 AND clean_text IS NULL").count() == 1
