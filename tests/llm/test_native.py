"""Exact dedup, quality rules, URL filters: SQL equivalents, awkward rows, fixtures where the rules bite."""

import random

import numpy as np
import pytest
from check import compare, open_oracle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowgraph.llm import exact_dedup, quality, url_filter
from flowgraph.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, oracle, name):
    assert compare(spark, oracle, name, SF) is None


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_dedup(rows, found):
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    kept = {}
    for r in found:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    sizes = sorted((max((i for i in g if i is not None), default=None) or -1, len(g)) for g in groups.values())
    assert sorted({(r.text_sha256, r.keep_id or -1, r.group_size) for r in found}, key=lambda x: x[1:]) and sizes == sorted(
        (k, n) for _, k, n in {(r.text_sha256, r.keep_id or -1, r.group_size) for r in found}
    )


def test_dedup_awkward(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    check_dedup(rows, exact_dedup.exact_dedup(awkward).collect())
    carried = exact_dedup.exact_dedup(awkward, carry=True).filter("kept").select("_row.*")
    assert carried.columns == awkward.columns and carried.count() == len({lower(t) for _, t in rows})


def test_dedup_empty(awkward):
    assert exact_dedup.exact_dedup(awkward.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(awkward.limit(0), carry=True).count() == 0


def test_dedup_of_a_text_that_a_third_of_rows_have(spark):
    rows = [(i, "Hot Text" if i % 3 == 0 else f"text {i // 2 if i < 900 else i}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_dedup(rows, exact_dedup.exact_dedup(df).collect())
    carried = exact_dedup.exact_dedup(df, carry=True)
    check_dedup(rows, carried.collect())
    assert [r.doc_id for r in carried.filter("kept AND _row.text = 'Hot Text'").collect()] == [2_997]


def test_dedup_needs_one_exchange_of_the_texts(documents, capsys):
    found = exact_dedup.exact_dedup(documents)
    found.explain()
    plan = capsys.readouterr().out.partition("Initial Plan")[0]
    assert "ArrowEval" not in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert plan.count("rangepartitioning(_key") == 1


def test_quality_awkward(awkward):
    found = quality.quality(awkward).collect()
    assert len(found) == awkward.count()
    by = {(r.doc_id, r.n_words) for r in found}
    assert (3, 0) in by and (4, 0) in by and (9, 0) in by and (5, 2) in by
    assert all(r.base_failed and not r.kept for r in found if r.n_words < 10)
    assert quality.quality(awkward.limit(0)).count() == 0


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("seed", range(3))
def test_repeated_windows(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["z " * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.document_measures(df).collect():
        w = words(texts[r.doc_id])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)} if len(w) < 100 else set(range(len(w)))
        assert r.n_repeat_words == len(covered), texts[r.doc_id]


def test_frequent_lines_deplete_a_document(spark):
    notice = "all rights reserved by the owners of this site and its many friends"
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(20))
    rows = [(i, f"{own(i)}\n{notice}", "a") for i in range(30)]
    rows += [(100, f"{notice}\n  {notice.upper()} \nshort rest", "a"), (101, f"{notice}\n{notice}\nshort rest", "b")]
    rows += [(200 + i, f"{own('copy')}\n{own('copies')}", "c") for i in range(40)]  # copies of one text are one
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not found[100].kept and found[100].n_frequent_words == 26 and found[101].n_frequent_words == 0
    assert all(found[i].kept and found[i].n_frequent_words == 13 for i in range(30))
    assert all(found[200 + i].kept for i in range(40))


def test_the_limit_of_lines_does_not_rise_with_the_host(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(20))
    often, seldom = "read more about this in our large archive", "a line that only some pages of the host have"
    rows = [(i, own(i) + (f"\n{often}" if i < 21 else "") + (f"\n{seldom}" if i < 20 else ""), "a") for i in range(2_000)]
    rows += [(9000, f"{often}\n{own('few')[:60]}", "a")]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [found[i].n_frequent_words for i in (0, 20, 21, 1999)] == [8, 8, 0, 0]
    assert all(found[i].kept for i in range(2_000)) and not found[9000].kept and not found[9000].base_failed


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/x?q#f", "http://www.example.com/en/", "https://a.b.net/es/1", "x://net/fr/",
            "http://xnet/es/", "http://example.com", "http://casino.org/a", "HTTP://casino.org/A", "a://b://c/d", "http://é.com/\n?"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, None, None)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("casino.org/a",), (None,), ("not seen",)], "key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, listed).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("example.com", "/en/x", "example.com/en/", "block")
    assert found[4] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert found[5][2:] == ("net/es/", "block") and found[6] == ("net", "/fr/", "net/fr/", "block")
    assert found[7][2:] == (None, "allow") and found[8] == ("example.com", "", None, "allow")
    assert found[9][2:] == (None, "block") and found[10][2:] == (None, "allow")
    assert found[11][:2] == ("b:", "//c/d") and found[12] == ("é.com", "/\n", "com/", "allow")
    assert url_filter.judge_urls(pages.limit(0), listed.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.03, 0.5, 1.0])
def test_cascade_is_exact_over_its_universe(spark, share):
    rng = random.Random(5)
    keys = [(f"k{i}", rng.random() < share) for i in range(3_000)]
    df = spark.createDataFrame(keys * 2, "key string, inside boolean")
    listed = df.filter("inside").select("key")
    n = listed.distinct().count()
    assert not n or url_filter.cascade_parts(n, len(keys) - n, 600) > 1
    for most in (url_filter.MAX_FILTER_BYTES, 600):  # by one cascade, and by one for each part of the keys
        told = url_filter.with_listed(df, F.col("key"), listed, max_bytes=most)
        assert told.filter("listed <> inside").count() == 0 and told.count() == len(keys) * 2
        some = url_filter.with_listed(df.limit(1).union(df.limit(1).select(F.lit(None), "inside")), F.col("key"), listed, max_bytes=most)
        assert some.filter("key IS NULL AND NOT listed").count() == 1


@pytest.mark.parametrize("n, others", [(50, 5_000), (3_000, 3_000), (4_000, 100), (900, 0)])
def test_cascades_stay_under_their_bound(spark, n, others):
    keys = spark.range(n + others).select(url_filter.hashed(F.col("id").cast("string")).alias("h"), (F.col("id") < n).alias("listed"))
    levels = url_filter.build_cascade(keys.select("h.h1", "h.h2", "listed"))
    assert url_filter.cascade_parts(n, others, sum(x.size // 8 for x in levels)) >= 1
    assert url_filter.cascade_parts(n, others, 2 * sum(x.size // 8 for x in levels) + 1_000) == 1


def test_cascade_levels_alternate(spark):
    keys = spark.range(5_000).select(url_filter.hashed(F.col("id").cast("string")).alias("h"), (F.col("id") % 4 == 0).alias("listed"))
    keys = keys.select("h.h1", "h.h2", "listed")
    levels = url_filter.build_cascade(keys)
    assert len(levels) > 2 and [x.number for x in levels] == list(range(len(levels)))
    got = keys.toArrow()
    told = url_filter.is_listed(levels, got.column("h1").to_numpy(), got.column("h2").to_numpy())
    assert np.array_equal(told, got.column("listed").to_numpy(zero_copy_only=False))
