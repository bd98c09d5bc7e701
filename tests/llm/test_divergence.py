"""Source divergence against plain counting and Python's whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowgraph.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _plain(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = _terms(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [g[1] for g in groups if g[0] == lang]

        def shares(n):
            total = sum(n[t] for t in kept) + len(kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (n[t] + 1) // total for t in kept}  # noqa: B023

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def _rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_pointers_sort_and_count_like_a_dictionary():
    rng = np.random.default_rng(4)
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "abcdefgh" * 3 + "z", "é", "日本語日本語日本語", "Zz", "zz"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) + rng.choice(["", "!", " 12 "]) for _ in range(200)]
    data = "".join(texts).encode()
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    groups = rng.integers(0, 5, len(texts))
    terms, place, group, times, docs = divergence.slice_counts(np.frombuffer(data, np.uint8), bounds, groups)
    names = terms.to_pylist()
    assert names == sorted(set(names), key=str.encode)
    expected, spread = Counter(), Counter()
    for text, g in zip(texts, groups.tolist(), strict=True):
        expected.update((t, g) for t in _terms(text))
        spread.update((t, g) for t in set(_terms(text)))
    keys = [(names[i], g) for i, g in zip(place.tolist(), group.tolist(), strict=True)]
    assert dict(zip(keys, times.tolist(), strict=True)) == expected
    assert dict(zip(keys, docs.tolist(), strict=True)) == spread


def test_shares_beyond_64_bits():
    counts, totals = np.array([[0, 10**12, 10**17]]), np.array([3, 10**12 + 7, 10**18 + 9])
    expected = [1 + (c + 1) * 10**9 // t for c, t in zip(counts[0].tolist(), totals.tolist(), strict=True)]
    assert divergence._shares(counts, totals).tolist() == [expected]


def test_query_equals_plain_counts(spark, documents):
    expected = _plain([(r.text, r.lang, r.source) for r in documents.select("text", "lang", "source").collect()])
    assert _rows(divergence.op13_divergence(spark, "/root/testdata/sf0.001")) == expected


ROWS = [
    ("One two THREE three", "en", "a"), ("one two", "en", "b"), ("two one", "en", "c"), ("one", "en", None),
    (None, "en", "quiet"), ("", None, None), ("  12 ", None, "x"), ("Ünd É é é", "de", "a"), ("é", "de", "a"), ("é", "de", "a"),
    ("lone", "fr", "only"), ("word" * 5000, "en", "b"), ("one two three " * 400, "en", "b"), ("x\x00y\x7fone", "en", "c"),
]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 64])
def test_awkward_rows(spark, slice_bytes):
    schema = "text string, lang string, source string, term string, item string, value string, rank string, place string, n string"
    df = spark.createDataFrame([(*r, *[None] * 6) for r in ROWS], schema)
    assert _rows(divergence.divergence(df, slice_bytes=slice_bytes)) == _plain(ROWS)
    assert divergence.divergence(df.limit(0)).collect() == []
    nothing = df.selectExpr("CAST(NULL AS STRING) AS text", "lang", "source")  # groups, but no terms
    assert _rows(divergence.divergence(nothing)) == _plain([(None, x, s) for _, x, s in ROWS])


def test_more_sources_than_a_tile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["u", "v", "w", "x", "y"], 6)), "en" if i % 3 else "de", f"s{i % 11}") for i in range(150)]
    monkeypatch.setattr(divergence._pairs, "__defaults__", (4,))
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert _rows(divergence.divergence(df)) == _plain(rows)
