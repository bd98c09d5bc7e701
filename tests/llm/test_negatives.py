"""Hard-negative mining against plain loops."""

import math

import numpy as np
import pytest

from flowgraph.llm import negatives

SF = "/root/testdata/sf0.001"


def _plain(rows, relabel=True, step=100):
    """All pairs, in Python's whole numbers."""
    kept = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((i, [math.floor(256 * c) for c in x], (label + 1) % 10 if relabel and i % 7 == 0 else label))
    out = []
    for i, x, label in sorted({(i, tuple(x), label) for i, x, label in kept if i % step == 0}):
        scored = [(sum(p * q for p, q in zip(x, y, strict=False)), j, other) for j, y, other in kept if j != i]
        first = sorted((-s, j) for s, j, other in scored if other == label)[:5]
        for place, (s, j) in enumerate(first):
            inside = sorted((-t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * t <= 100 * -s)[:5]
            out += [(i, j, n + 1, k, -s, -t, place + 1) for n, (t, k) in enumerate(inside)]
    return sorted(out)


def _rows(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (16, 16, 16), (33, 64, 70), (17, 0, 20), (100, 65, 129)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**25), 2**25, (m, k)), rng.integers(-(2**25), 2**25, (k, n))
    assert np.array_equal(negatives.strassen(a, b), a @ b)
    if k:  # sums between that pass 64 bits do no harm
        a[:], b[:] = 0, 0
        a[:, 0], b[0, :] = 2**62, 1
        assert np.array_equal(negatives.strassen(a, b), a @ b)


def test_heaps_merge_like_a_sort():
    rng = np.random.default_rng(2)
    whole, halves = negatives.Heaps(7, 3), [negatives.Heaps(7, 3), negatives.Heaps(7, 3)]
    seen = {g: [] for g in range(7)}
    for turn in range(20):
        groups = rng.permutation(7)[:4]
        scores, ids = rng.integers(0, 6, (4, 11)), rng.integers(0, 50, 11)
        allowed = rng.random((4, 11)) < 0.5
        for heap in (whole, halves[turn % 2]):
            heap.offer(groups, scores, ids, allowed)
        for r, g in enumerate(groups):
            seen[g] += [(-scores[r, c], ids[c]) for c in range(11) if allowed[r, c]]
    halves[0].merge(*halves[1].entries())
    for heap in (whole, halves[0]):
        found = {g: [] for g in range(7)}
        for g, s, i in zip(*heap.entries(), strict=True):
            found[g].append((-s, i))
        assert found == {g: sorted(x)[:3] for g, x in seen.items()}


def test_query_equals_all_pairs(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    assert _rows(negatives.op11_negatives(spark, SF)) == _plain([tuple(r) for r in given.collect()])


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, i % 3) for i in range(120)]  # one vector with many ids
    rows += [(3000, [0.5] * 8, 0)] * 3 + [(200, [0.5] * 8, 1)] * 2  # rows repeated, and an id with several vectors
    rows += [(400, None, 1), (500, [1.0, None], 1), (600, [1.0, float("nan")], 1), (700, [float("inf")], 1), (None, [1.0], 1), (800, [1.0], None)]
    rows += [(900, [], 0), (901, [1.0, 2.0], 0), (902, [-1.0] * 12, 1)]  # other lengths
    schema = "vec_id long, embedding array<float>, label int, anchor string, score string, x string, rank string"
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema)
    expected = _plain([(i, x and [None if c is None else float(np.float32(c)) for c in x], label) for i, x, label in rows], relabel=False)
    found = negatives.mine(negatives.vectors(df))
    assert _rows(found) == expected
    assert _rows(negatives.mine(negatives.vectors(df), anchor_bytes=2048)) == expected  # in several parts
    assert negatives.mine(negatives.vectors(df.limit(0))).collect() == []
    assert negatives.mine(negatives.vectors(df.filter("vec_id % 100 <> 0"))).collect() == []


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(100, [1e9] * 4, 1), (101, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(negatives.vectors(df)).collect()
