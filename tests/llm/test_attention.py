"""Scores of texts: counts against plain Python, the model against loops and numeric slopes."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowgraph.llm import attention
from flowgraph.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "One two\tTHREE\n\n three ", "\x0b\x0cend\r", "É é  x ½", "a\x00b", " lead", "z" * 300]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_units_are_the_words():
    found = attention.units(pa.array(TEXTS, pa.large_string()))
    assert found.to_pylist() == [[f" {w}" for w in _words(t)] for t in TEXTS]
    assert attention.units(pa.array(TEXTS, pa.large_string()).slice(2, 3)).to_pylist() == [[f" {w}" for w in _words(t)] for t in TEXTS[2:5]]


def test_cutting_words_takes_a_few_times_the_text():
    texts = pa.array(["some words of a text " * 40_000] * 3, pa.large_string())
    tracemalloc.start()
    found = attention.units(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.flatten()) == 600_000
    assert peak < 12 * texts.nbytes


def test_words_are_counted_over_several_steps(spark):
    rows = spark.range(3).selectExpr("id AS doc_id", "repeat('a b ', 700000) AS text").coalesce(1)  # a step for each text
    assert {r.unit: r.c for r in attention.word_counts(rows).collect()} == {" a": 2_100_000, " b": 2_100_000}
    assert attention.word_counts(rows.limit(0)).collect() == []


@pytest.fixture(scope="module")
def model():
    counts = np.random.default_rng(1).integers(0, 50, 6000)
    ids = attention.Ids.of(counts)
    flat = attention.start(ids.counts).astype(np.float64)
    return ids, flat + np.random.default_rng(2).normal(0, 0.1, len(flat))


def _plain_log_prob(p, before, target):
    """Log-probability of a model id after others (the two begins first), by loops."""
    e = [p["now"][before[i]] + p["before"][before[i - 1]] + p["place"][i - 1] for i in range(1, len(before))]
    q = e[-1] @ p["query"]
    weights = [math.exp(q @ (x @ p["key"]) / math.sqrt(attention.SIZE)) for x in e]
    o = sum(w * (x @ p["value"]) for w, x in zip(weights, e, strict=True)) / sum(weights)
    h = e[-1] + o @ p["back"]
    h = h + np.maximum(h @ p["wide"] + p["wide_bias"], 0) @ p["narrow"]
    x = h @ p["classes"] + p["class_bias"]
    kind = target // attention.CLASS_IDS
    out = x[kind] - math.log(sum(math.exp(v) for v in x))
    if kind < attention.CLASSES:
        x = h @ p["inner"][kind] + p["inner_bias"][kind]
        out += x[target % attention.CLASS_IDS] - math.log(sum(math.exp(v) for v in x))
    return out


def test_scores_equal_loops_and_every_id_counts_once(model):
    ids, flat = model
    rng = np.random.default_rng(3)
    lengths = [0, 1, 5, attention.WINDOW - 1, attention.WINDOW, attention.WINDOW + 1, 100]
    texts = [rng.integers(0, 5999, n) for n in lengths]
    sequence, bounds, inside = ids.sequences(np.concatenate(texts), np.cumsum(lengths))
    rows, owner, counted = attention.windows(sequence, bounds)
    assert np.bincount(owner, counted.sum(axis=1)).astype(int).tolist() == [n + 1 for n in lengths]
    found = np.bincount(owner, attention.log_probs(flat, rows, counted), len(texts))
    p = attention._views(flat)
    for k, text in enumerate(texts):
        own = [attention._BEGIN, attention._BEGIN, *ids.place[text], ids.place[-1]]
        total = 0.0
        for i in range(2, len(own)):
            turn = max(0, -(-(i - 1 - attention.WINDOW) // attention.STRIDE))  # the window that counts it
            total += _plain_log_prob(p, own[turn * attention.STRIDE : i], own[i])
        assert found[k] == pytest.approx(total, rel=1e-5)
        rare = [i for i in [*text.tolist(), 5999] if ids.place[i] == attention._RARE]
        assert inside[k] == pytest.approx(sum(ids.rare_log[i] for i in rare))


def test_probabilities_add_up_to_one(model):
    ids, flat = model
    every = np.arange(attention.TOP_IDS + 1)
    rows = np.full((len(every), attention.WINDOW + 2), attention._NONE)
    rows[:, :4] = [attention._BEGIN, attention._BEGIN, 7, 4000]
    rows[:, 4] = every
    counted = np.zeros((len(every), attention.WINDOW), bool)
    counted[:, 2] = True
    assert np.exp(attention.log_probs(flat, rows, counted)).sum() == pytest.approx(1, abs=1e-5)
    rare = ids.place == attention._RARE
    assert np.exp(ids.rare_log[rare]).sum() == pytest.approx(1)


def test_gradient_equals_numeric_slopes(model):
    _, flat = model
    rng = np.random.default_rng(4)
    rows = rng.integers(0, attention.TOP_IDS + 1, (5, attention.WINDOW + 2))
    rows[0, 9:] = attention._NONE
    slope, _ = attention.gradient(flat, rows)
    touched = np.flatnonzero(slope)
    at = 0
    for name, shape in attention._SHAPES.items():
        size = int(np.prod(shape))
        own = touched[(touched >= at) & (touched < at + size)]
        for i in rng.choice(own, 4):
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-4
            down[i] -= 1e-4
            numeric = (attention.gradient(up, rows)[1] - attention.gradient(down, rows)[1]) / 2e-4
            assert slope[i] == pytest.approx(numeric, rel=1e-2, abs=1e-6), name
        at += size


def test_training_lowers_the_loss():
    rng = np.random.default_rng(5)
    chain = np.cumsum(rng.integers(1, 4, (2000, attention.WINDOW + 2)), axis=1) % 97
    flat = attention.start(np.bincount(chain.ravel(), minlength=attention.TOP_IDS + 1))
    ended, seen = attention.descend(flat, [chain[:1800]] * 4, attention.RATE, 1)
    assert seen == 4 * 1800
    assert attention.gradient(ended, chain[1800:])[1] < attention.gradient(flat, chain[1800:])[1] - 0.3


def _plain_base(rows):
    learnt = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    counts = Counter(w for t in learnt for w in _words(t))
    total, different = sum(counts.values()) + len(learnt), len(counts) + bool(learnt)
    out = []
    for i, t in rows:
        own = [counts[w] for w in _words(t)] + [len(learnt)]
        score = sum(math.log10((c + 0.1) / (total + 0.1 * (different + 1))) for c in own)
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(own), sum(c > 0 for c in own), total, round(score, 6)))
    return sorted(out, key=repr)


def _base(found):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr)


@pytest.mark.parametrize("top", [1 << 18, 20])
def test_query(spark, documents, plain, monkeypatch, top):
    monkeypatch.setattr(attention, "TOP_WORDS", top)  # nearly all words are joined
    found = attention.op12_lm_scores(spark, SF).collect()
    assert _base(found) == _plain_base(plain)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 1.7 * sum(r.base_score for r in held)  # so few texts hardly train the model


def test_score_is_the_models(spark, documents):
    rows = attention.training(documents, "doc_id", "text")
    counts = attention.word_counts(rows.filter("learn")).cache()
    path = tokenizer_path()
    ids = attention.Ids.of(np.append(attention.id_counts(counts, path), rows.filter("learn").count()))
    flat = attention.train(rows, ids, path)
    found = {r.doc_id: r.score for r in attention.lm_scores(documents).collect()}
    for r in documents.filter("doc_id < 12").collect():
        own = [i for w in _words(r.text) for i in encoder(path).encode([f" {w}"])[0].tolist()]
        sequence, bounds, inside = ids.sequences(np.array(own, int), np.array([len(own)]))
        cut, _, counted = attention.windows(sequence, bounds)
        score = (attention.log_probs(flat, cut, counted).sum() + inside[0]) / math.log(10)
        assert found[r.doc_id] == pytest.approx(score, rel=1e-4)


def test_awkward_rows(spark, awkward):
    found = attention.lm_scores(awkward).collect()
    assert _base(found) == _plain_base([(r.doc_id, r.text) for r in awkward.collect()])
    assert attention.lm_scores(awkward.limit(0)).collect() == []
    nothing = attention.lm_scores(awkward.filter("doc_id IS NULL")).collect()  # nothing to learn from
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in nothing] == [(False, 7, 0, 0)]
    assert nothing[0].base_score == 0 and math.isfinite(nothing[0].score)


def test_every_learnt_document_is_trained_on_once(spark, documents, monkeypatch, tmp_path):
    """Each task writes down the windows it gets; together they are those of all documents that are not held out."""
    own = attention.descend

    def noted(flat, batches, rate, seed):
        seen = []
        done = own(flat, (seen.append(rows) or rows for rows in batches), rate, seed)
        (tmp_path / str(seed)).write_bytes(b"".join(np.ascontiguousarray(r, "<i8").tobytes() for r in seen))
        return done

    rows = attention.training(documents, "doc_id", "text").cache()
    path = tokenizer_path()
    ids = attention.Ids.of(np.append(attention.id_counts(attention.word_counts(rows.filter("learn")), path), rows.filter("learn").count()))
    monkeypatch.setattr(attention, "descend", noted)
    flat = attention.train(rows, ids, path)
    monkeypatch.undo()
    assert np.isfinite(flat).all()
    found = Counter()
    for file in tmp_path.iterdir():
        found.update(map(bytes, np.frombuffer(file.read_bytes(), "<i8").reshape(-1, attention.WINDOW + 2)))
    wanted = Counter()
    for r in rows.filter("learn").collect():
        lists = attention.units(pa.array([r.text], pa.large_string()))
        sequence, bounds, _ = ids.sequences(*attention._encoded(encoder(path), lists))
        wanted.update(map(bytes, attention.windows(sequence, bounds)[0].astype("<i8")))
    assert found == wanted


def test_quick_and_exact_gradients_agree(model):
    _, flat = model
    rows = np.random.default_rng(6).integers(0, attention.TOP_IDS + 1, (8, attention.WINDOW + 2))
    (quick, loss), (exact, other) = attention._gradient(flat, rows, False), attention._gradient(flat, rows, True)
    assert loss == pytest.approx(other) and np.allclose(quick, exact)
    steep = (flat * 1).astype(np.float32)
    attention._views(steep)["class_bias"][:] += 100  # over what exp holds in 32 bits
    assert np.isfinite(attention.gradient(steep, rows)[0]).all()
