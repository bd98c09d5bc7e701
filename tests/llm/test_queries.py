"""All columns of the registered queries that SQL can't express, against libraries and plain versions."""

import hashlib
import zlib

import numpy as np
import pytest

from flowgraph.llm import language, pieces, pii, queries, tokens

from .test_models import naive_base, naive_fingerprint, naive_sets, naive_spans

SF = "/root/testdata/sf0.001"


def _rows(spark, name):
    return sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()))


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_path())
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, plain):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.model_path())
    expected = []
    for i, t in plain:
        found = model.encode(t)
        decoded = model.decode(found)
        expected.append((i, len(found), zlib.crc32(",".join(map(str, found)).encode()), hashlib.sha256(decoded.encode()).hexdigest(), decoded == t))
    assert _rows(spark, "op2_sentencepiece") == sorted(expected)


def test_op5(spark, plain):
    assert _rows(spark, "op5_suffix_dedup") == [(i, *x) for (i, _), x in zip(plain, naive_spans(plain), strict=True)]


def test_op6(spark, plain, ids_of):
    expected, at = [], 0
    for i, t in plain:
        ids = [*ids_of(t), 2]
        expected.append((i, at, len(ids), _crc(ids)))
        at += len(ids)
    assert _rows(spark, "op6_token_files") == expected


def test_op7(spark, plain):
    field = pii.train()
    listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    expected = []
    for i, t in plain:
        base = naive_base(t)
        added = pii.added_spans([t], [base], field)[0]
        counts = [sum(k == kind for _, kind, _ in base) for k in range(4)]
        expected.append((i, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)))
    assert _rows(spark, "op7_pii") == expected


def test_op8(spark, plain, ids_of):
    found = queries.QUERIES["op8_packing"](spark, SF).collect()
    expected = {}
    for i, t in plain:
        ids = [*ids_of(t), 0]
        at = 0
        for size in [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if len(ids) % 1024 >> b & 1]:
            expected[i, at] = (size, _crc(ids[at : at + size]), len(ids), 0)
            at += size
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in found} == expected
    assert len({r.sequence_id for r in found}) == len(found)  # a piece is a sequence of its own


def test_op9(spark, plain):
    fps = [naive_fingerprint(t) for _, t in plain]
    sets = naive_sets(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert _rows(spark, "op9_simhash") == [(i, f"{f:016x}", plain[k][0]) for (i, _), f, k in zip(plain, fps, sets, strict=True)]


def test_op10(spark, documents, plain):
    import regex

    langs, probs = language.train(documents)
    found = {r.doc_id: r for r in queries.QUERIES["op10_language"](spark, SF).collect()}
    assert len(found) == len(plain)
    for i, t in plain:
        size = language.WORD_CHARS - 1
        runs = regex.findall(r"\p{L}+", t.lower())
        words = [(language.MARK if not k else "") + run[k : k + size] for run in runs for k in range(0, len(run), size)]
        r = found[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = language.word_scores(words, probs, language.model_path()).sum(axis=0)
        assert r.lang_pred == langs[int(logs.argmax())]
        assert r.score == pytest.approx(1 / np.exp(logs - logs.max()).sum(), abs=1e-6)
