"""Token files, packing, pieces: against the libraries, for awkward texts too."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowgraph.llm import pieces, tokens
from flowgraph.session import scratch_path

RNG = random.Random(3)
TEXTS = ["", "a", " a", "a ", "a  b\n\n c", "x\n", "\n", "  ", "z \t q", "<|endoftext|> hi", "it's 12.5%, isn't it?)", "é\u00a0è 你好 😀", "a\x00b", "▁ ▁▁x"]
TEXTS += ["".join(RNG.choice("aeth  \n.in'5é\t") for _ in range(RNG.randrange(120))) for _ in range(500)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_path())
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library(library, plain, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_UNITS", 500)  # so that it forgets
    own = tokens.Encoder(tokens.tokenizer_path())
    for at in range(0, len(TEXTS), 50):
        some = TEXTS[at : at + 50] + [t for _, t in plain[at // 5 : at // 5 + 10]]
        assert [x.tolist() for x in own.encode(some)] == [library(t) for t in some]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (5, 3), (2_000, 10**12), (2_000, 50)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        data = tokens.EliasFano.of(values).to_bytes()
        back, end = tokens.EliasFano.read(data, 0)
        assert end == len(data) and np.array_equal(back.some(0, n), values)
        assert [back.select(i) for i in range(n)] == values.tolist()
        for first, last in ((0, 0), (n // 3, n // 2), (n // 2, n)):
            assert np.array_equal(back.some(first, last), values[first:last])
        for most in (0, top // 2, top):
            assert back.up_to(most) == int((values <= most).sum())
        assert 8 * (len(back.low) + len(back.high)) <= n * (3 + max(0, np.log2(max(top, 1) / max(n, 1)))) + 80
    with pytest.raises(IndexError):
        back.select(-1)


def test_file_round_trip():
    ids = np.arange(10, dtype=np.uint16)
    found = tokens.TokenFile(tokens.file_bytes([None, -5, -5, 2**62], [1, 2, 3, 4], ids))
    assert found.doc_ids(0, 4) == [None, -5, -5, 2**62] and found.doc_ids(2, 3) == [-5] and np.array_equal(found.ids, ids)
    assert [found.document(i).tolist() for i in range(4)] == [[0], [1, 2], [3, 4, 5], [6, 7, 8, 9]]
    assert list(found.batches(3)) == [(0, 2), (2, 3), (3, 4)] and list(found.batches(100)) == [(0, 4)]


@pytest.mark.parametrize("file_ids", [tokens.FILE_IDS, 40])
def test_token_files(spark, awkward, documents, library, plain, file_ids):
    folder = scratch_path(spark, "ids")
    found = tokens.read_token_files(tokens.write_token_files(documents, folder, file_ids=file_ids)).collect()
    at = 0
    for r, (doc_id, text) in zip(sorted(found, key=lambda r: r.start), plain, strict=True):
        ids = library(text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_awkward(spark, awkward, library):
    found = tokens.read_token_files(tokens.write_token_files(awkward, scratch_path(spark, "ids"), file_ids=10)).collect()
    found.sort(key=lambda r: r.start)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in awkward.select("doc_id", "text").collect()))
    assert [r.n_tokens for r in found] == [len(library(t)) + 1 for _, _, t in rows]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    empty = tokens.write_token_files(awkward.limit(0), scratch_path(spark, "ids"))
    assert empty.count() == 0 and tokens.read_token_files(empty).count() == 0


def test_pieces_are_powers_of_two():
    docs, sizes = tokens.pieces_of(np.array([1, 0, 1024, 3000, 7]))
    assert list(zip(docs.tolist(), sizes.tolist(), strict=True)) == [
        (0, 1), (2, 1024), (3, 1024), (3, 1024), (3, 512), (3, 256), (3, 128), (3, 32), (3, 16), (3, 8), (4, 4), (4, 2), (4, 1),
    ]


def check_packing(found, texts, library):
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts:
        ids, at = library(text) + [0], 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length in [1 << k for k in range(11)]
            assert bytes(r.ids) == np.array(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)


def test_packing(documents, plain, library):
    found = tokens.pack(documents).collect()
    check_packing(found, plain, library)
    order = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True)  # buckets of equal length


def test_packing_awkward(awkward, library):
    found = tokens.pack(awkward)
    assert found.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = found.collect()
    assert sum(r.length for r in rows) == sum(len(library(r.text or "")) + 1 for r in awkward.select("text").collect())
    assert tokens.pack(awkward.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.pack(awkward, most=1000)


def test_piece_encoder_is_the_library(plain, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.model_path())
    monkeypatch.setattr(tokens, "MEMORY_UNITS", 500)
    monkeypatch.setattr(pieces, "MEMORY_PAIRS", 300)
    own = pieces.PieceEncoder(pieces.model_path())
    for at in range(0, len(TEXTS), 50):
        some = TEXTS[at : at + 50] + [t for _, t in plain[at // 5 : at // 5 + 10]]
        flat, ends = own.encode(pa.array(some, pa.large_string()))
        found = [x.tolist() for x in np.split(flat, ends[:-1])]
        assert found == model.encode(some)
        assert [own.decode(np.array(x, int)) for x in found] == [model.decode(x) for x in found]


def test_pieces_awkward(awkward):
    rows = pieces.round_trip(awkward).collect()
    assert len(rows) == awkward.count() and all(r.same for r in rows if r.doc_id != 10)  # a literal mark becomes a blank
    assert [r.pieces for r in rows if r.doc_id in (3, 4)] == [[], []]
    back = pieces.decode(pieces.encode(awkward))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.decoded) for r in rows)
    assert pieces.round_trip(awkward.limit(0)).count() == 0
