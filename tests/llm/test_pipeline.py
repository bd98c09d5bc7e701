"""The stages against a plain version of each, over the smallest table."""

import zlib

import corpus_pipeline
import duckdb
import numpy as np

from flowgraph.llm import pii, simhash, tokens
from flowgraph.llm.quality import OP3_SQL

SF = "/root/testdata/sf0.001"


def test_run(spark, documents, plain):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({OP3_SQL}) WHERE kept").fetchall()}
    docs = {i: t for i, t in plain if i in good}
    last = {}
    for i in sorted(docs):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in docs[i])] = i
    docs = {i: docs[i] for i in sorted(last.values())}
    fps = {i: simhash.fingerprint(t) for i, t in docs.items()}
    group = {i: i for i in docs}
    for _ in docs:  # to a fixpoint
        new = {i: min(group[j] for j in docs if (fps[i] ^ fps[j]).bit_count() <= 4) for i in docs}
        if new == group:
            break
        group = new
    docs = {i: t for i, t in docs.items() if group[i] == i}
    field = pii.train()
    expected = []
    for i, t in docs.items():
        base = pii.base_spans(t)
        out, done = "", 0
        for a, k, b in sorted(base + pii.added_spans([t], [base], field)[0]):
            if a >= done:
                out += t[done:a] + f"[{pii.KINDS[k].upper()}]"
            done = max(done, b)
        docs[i] = out + t[done:]
        ids = [*tokens.encoder(tokens.tokenizer_path()).encode([docs[i]])[0].tolist(), 0]
        at = 0
        for size in tokens.pieces_of(np.array([len(ids)]))[1].tolist():
            expected.append((i, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)))
            at += size
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(expected)


def test_stages_keep_the_columns(spark, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for some in (stage(spark, docs, SF), stage(spark, docs.limit(0), SF)):
            assert some.columns == awkward.columns
            some.count()
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
