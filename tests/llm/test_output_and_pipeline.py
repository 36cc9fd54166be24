"""Token shards: a permutation, an exact round trip; the pipeline from end to end."""

import hashlib

import numpy as np
import pytest
from helpers import corpus, docs_frame

import corpus_pipeline
from trafficlens.llm import token_output as tok

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 5000])
def test_feistel_is_a_permutation(n):
    out = tok.feistel(np.arange(n), n, key=6)
    assert sorted(out.tolist()) == list(range(n))
    if n >= 1000:
        assert (out != tok.feistel(np.arange(n), n, key=7)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.1


def test_counting_equals_encoding(monkeypatch):
    texts = ["a b", " a", "a ", "  a  b ", "a\nb c\n d", "it's  we'll 12 3x!! é\u00a0b \u3000c", "x", " ", "a \tb", "\n\n", "one two three " * 50, "one two one\ntwo three one two",
             "日本 語 b", "a\u2009 b", "a 's b't 'll x", "a\x1cb c", "a \x1fb", "a\x85 b", "12 34 5 6 - -- !? ?!", "\u200b a \ufeff b", "a\u0301 b\u0301", "\U0001f600 \U0001f600 x", "q" * 5000]
    for remembered in (0, 3, 200_000):
        monkeypatch.setattr(tok, "REMEMBERED", remembered)
        t = tok.Tokenizer(tok.RANKS)
        for text in texts:
            assert t.count([text]) == len(t.encode(text)), repr(text)
        assert t.count(texts) == sum(len(t.encode(x)) for x in texts)
        clean = [x for x in texts if not tok._WIDE_SPACE.search(f"x {x} x")]
        assert t.count(clean * 2) == 2 * sum(len(t.encode(x)) for x in clean) and t.count([]) == 0


def test_round_trip(spark, workdir):
    rows = corpus(seed=9, n=50)
    stored = f"{workdir}/docs"
    docs_frame(spark, rows, 4).write.parquet(stored)
    docs, out = spark.read.parquet(stored), f"{workdir}/shards"
    got = tok.materialize(docs, out, length=64, shard_bytes=64 * 2 * 10).collect()
    records = dict(tok.read_slots(out))
    assert sorted(records) == list(range(len(got))) == sorted(r.slot for r in got)
    by_sequence = {r.sequence: r for r in got}
    assert all(hashlib.sha256(records[r.slot].tobytes()).hexdigest() == r.sha256 and r.shard == r.slot // 10 and r.record == r.slot % 10 for r in got)
    ids = np.concatenate([records[by_sequence[s].slot][: by_sequence[s].n_tokens] for s in sorted(by_sequence)])
    enc = tok.tokenizer(tok.RANKS).encoding
    texts, at = [], 0
    for end in np.flatnonzero(ids == tok.END):
        texts.append(enc.decode(ids[at:end].tolist()))
        at = end + 1
    assert at == len(ids) and sorted(texts) == sorted(t for _, t in rows if t)
    assert {d for r in got for d in r.doc_ids} == {i for i, t in rows if t}
    assert [s for s, _ in tok.read_slots(out, 7, 23)] == list(range(7, 23))
    assert tok.materialize(docs, out, length=64, shard_bytes=64 * 2 * 10).orderBy("slot").collect() == sorted(got, key=lambda r: r.slot)


def test_no_documents(spark, workdir):
    docs_frame(spark, []).write.parquet(f"{workdir}/none")
    assert tok.materialize(spark.read.parquet(f"{workdir}/none"), f"{workdir}/out").collect() == []
    assert list(tok.read_slots(f"{workdir}/out")) == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.schema.names == docs.schema.names, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}, name
        assert name != "language_id" or len(ids) >= 0.95 * docs.count()
        path = tok.shared_folder(spark, name)
        after.write.parquet(path)
        kept = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {d for r in last for d in r.doc_ids} == {r.doc_id for r in kept.collect() if r.text}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {d for r in whole for d in r.doc_ids} == {d for r in last for d in r.doc_ids}
