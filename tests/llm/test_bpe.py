"""BPE by tree concatenation against the tokenizers library."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import corpus, docs_frame
from trafficlens.llm import bpe

WHOLE = Tokenizer.from_file(bpe.TOKENIZER)
CODEC = bpe.Codec(bpe.read_spec(bpe.TOKENIZER))

PIECES = st.sampled_from(["a", "aa", "th", "er", "tion", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!", "?!", "0", "42", "é", "漢", " ", "　", "\u0085", "<|endoftext|>", "<|end", "oftext|>", "\x00", "🙂", "A", " the"])
TEXTS = st.lists(st.one_of(PIECES, st.text(max_size=5), st.builds(lambda s, n: s * n, PIECES, st.integers(1, 40))), max_size=40).map("".join)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 64))
def test_joined_parts(text, size):
    data = text.encode()
    parts = CODEC.cut(data, size)
    assert b"".join(p for p, _ in parts) == data
    ids, starts = CODEC.concatenate([(*CODEC.encode_part(p), sure) for p, sure in parts])
    assert ids.tolist() == ids_of(text)
    assert starts.tolist() == CODEC.encode_part(data)[1].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=6))
def test_stretches(texts):
    ids, offsets = CODEC.encode_many(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("alphabet", ["a", "ab", "theinrao", "!?", "01", "é漢", " \n"])
def test_long_text_without_a_sure_cut(alphabet):
    rng = random.Random(len(alphabet))
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    ids, _ = CODEC.concatenate([(*CODEC.encode_part(p), sure) for p, sure in CODEC.cut(text.encode(), 700)])
    assert ids.tolist() == ids_of(text)


ROWS = [*corpus(), (500, "x" * 9000), (501, "<|endoftext|>" * 300 + "tail"), (502, ("word " * 900) + "y" * 5000), (502, ("word " * 900) + "y" * 5000), (None, "z" * 3000), (503, "漢字" * 2000)]


@pytest.mark.parametrize("part", [1 << 16, 512])
def test_documents(spark, part):
    docs = docs_frame(spark, ROWS)
    decoded = bpe.encode_documents(docs, part_bytes=part, decode=True)
    again = bpe.decode_documents(bpe.encode_documents(docs, part_bytes=part))
    assert sorted(map(str, again.collect())) == sorted(map(str, decoded.collect()))
    got = [(r["doc_id"], r["ids"], r["text"]) for r in decoded.collect()]
    assert sorted(got, key=str) == sorted(((d, ids_of(t), t or "") for d, t in ROWS), key=str)
    assert bpe.digest(decoded).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decoding_any_ids(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(30))] for _ in range(40)] + [[], [50256], [128, 300]]
    rows = [(i, x) for i, x in enumerate(lists)]
    encoded = spark.createDataFrame([*rows, (100, None), (101, [5, 60000, 6])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded).collect()}
    assert got == {i: WHOLE.decode(x, skip_special_tokens=False) for i, x in rows} | {100: "", 101: WHOLE.decode([5, 6], skip_special_tokens=False)}


def test_empty_table(spark):
    assert bpe.digest(bpe.decode_documents(bpe.encode_documents(docs_frame(spark, [])))).collect() == []


def test_other_tokenizers_are_refused():
    import json

    d = json.loads(bpe.read_spec(bpe.TOKENIZER))
    d["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(d).encode())
