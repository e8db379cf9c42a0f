"""Token ids, their files and packing, against the tokenizers library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citytables.llm import tokenfile
from citytables.llm.packing import first_fit_decreasing, packed_documents, padding
from citytables.llm.tokens import encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", None, " ", "  a", "a  b", "a \n b", "a\n b\n\n  c ", "x\t y", "don't we're  ", "  q 　 r", "été 12 345,6!!", "a  b \x1cc", "long " * 3000, "<|endoftext|> x", "字 字字 🙂 🙂"]


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ' \n\t1.  é\x1c\x0b", max_size=25), min_size=1, max_size=4))
def test_cut_texts_give_the_same_ids(texts):
    ids, ends = encoder().encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text(alphabet="'strevmld S1 \u2019\u00a0\u3000\n", max_size=20), min_size=1, max_size=4))
def test_any_text_gives_the_same_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, ends = encoder().encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [plain(t) for t in texts]


def test_special_tokens_by_the_plain_call_or_as_text():
    text = ["hi <|endoftext|> x", "<|endoftext|>", "x"]
    assert np.split(*encoder().encode(pa.array(text)))[0].tolist() == [5303, 220, 50256, 2124] == plain(text[0])
    as_text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    as_text.encode_special_tokens = True
    ids, ends = encoder(None, False).encode(pa.array(text))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [as_text.encode(t, add_special_tokens=False).ids for t in text]


def test_another_vocabulary_encodes_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    texts = ["Two  words, don't", "", None, "\u00e9t\u00e9 <|endoftext|>"]
    ids, ends = encoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def frame(spark, texts):
    rows = [(7 * i % 101 - 3, t, "x", {"doc_id": 1}) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, part map<string,int>").repartition(3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600)))
def test_codes_round_trip(values):
    a = np.array(values, dtype=np.uint32)
    assert (tokenfile.decode_ids(*tokenfile.encode_ids(a), len(a)) == a).all()


def test_files_round_trip(spark, tmp_path):
    rows, df = frame(spark, TEXTS * 2)
    path = f"file://{tmp_path}/files"
    tokenfile.write_token_files(df, path, end_id=2, block_tokens=500)
    start, want = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*plain(text), 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfile.read_token_files(spark, path, digest=True).collect())) == want
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokenfile.read_token_files(spark, path).collect()}
    assert back == {doc: [*plain(text), 2] for doc, text, *_ in rows}
    with pytest.raises(ValueError):
        tokenfile.unpack_block(b"something else")


def test_empty_files(spark, tmp_path):
    _, df = frame(spark, TEXTS[:1])
    tokenfile.write_token_files(df.limit(0), f"file://{tmp_path}/none", end_id=2)
    assert tokenfile.read_token_files(spark, f"file://{tmp_path}/none").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_is_first_fit(lengths):
    bins, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, used in enumerate(bins) if used + lengths[i] <= 50), len(bins))
        if b == len(bins):
            bins.append(0)
        want.append((i, b, bins[b]))
        bins[b] += lengths[i]
    got = first_fit_decreasing(lengths, 50)
    assert [got[i] for i, _, _ in want] == [(b, o) for _, b, o in want]


def test_packed_documents(spark):
    r = random.Random(1)
    texts = TEXTS + ["word " * r.randrange(1, 900) for _ in range(150)]
    rows, df = frame(spark, texts[:100])
    got = packed_documents(df, end_id=0, capacity=1024).collect()
    ids = {doc: [*plain(t), 0] for doc, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for doc, own in ids.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(own)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    used = np.array([sum(n for _, n in v) for v in by_sequence.values()])
    assert padding(used) < 0.05 * used.sum()
    assert packed_documents(df.limit(0)).collect() == []
