"""Token files: ids as the tokenizer alone gives them, an exact round trip, offsets."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import common, token_binary

PATH = token_binary.tokenizer_path()


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return token_binary.ChunkEncoder(PATH)


def ids_of(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


def brute(model, rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (common.NULL_ID if r[0] is None else r[0], (r[1] or "").encode())):
        ids = [*ids_of(model, t), 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_equals_brute_force(docs, model, rng, prose, odd):
    rows = [(rng.randrange(10**6), prose(rng.randrange(200))) for _ in range(60)] + odd
    got = token_binary.round_trip(docs(rows))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(model, rows)


def test_files(spark, docs, model, prose, tmp_path):
    rows = [(i, prose(20)) for i in range(30)]
    shards = token_binary.write(docs(rows), str(tmp_path / "set"), end_id=7)
    found = {r["doc_id"]: r["ids"] for r in token_binary.documents(spark, str(tmp_path / "set"), shards).collect()}
    assert found == {i: [*ids_of(model, t), 7] for i, t in rows}
    base = 0
    for r in sorted(shards.collect()):
        ids, offsets, doc = token_binary.open_shard(str(tmp_path / "set"), r["shard"])
        assert (r["base"], r["n_tokens"], r["n_docs"]) == (base, len(ids), len(doc))
        assert ids.dtype == np.dtype("<u2") and offsets.dtype == np.dtype("<u8") and doc.dtype == np.dtype("<i8")
        assert offsets[0] == 0 and offsets[-1] == len(ids) and list(doc) == sorted(doc)
        base += len(ids)
    assert not [p.name for p in (tmp_path / "set").iterdir() if p.suffix not in (".bin", ".off", ".doc")]


def test_empty_table(docs):
    assert token_binary.round_trip(docs([])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab Z19.,'\n\t\r  é漢\U0001f600", max_size=30), min_size=1, max_size=6))
def test_chunks_equal_whole_texts(encoder, model, texts):
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)]
    assert got == [ids_of(model, t) for t in texts]


def test_special_token_in_a_text(encoder, model):
    texts = [f"a {encoder.mark} b", f"x{encoder.mark}", "plain words"]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == [ids_of(model, t) for t in texts]


def test_small_memo(model, rng, prose):
    enc = token_binary.ChunkEncoder(PATH, memo=50)
    for _ in range(20):
        texts = [prose(30) + str(rng.random())]
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc(texts)] == [ids_of(model, t) for t in texts]


def test_32_bits_where_the_vocabulary_asks_for_them():
    assert token_binary.id_kind(1 << 16) == "<u2"
    assert token_binary.id_kind((1 << 16) + 1) == "<u4"
