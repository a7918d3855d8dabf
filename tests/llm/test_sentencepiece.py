"""N-best segmentation against all paths of small lattices; decoding; the best path against dynamic programming."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import sentencepiece_nbest as sp

PATH = sp.model_path()


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(PATH)


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(PATH, 5)


def edges(pieces, text):
    """``(start, end, score, ids)`` of the whole lattice of a text."""
    shown = (" " + text).replace(sp.SPACE, "\0").replace(" ", sp.SPACE)
    out = []
    for b in range(len(shown)):
        alone = False
        for e in range(b + 1, len(shown) + 1):
            hit = pieces.trie.get(shown[b:e])
            if hit is None:
                break
            if hit:
                alone |= e == b + 1
                out.append((b, e, hit[1], [hit[0]]))
        if not alone:
            out.append((b, b + 1, pieces.unknown, [pieces.bytes_[x] for x in (" " + text)[b].encode()]))
    return len(shown), out


def best_scores(pieces, text, n):
    """The ``n`` best path scores by keeping ``n`` at each position."""
    size, lattice = edges(pieces, text)
    top = [[0.0]] + [[] for _ in range(size)]
    for e in range(1, size + 1):
        top[e] = sorted((s + f for b, to, s, _ in lattice if to == e for f in top[b]), reverse=True)[:n]
    return top[size]


def all_paths(pieces, text):
    size, lattice = edges(pieces, text)

    def walk(at):
        if at == size:
            yield 0.0, [], []
        for b, e, s, ids in lattice:
            if b == at:
                for rest, more, starts in walk(e):
                    yield s + rest, ids + more, [*starts, b]

    return list(walk(0))


def ordered(pieces, text, n):
    """The ``n`` best paths of a whole text; equal scores by the starts read from the end."""
    return [(s, ids) for s, ids, starts in sorted(all_paths(pieces, text), key=lambda p: (-p[0], p[2]))[:n]]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="then io\nst é漢", min_size=1, max_size=9))
def test_paths_equal_all_paths(encoder, pieces, text):
    assert [(s, ids_of(i)) for s, i in encoder([text])[0]] == ordered(pieces, text, 5)


def test_ties_between_units(encoder, pieces, rng):
    """Repeated words lose the same by their second paths; the whole text's order of ties decides."""
    for _ in range(150):
        text = " ".join(rng.choice(["of", "foo", "in", "it", "an", "oo"]) for _ in range(rng.randrange(2, 5)))
        if len(text) <= 12:
            assert [(s, ids_of(i)) for s, i in encoder([text])[0]] == ordered(pieces, text, 5), text
    for _ in range(100):
        text = " ".join(rng.choice(["of", "foo", "in", "other", "an", "wonder"]) for _ in range(rng.randrange(5, 40)))
        whole = sp.Lattice(pieces, " " + text).nbest(5)
        assert [(s, ids_of(i)) for s, i in encoder([text])[0]] == [(s, list(i)) for s, i, _ in whole], text


def test_a_long_word_without_spaces(pieces):
    import time
    import tracemalloc

    for unit in ("QmFzZTY0IGJsb2Jz" * 6250, "漢字かな" * 25_000):
        assert len(unit) == 100_000
        start = time.perf_counter()
        found = sp.Lattice(pieces, unit).nbest(4)
        assert time.perf_counter() - start < 60
        assert len({i for _, i, _ in found}) == len(found) == (4 if unit[0] == "Q" else 1) and found == sorted(found, key=lambda x: -x[0])
        assert found[0][1] == tuple(sp.solve(pieces, unit)[0])
    tracemalloc.start()
    sp.Lattice(pieces, "QmFzZTY0IGJsb2Jz" * 1250).nbest(4)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # 20,000 characters
    tracemalloc.stop()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the quick Brown  \n\t1.é漢▁\U0001f600\x00", max_size=60))
def test_decoding_gives_the_text(encoder, pieces, text):
    for _, ids in encoder([text])[0]:
        assert pieces.decode(np.array(ids_of(ids), np.int64)).decode() == text


def test_long_texts(encoder, pieces, prose):
    text = prose(300) + "\n" + prose(50).upper() + "  " + prose(20)
    found = encoder([text])[0]
    assert [s for s, _ in found] == pytest.approx(best_scores(pieces, text, 5))
    assert all(a[0] >= b[0] for a, b in itertools.pairwise(found))


def test_a_small_memo_changes_nothing(encoder, prose):
    small = sp.Encoder(PATH, 5, memo=16)
    for _ in range(10):
        text = prose(60)
        assert small([text]) == encoder([text])


def test_tables(spark, docs, rng, prose, odd):
    rows = [(100 + i, prose(rng.randrange(80))) for i in range(20)] + odd
    out = sp.encode(docs(rows)).collect()
    assert len(out) == len(rows)
    text_of = {d: t for d, t in rows if d is not None}
    for r in out:
        assert r["exact"] and list(r["nbest"][0]["ids"]) == list(r["ids"])
        if r["doc_id"] is not None and not text_of[r["doc_id"]]:
            assert r["ids"] == [] and [x["score"] for x in r["nbest"]] == [0.0]
    back = sp.decode(sp.encode(docs(rows)).where("doc_id is not null"))
    assert all(r["text"] == (text_of[r["doc_id"]] or "") for r in back.collect())


def test_digests_follow_from_ids(docs, rng, prose, odd):
    import zlib

    rows = [(100 + i, prose(rng.randrange(80))) for i in range(10)] + [r for r in odd if r[0] not in (None, 5)]
    long = {r["doc_id"]: r for r in sp.encode(docs(rows)).collect()}
    for r in sp.digests(docs(rows), with_ids=True).collect():
        w = long[r["doc_id"]]
        crc = lambda i: zlib.crc32(np.array(i, "<u4").tobytes())
        assert (r["n_pieces"], r["ids_crc32"], r["exact"], r["ids"]) == (len(w["ids"]), crc(w["ids"]), True, w["ids"])
        assert r["nbest_crc32"] == [crc(x["ids"]) for x in w["nbest"]] and r["nbest_scores"] == [x["score"] for x in w["nbest"]]


def test_empty_table(docs):
    assert sp.digests(docs([])).collect() == []


def test_units_side_by_side(pieces, rng):
    """The table gives what solving one by one gives: the same ids, scores and losses, bit by bit."""
    letters = "aeinstrhodlé漢1▁\x00\U0001f600 "
    units = list({"".join(rng.choice(letters[: rng.choice([6, 11, 17])]) for _ in range(rng.randrange(1, 30))) for _ in range(4000)})
    assert sp.Table(pieces).solve(units) == [sp._packed(pieces, u) for u in units]
