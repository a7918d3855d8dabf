"""Repetition rules against brute force over all substrings."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import repetition

WORD = re.compile("[^\x20\x09-\x0d]+")


def repeats(words):
    """Longest repeated substring from each start, by comparing all pairs of starts."""
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def brute(text, min_repeat=8):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = repeats(words)
    cover = lambda spans: len({k for a, n in spans for k in range(a, a + n)})
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": cover([(i, 3) for i, k in enumerate(longest) if k >= 3]),
        "n_covered": cover([(i, k) for i, k in enumerate(longest) if k >= min_repeat]),
        "longest_repeat": max(longest, default=0),
    }


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "a#", "\n", "é"]), max_size=40).map(" ".join), max_size=5))
def test_signals(texts):
    got = repetition.Signals(min_repeat=4)(texts)
    for i, t in enumerate(texts):
        assert {k: int(got[k][i]) for k in brute(t)} == brute(t, 4)


def test_chunks_change_nothing(rng, prose):
    texts = [prose(rng.randrange(100)) + " " + "x y z " * rng.randrange(20) for _ in range(20)]
    a, b = repetition.Signals()(texts), repetition.Signals(chunk=1)(texts)
    assert all((a[k] == b[k]).all() for k in repetition.Signals.names)


def test_rules(docs, rng, prose, odd):
    passage = prose(30)
    rows = [(100 + i, prose(rng.randrange(120)) + " " + " ".join([passage] * rng.randrange(4))) for i in range(30)] + [r for r in odd if r[0] != 6]
    rows += [(200, prose(1) + " word" * 300), (201, " ".join([prose(250)] * 2))]
    got = repetition.rules(docs(rows)).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_words"], r["word_chars"])), sorted(rows, key=lambda r: (str(r[0]), len(WORD.findall(r[1] or "")), sum(map(len, WORD.findall(r[1] or ""))))), strict=True):
        want = brute(t)
        assert r["doc_id"] == d and {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and want["n_covered"] <= 0.3 * want["n_words"] and want["longest_repeat"] <= 200)


def test_long_repeat_of_one_word(docs):
    r = repetition.rules(docs([(6, "word " * 30_000)])).first()
    assert (r["n_words"], r["n_repeat_words"], r["longest_repeat"], r["kept"]) == (30_000, 30_000, 29_999, False)


def test_deep_repeats(rng, monkeypatch):
    """Common prefixes beyond the kept passes are measured on the text; the same as by comparing all."""
    for kept in (1, 2, 6):
        monkeypatch.setattr(repetition, "KEPT", kept)
        for _ in range(60):
            part = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))]
            words = (part * rng.randrange(1, 5) + [rng.choice("abcdefgh") for _ in range(rng.randrange(30))] + part)[:200]
            text = " ".join(words)
            got = repetition.Signals(min_repeat=4)([text, "x y", text])
            assert all({k: int(got[k][i]) for k in brute(text)} == brute(text, 4) for i in (0, 2))
            assert int(got["n_repeats"][0]) == int(got["n_repeats"][2]) == len(repetition.maximal_repeats(words, 4))


def test_memory_is_linear(monkeypatch):
    """Kept passes don't grow with the length of a repeat."""
    import tracemalloc

    peak = []
    for n in (50_000, 400_000):
        symbols = np.zeros(n, np.int32)
        tracemalloc.start()
        order, lcp = repetition.suffix_order(symbols, np.full(n, n))
        peak.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
        assert lcp.max() == n - 1
    assert peak[1] < 1.2 * peak[0] < 250


def test_long_texts_are_read_in_parts(rng, prose, monkeypatch):
    text = prose(500) + "\n\u00a0é  漢字 " + prose(500)
    known, whole = {}, {}
    monkeypatch.setattr(repetition, "READ", 7)
    parts = repetition._words(text, known)
    monkeypatch.setattr(repetition, "READ", 1 << 20)
    assert parts.tolist() == repetition._words(text, whole).tolist() and known == whole


def test_empty_table(docs):
    assert repetition.rules(docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=18))
def test_maximal_repeats(words):
    n, want = len(words), {}
    for size in range(1, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        for starts in places.values():
            left = {words[i - 1] if i else None for i in starts}
            right = {words[i + size] if i + size < n else None for i in starts}
            if len(starts) > 1 and len(left) > 1 and len(right) > 1:
                want[size, tuple(starts)] = True
    assert sorted((k, tuple(s)) for k, s in repetition.maximal_repeats(words)) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_order(symbols):
    s = np.array(symbols, np.int64)
    order, lcp = repetition.suffix_order(s, np.full(len(s), len(s)))
    assert order.tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])
    for k in range(1, len(s)):
        a, b = symbols[order[k - 1] :], symbols[order[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n
