"""Substring dedup against brute force over windows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import substring


def words_of(text):
    return (text or "").encode().split()


def brute(rows, size=20):
    """Rows that repeat an id and a text are one document; no id comes first."""
    key = lambda d: -(2**63) if d is None else d
    first, gone = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (key(r[0]), words_of(r[1]))):
        w = words_of(t)
        for i in range(len(w) - size + 1):
            at = first.setdefault(tuple(w[i : i + size]), (key(d), i))
            if at != (key(d), i):
                gone.setdefault(key(d), set()).update(range(i, i + size))
    out = []
    for d, t in rows:
        w = words_of(t)
        lost = {i for i in gone.get(key(d), ()) if i < len(w)}
        out.append((d, len(w), len(lost), b" ".join(x for i, x in enumerate(w) if i not in lost).decode()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in df.collect()), key=str)


def test_equals_brute_force(docs, rng, prose, odd):
    passages = [prose(n) for n in (19, 20, 21, 60, 150)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(30))] + [rng.choice(passages) for _ in range(rng.randrange(3))] + [prose(rng.randrange(30))]
        rows.append((rng.randrange(10**6), "  ".join(parts)))
    rows = list({d: (d, t) for d, t in rows}.values())
    rows += [(i + 2 * 10**6 if i is not None else None, t) for i, t in odd if t != "no id"]
    rows += [(3 * 10**6, "a b " * 200), (3 * 10**6 + 1, "b a " * 200), rows[0], rows[1]]
    assert result(substring.remove_repeats(docs(rows))) == brute(rows)


def test_small_windows_and_few_buckets(docs, rng):
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(40)]
    assert result(substring.remove_repeats(docs(rows), size=6)) == brute(rows, 6)


def test_many_copies(docs, prose):
    text = prose(90)
    out = result(substring.remove_repeats(docs([(i, text) for i in range(300)])))
    assert out[0] == (0, 90, 0, text)
    assert all(r[1:] == (90, 90, "") for r in out[1:])


def test_empty_table(docs):
    assert substring.remove_repeats(docs([])).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=80), st.integers(1, 9))
def test_rolled_hashes_tell_windows(symbols, size):
    h = substring._rolled(np.array(symbols, np.uint64) + np.uint64(1), size)
    windows = [tuple(symbols[i : i + size]) for i in range(len(symbols) - size + 1)]
    assert len(h) == len(windows)
    assert len(set(h.tolist())) == len(set(windows))
    assert len(set(zip(h.tolist(), windows, strict=True))) == len(set(windows))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 17])
def test_sliding_min(size, rng):
    x = np.array([rng.randrange(100) for _ in range(60)], np.uint64)
    assert substring._sliding_min(x, size).tolist() == [x[i : i + size].min() for i in range(60 - size + 1)]
