"""Line dedup against brute force; the index after deletions; the cuckoo filter."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import line_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_docs=5, min_chars=40):
    """Multiset of (doc_id, n_lines, n_dropped, text)."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders.setdefault(key_of(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in lines if not (len(holders.get(key_of(x), ())) >= min_docs and max(holders[key_of(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"], r["text"] or "") for r in df.collect()), key=str)


def rows_with_shared_lines(rng, prose, n=60):
    shared = [prose(12) for _ in range(6)] + ["x" * 39, "X" * 40, "é" * 40]
    rows = []
    for i in range(n):
        lines = [prose(9) for _ in range(rng.randrange(4))] + [rng.choice(["", " ", "\t"]) + (s.upper() if rng.random() < 0.3 else s) + rng.choice(["", " \r"]) for s in shared if rng.random() < 0.4]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_brute_force(docs, rng, prose, odd):
    rows = rows_with_shared_lines(rng, prose) + [(i + 100 if i is not None else None, t) for i, t in odd]
    assert result(line_dedup.deduplicate(docs(rows))) == brute(rows)


def test_columns_stay(docs, prose):
    line = prose(12)
    out = line_dedup.deduplicate(docs([(i, line) for i in range(5)]))
    assert out.columns == ["doc_id", "text", "key", "fp", "line_dedup"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "", 1: "", 2: "", 3: "", 4: line}


def test_empty_table(docs):
    assert line_dedup.deduplicate(docs([])).collect() == []


def test_repeated_rows_are_one_document(docs, prose):
    line = prose(12)
    assert all(r["line_dedup"]["n_dropped"] == 0 for r in line_dedup.deduplicate(docs([(1, line)] * 9)).collect())


def filters_know(index):
    """Every hot key is in its shard's filter, and the filter holds nothing else."""
    filters = {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.filters.collect()}
    hot = index.hot().collect()
    for r in hot:
        assert filters[r["shard"]].contains(line_dedup._hash64([bytes(r["key"])])).all()
    assert sum(f.size for f in filters.values()) == len(hot)


def test_deleting_takes_back(spark, docs, rng, prose):
    rows = rows_with_shared_lines(rng, prose, 40)
    first, second = docs(rows[:25]), docs(rows[25:])
    once = line_dedup.LineIndex(spark, shards=4).insert(first)
    back = once.insert(second).delete(second)
    columns = ["key", "n_docs"]
    assert sorted(map(tuple, back.refs.select(columns).collect())) == sorted(map(tuple, once.refs.select(columns).collect()))
    filters_know(once)
    filters_know(back)
    assert result(back.apply(first)) == brute(rows[:25])


def test_inserting_in_steps_equals_at_once(spark, docs, rng, prose):
    rows = rows_with_shared_lines(rng, prose, 40)
    index = line_dedup.LineIndex(spark, shards=3).insert(docs(rows[:10])).insert(docs(rows[10:]))
    filters_know(index)
    assert result(index.apply(docs(rows))) == brute(rows)


def test_filters_in_blocks_pass_the_same(spark, docs, rng, prose):
    """The filters answer whatever their size; in blocks they let the same lines pass."""
    rows = rows_with_shared_lines(rng, prose, 30)
    index = line_dedup.LineIndex(spark).insert(docs(rows))
    postings = index.postings(docs(rows))
    passed = index.candidates(postings)
    assert passed.join(index.hot(), "key", "left_semi").count() == postings.join(index.hot(), "key", "left_semi").count() <= passed.count() < postings.count()
    size = sum(len(r["filter"]) for r in index.filters.collect())
    blocks = index.candidates(postings, filter_bytes=size // 3)
    assert blocks.columns == postings.columns and sorted(map(str, blocks.collect())) == sorted(map(str, passed.collect()))


def test_shards_grow_with_hot_lines(spark, docs, rng, prose, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_SHARD", 2)
    rows = rows_with_shared_lines(rng, prose, 40)
    index = line_dedup.LineIndex(spark, shards=1).insert(docs(rows[:10])).insert(docs(rows[10:]))
    assert index.shards * 2 >= index.hot().count() and index.shards > 1
    filters_know(index)
    assert result(index.apply(docs(rows))) == brute(rows)
    filters_know(index.delete(docs(rows[10:])))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.data())
def test_cuckoo_filter(keys, data):
    f = line_dedup.CuckooFilter.of(keys)
    gone = data.draw(st.sets(st.sampled_from(sorted(keys))))
    assert all(f.delete(k) for k in gone)
    left = np.array(sorted(keys - gone), np.uint64)
    assert f.contains(left).all()
    assert f.size == len(left)
    g = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert g.size == f.size and g.contains(left).all()


def test_key_strips_only_ascii_space(spark):
    lines = [" A b ", " \t\x0b\x0c\rA B ", "ÀB"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(line_dedup.line_key(F.col("l"))).collect()]
    assert got == [key_of(x) for x in lines]
    assert hashlib.sha256(got[0].encode()).digest()
