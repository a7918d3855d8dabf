"""SimHash fingerprints and components against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidelog.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ABab cd\té \n", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_of_long_text(prose):
    text = prose(70_000)
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def near(rng, text):
    words = text.split()
    for _ in range(rng.randrange(1, 4)):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def test_equals_brute_force(docs, rng, prose, odd):
    base = [prose(rng.choice([5, 40, 400])) for _ in range(25)]
    rows = [(100 + i, near(rng, rng.choice(base)) if rng.random() < 0.5 else rng.choice(base)) for i in range(120)] + odd
    got = simhash.near_duplicates(docs(rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})  # some links are between different fingerprints


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []


def test_links_connect_all_within_two_bits(spark, rng):
    centre = rng.getrandbits(64)
    fps = {centre, 0}
    for _ in range(40):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [(int(np.array([x], np.uint64).view(np.int64)[0]),) for x in fps]
    roots = dict(simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect())
    todo, want = {x for (x,) in signed}, {}
    while todo:
        group = [todo.pop()]
        for x in group:
            hit = {y for y in todo if ((x ^ y) & (2**64 - 1)).bit_count() <= 2}
            todo -= hit
            group += hit
        want |= {x: min(group) for x in group}
    assert {x: roots.get(x, x) for x in want} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}


def test_no_pairs_of_a_group(spark):
    """A group at one variant gives a link for each member, not for each pair."""
    fps = spark.range(64).select(F.expr("shiftleft(cast(1 as bigint), cast(id as int))").alias("fp"))
    assert simhash.links(fps).count() <= 64 * 65
