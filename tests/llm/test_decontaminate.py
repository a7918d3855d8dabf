"""Decontamination against brute force over words."""

import hashlib
import re

from tidelog.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n=13):
    windows = []
    for item, text in items:
        w = words_of(text)
        if item is not None and w:
            windows += [(str(item), w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    out = []
    for d, text in rows:
        w, hit, found = words_of(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def case(rng, prose, odd):
    items = [(i, prose(rng.choice([13, 14, 40, 5, 1]))) for i in range(12)] + [(20, None), (21, ""), (22, "?!"), (None, prose(15)), (3, prose(20)), (30, "Straße, 漢字 NAÏVE")]
    rows = []
    for i in range(50):
        w = prose(rng.choice([3, 30, 300])).split()
        for _ in range(rng.randrange(3)):
            text = rng.choice([t for _, t in items if t])
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice([str.upper, str.lower])(x) + rng.choice([".", ",", "", "\n"]) for x in text.split()]
        rows.append((100 + i, " ".join(w)))
    return rows + odd + [(8, "straße 漢字\tnaÏve"), (9, "STRAßE-漢字 NAÏVE")], items


def test_equals_brute_force(spark, docs, rng, prose, odd):
    rows, items = case(rng, prose, odd)
    got = decontaminate.report(docs(rows), bench(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)


def test_several_blocks_find_the_same(spark, docs, rng, prose, odd):
    rows, items = case(rng, prose, odd)
    a = decontaminate.contamination(docs(rows), bench(spark, items))
    b = decontaminate.contamination(docs(rows), bench(spark, items), block_bytes=400)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_long_items_in_parts(spark, docs, rng, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20)
    items = [(i, prose(n)) for i, n in enumerate((12, 13, 32, 33, 200))]
    words = items[4][1].split()
    rows = [(k, " ".join(words[k : k + 20])) for k in range(0, 190, 3)] + [(1000 + i, prose(50)) for i in range(9)]
    assert sorted((tuple(r) for r in decontaminate.report(docs(rows), bench(spark, items)).collect()), key=str) == brute(rows, items)


def test_one_automaton_a_worker(monkeypatch, prose):
    """Batches of one scan share an automaton; it is built once."""
    built = []
    monkeypatch.setattr(decontaminate, "Automaton", lambda items, n: built.append(n) or (items, n))
    for _ in range(5):
        decontaminate._automaton([("a", b"b")], 13, "key")
    assert built == [13]
    decontaminate.common.forget_state("another")


def test_scan_equals_brute_force(rng):
    """Few words, so that blocks, windows and short items meet in all ways."""
    for n in (1, 2, 3, 5, 6, 13):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 2 * n + 3)))) for i in range(6)]
        auto = decontaminate.Automaton([(str(i), t.encode()) for i, t in items], n)
        for _ in range(60):
            text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))
            n_words, hit, found, _ = auto.scan(text.encode())
            ((_, want_words, want_hit, want_items, digest, _),) = brute([(1, text)], items, n)
            assert (n_words, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()) == (want_words, want_hit, want_items, digest)


def test_memory_follows_the_benchmark(rng, prose):
    """An automaton's patterns are the items' words once, not each overlapping window."""
    text = prose(5000)
    auto = decontaminate.Automaton([("1", text.encode())], 13)
    assert auto.automaton.get_stats()["nodes_count"] <= 5000 + 1


def test_spans_lie_in_the_original(spark, docs, prose):
    item = prose(15)
    text = "Ä first line.\n" + item.upper().replace(" ", " -- ") + "! And a tail"
    row = decontaminate.contamination(docs([(1, text)]), bench(spark, [(1, item)])).first()
    ((a, b),) = row["hit_spans"]
    assert text.encode()[a:b].decode() == item.upper().replace(" ", " -- ")
    assert row["hit_words"] == list(range(3, 18))


def test_reject_keeps_the_clean(spark, docs, rng, prose, odd):
    rows, items = case(rng, prose, odd)
    long = prose(15)
    items = [*items, (40, long)]
    rows = [*rows, (900, prose(2000) + " " + long + " " + prose(2000)), (901, prose(4000) + " " + " ".join(long.split()[:12]))]
    full = [(i, t) for i, t in items if len(words_of(t)) >= 13]
    leaks = [n > 0 for _, _, n, *_ in (brute([r], full)[0] for r in rows)]
    want = sorted((r[0] for r, leak in zip(rows, leaks, strict=True) if not leak and not brute([r], items)[0][-1]), key=str)
    assert 900 not in want and 901 in want
    for block in (10**6, 400):
        out = decontaminate.reject(docs(rows), bench(spark, items), block_bytes=block)
        assert out.columns == docs([]).columns
        assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str) == want


def test_empty_tables(spark, docs, prose):
    assert decontaminate.report(docs([]), bench(spark, [(1, prose(20))])).collect() == []
    row = decontaminate.report(docs([(1, prose(20))]), bench(spark, [])).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (20, 0, False)
